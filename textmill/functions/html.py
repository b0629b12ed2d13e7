"""HTML to text nodes: (parent tag, text) of every visible text node of a page.

The tree rules are our own, lenient ones: void elements never open; a start tag p, li, tr, td, th, dt, dd or option closes an
open one of its kind, and a start p also any b or strong open within it; an end tag closes the innermost open element of its
name and all within; script, style, comments and declarations have no text; entities are decoded; a page may end anywhere.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"<!--.*?(?:-->|$)|<![^>]*(?:>|$)|<\?[^>]*(?:>|$)|<(/?)([A-Za-z][A-Za-z0-9]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SELF = frozenset("li tr td th dt dd option".split())


def text_nodes(content: str) -> list[tuple[str, str]]:
    """(parent tag, text) of each text node that isn't blank; the parent of text outside of all elements is ""."""
    stack, nodes, at, n = [""], [], 0, len(content)
    while at < n:
        m = _TAG.search(content, at)
        text = content[at : m.start() if m else n]
        if text.strip():
            nodes.append((stack[-1], html.unescape(text)))
        if m is None:
            break
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag or tag in _VOID:
            continue
        if m.group(1):
            if tag in stack:
                del stack[len(stack) - 1 - stack[::-1].index(tag) :]
        elif tag in ("script", "style"):
            end = re.compile(rf"</{tag}\s*>?", re.I).search(content, at)
            at = end.end() if end else n
        else:
            if tag == "p" and "p" in stack:
                del stack[len(stack) - 1 - stack[::-1].index("p") :]
            elif tag in _SELF and stack[-1] == tag:
                stack.pop()
            if not m.group(3).endswith("/"):
                stack.append(tag)
    return nodes


_KIND = pa.list_(pa.struct([("tag", pa.string()), ("text", pa.string())]))


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        nodes = [[{"tag": t, "text": x} for t, x in text_nodes(c)] if c else [] for c in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, _KIND)], ["doc_id", "nodes"])


def with_text_nodes(pages: DataFrame, key: str, content: str) -> DataFrame:
    """(doc_id, nodes array<struct<tag, text>>) of every page; null content has no nodes."""
    rows = pages.select(F.col(key).cast("bigint").alias("doc_id"), F.col(content).cast("string").alias("content"))
    return rows.mapInArrow(_nodes, "doc_id bigint, nodes array<struct<tag:string,text:string>>")
