"""Page boilerplate mixed with main content (problem 5).

The pages of a host are one token stream (a token is the text between two tags of a line, numbers masked; right after the headline,
where byline and date stand, capitalised words too). Prefix doubling gives the suffixes of each page fingerprints of their first
1, 2, 4, 8 tokens; suffixes of equal fingerprint share a substring of that length. Substrings of ``MIN_WORDS`` words or more that
stand on ``MIN_PAGES`` distinct pages of the host are boilerplate, as are single tokens of fewer words on ``SHORT_SHARE`` of its
pages, and what they cover is removed: menus, side headings, prompts, notices and bylines are known by nothing else. What is left are
unique runs; the article is the unique run that belongs to the page's headline: the uncovered rest of the innermost container
in which the headline stands (and of the sections beside it), or of a page without containers the lines down to the
next covered one after its first paragraph.

A host is worked on in shards of about ``SHARD_PAGES`` pages or ``SHARD_CHARS`` characters, so no task holds a whole large host.
The shards of a host count their pages by fingerprint, the counts are summed over the host, and every shard gets back those
of its fingerprints that are repeated on the host; so results don't depend on the shards, nor on other hosts.

Defined results: null and empty contents, pages without visible text and residue pages (problem 2) give nothing; pages
without a host are one host; exact duplicate rows count once, of several contents of one page id a shard takes the greatest;
a page cut off at its end keeps what is there; a page in which no headline is found keeps its unique run with the most words.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm import residue
from textmill.llm.site_lines import site_of
from textmill.operators.skew import salted_join
from textmill.session import cut_lineage

SHARD_PAGES, SHARD_CHARS = 1500, 16_000_000  # of a task; results don't depend on them
MIN_WORDS, MIN_PAGES = 4, 3  # words that a repeated substring must have, and distinct pages of the host on which it must stand
SHORT_SHARE = 0.04  # of the host's pages, on which a single token of fewer words must stand (and on MIN_PAGES)
LEAD = 3  # visible lines after the headline that may be byline and date

_GONE = re.compile(r"(?is)<(script|style|noscript|title)\b.*?(?:</\1\s*>|$)|<!--.*?(?:-->|$)|<head\b[^>]*>.*?(?:</head\s*>|(?=<body))")
_TITLE = re.compile(r"(?is)<title\b[^>]*>(.*?)(?:</title|\n|$)")
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)[^<>]*>?|<![^>]*>?")
_HEADING = re.compile(r"(?i)<h[1-6]\b|^\s*(?:<\w+[^>]*>\s*)*<(?:b|strong)\b[^>]*>[^<]*</(?:b|strong)>\s*(?:<br\s*/?>\s*|</\w+>\s*)*$")
_OPENERS = frozenset("div section main article aside header footer nav center td form dialog".split())
_MARKED = _OPENERS | {"pre"}
_SIDES = frozenset("aside header footer nav center form dialog".split())
_DIGITS = re.compile(r"\d+")
_SPACE = re.compile(r"\s+")
_CAPITAL = re.compile(r"\b[^\W\d_a-z]\w*")


class Page:
    """Lines, containers and tokens of one page."""

    def __init__(self, content: str) -> None:
        title = _TITLE.search(content)
        self.title = _SPACE.sub(" ", html.unescape(title.group(1))).strip() if title else ""
        body = _GONE.sub(lambda m: "\n" * m.group(0).count("\n"), content)
        self.raw = body.split("\n")
        self.text: list[str] = []  # visible text of each line
        self.home: list[int] = []  # innermost container of each line
        self.parent, self.kind = [0], ["body"]  # containers; 0 is the body
        self.pre: list[bool] = []
        self.tokens: list[str] = []
        self.token_line: list[int] = []
        self._read()
        lead, start = set(), self.headline([False] * len(self.text))
        if start is not None:
            lead = set([n for n in range(start + 1, len(self.text)) if self.text[n]][:LEAD])
        self.lead = [n in lead for n in self.token_line]

    def keys(self) -> list[str]:
        """The tokens as they are compared: numbers masked, in lower case; those after the headline that have a number and capitalised
        words, as a byline has, with these masked too."""
        out = []
        for t, near in zip(self.tokens, self.lead, strict=True):
            plain = _DIGITS.sub("0", t)
            shape = _CAPITAL.sub("A", plain) if near and plain != t else plain
            out.append(plain.lower() if shape == plain else "\1" + shape)
        return out

    def _read(self) -> None:
        stack, in_pre = [0], False
        for n, line in enumerate(self.raw):
            if "<" not in line:
                text = line if "&" not in line else html.unescape(line)
                self.text.append(text.strip())
                self.home.append(stack[-1])
                self.pre.append(in_pre)
                if self.text[-1]:
                    self.tokens.append(self.text[-1])
                    self.token_line.append(n)
                continue
            parts = _TAG.split(line)  # text, slash, name, text, slash, name, ... text
            visible = [(i, t) for i, p in enumerate(parts[::3]) if p and (t := (html.unescape(p) if "&" in p else p).strip())]
            was_pre = in_pre
            names = {x.lower() for x in parts[2::3] if x}
            if not _MARKED.isdisjoint(names):
                opened: list[tuple[str, int]] = []
                for i, (slash, tag) in enumerate(zip(parts[1::3], parts[2::3], strict=True), 1):
                    tag = tag.lower() if tag else ""
                    if tag == "pre":
                        in_pre = not slash
                    elif tag not in _OPENERS:
                        continue
                    elif not slash:
                        opened.append((tag, i))
                    elif opened and opened[-1][0] == tag:
                        opened.pop()
                    elif len(stack) > 1 and tag in (kinds := [self.kind[c] for c in stack[1:]]):
                        del stack[len(kinds) - kinds[::-1].index(tag) :]
                last_text = visible[-1][0] if visible else -1
                for tag, before in opened:  # a container opens only where its line ends; else it is one line's wrapping
                    if before > last_text:
                        self.parent.append(stack[-1])
                        self.kind.append(tag)
                        stack.append(len(self.kind) - 1)
            self.text.append(" ".join([t for _, t in visible]) if len(visible) != 1 else visible[0][1])
            self.home.append(stack[-1])
            self.pre.append(was_pre or in_pre or "pre" in names)
            for _, t in visible:
                self.tokens.append(t)
                self.token_line.append(n)

    def within(self, c: int, top: int) -> bool:
        while c and c != top:
            c = self.parent[c]
        return c == top

    def aside(self, c: int) -> bool:
        while c:
            if self.kind[c] in _SIDES:
                return True
            c = self.parent[c]
        return False

    def headline(self, covered: list[bool]) -> int | None:
        """The line that repeats the title, else the first heading outside of side containers."""
        wanted = {self.title, *(self.title.rsplit(sep, 1)[0].strip() for sep in (" | ", " - ", " – ", " :: ") if sep in self.title)} - {""}
        first = None
        for n, t in enumerate(self.text):
            if not t or self.aside(self.home[n]):
                continue
            if t in wanted or "  " in t and " ".join(t.split()) in wanted:
                return n
            if first is None and not covered[n] and not self.pre[n] and _HEADING.search(self.raw[n]):
                first = n
        return first

    def article(self, covered: list[bool]) -> list[int]:
        """Numbers (from 1) of the lines of the article."""
        start = self.headline(covered)
        if start is None:
            weight: dict[int, int] = {}
            for n, t in enumerate(self.text):
                if t and not covered[n] and not self.aside(self.home[n]):
                    weight[self.home[n]] = weight.get(self.home[n], 0) + t.count(" ") + 1
            if not weight:
                return []
            top = max(weight, key=lambda c: (weight[c], -c))
            start = next(n for n, t in enumerate(self.text) if t and self.home[n] == top)
        top = self.home[start]
        beside = self.parent[top] if self.kind[top] == "section" else None
        found, body = [], 0
        for n in range(start, len(self.text)):
            t, c = self.text[n], self.home[n]
            if not t or not self.within(c, top) and not (beside is not None and c != beside and self.within(c, beside) and self._section(c, beside)):
                continue
            if n > start and not self.pre[n] and covered[n]:
                if top == 0 and body:  # a page without containers: its unique run ends here
                    break
                continue
            if top == 0 and self.aside(c):
                continue
            found.append(n + 1)
            body += n > start and not _HEADING.search(self.raw[n])
        return found

    def _section(self, c: int, beside: int) -> bool:
        while self.parent[c] != beside:
            c = self.parent[c]
        return self.kind[c] == "section"


def runs(pages: list[Page]) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, bool]]]:
    """The page of each token, and for 1, 2, 4, 8 tokens the starts and 64-bit fingerprints of the runs within one page that
    have enough words; beside them the single tokens of fewer words (``True`` at the end)."""
    ids: dict[str, int] = {}
    stream, words = [], []
    for page in pages:
        for t in page.keys():
            stream.append(ids.setdefault(t, len(ids)))
            words.append(t.count(" ") + 1)
    owner = np.repeat(np.arange(len(pages)), [len(p.tokens) for p in pages])
    prints = np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in ids], np.uint64)
    prints = prints[np.array(stream, np.int64)]
    weight = np.concatenate([[0], np.cumsum(np.array(words, np.int64))])
    found, length = [], 1
    if len(prints):
        short = np.flatnonzero(np.diff(weight) < MIN_WORDS)
        found.append((1, short, prints[short].view(np.int64), True))
    while len(prints):
        at = np.flatnonzero((owner[length - 1 :] == owner[: len(prints)]) & (weight[length:] - weight[: len(prints)] >= MIN_WORDS))
        found.append((length, at, prints[at].view(np.int64), False))
        if length == 8 or len(prints) <= length:
            break
        prints = _mixed(_mixed(prints[:-length]) + prints[length:])
        length *= 2
    return owner, found


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, by whose rounds prints are told apart by order and length."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def page_counts(owner: np.ndarray, found: list[tuple[int, np.ndarray, np.ndarray, bool]], short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, number of distinct pages) of the runs with enough words, or of the short ones."""
    found = [f for f in found if f[3] == short]
    prints = np.concatenate([f[2] for f in found]) if found else np.zeros(0, np.int64)
    pages = np.concatenate([owner[f[1]] for f in found]) if found else prints
    order = np.lexsort((pages, prints))
    prints, pages = prints[order], pages[order]
    new = np.ones(len(prints), bool)
    new[1:] = (prints[1:] != prints[:-1]) | (pages[1:] != pages[:-1])
    return np.unique(prints[new], return_counts=True)


def covered_tokens(pages: list[Page], repeated: np.ndarray | None = None) -> list[np.ndarray]:
    """Per page, which of its tokens lie in a substring that is repeated on the host: one of the fingerprints ``repeated``, which
    are counted over ``pages`` where they aren't given."""
    owner, found = runs(pages)
    if repeated is None:
        (long, n), (brief, m) = (page_counts(owner, found, short) for short in (False, True))
        repeated = np.concatenate([long[n >= MIN_PAGES], brief[(m >= MIN_PAGES) & (m >= SHORT_SHARE * len(pages))]])
    marks = np.zeros(len(owner) + 1, np.int64)
    for length, at, prints, _ in found:
        at = at[np.isin(prints, repeated)]
        np.add.at(marks, at, 1)
        np.add.at(marks, at + length, -1)
    return np.split(np.cumsum(marks)[:-1] > 0, np.cumsum([len(p.tokens) for p in pages])[:-1])


def article_lines(contents: list[str], repeated: np.ndarray | None = None) -> list[list[int]]:
    """For distinct pages of a host, the numbers of their article lines. ``repeated`` as of ``covered_tokens``."""
    pages = [Page(c) for c in contents]
    lines = []
    for page, cover in zip(pages, covered_tokens(pages, repeated), strict=True):
        covered, own = [False] * len(page.text), [False] * len(page.text)
        for line, c in zip(page.token_line, cover.tolist(), strict=True):
            covered[line] |= c
            own[line] |= not c
        lines.append(page.article([c and not o for c, o in zip(covered, own, strict=True)]))
    return lines


def _contents(t: pa.Table) -> dict[int, str]:
    """The content of each distinct page."""
    first: dict[int, str] = {}
    for page, content in zip(t.column("page_id").to_pylist(), t.column("content").to_pylist(), strict=True):
        if page not in first or content > first[page]:
            first[page] = content
    return first


def _shard(t: pa.Table, repeated: np.ndarray | None = None) -> pa.Table:
    first = _contents(t)
    ids, numbers = [], []
    for page, found in zip(first, article_lines(list(first.values()), repeated), strict=True):
        ids.extend([page] * len(found))
        numbers.extend(found)
    return pa.table({"page_id": pa.array(ids, pa.int64()), "line_no": pa.array(numbers, pa.int64())})


def _texts(t: pa.Table, repeated: np.ndarray | None = None) -> pa.Table:
    first = _contents(t)
    ids, texts = [], []
    for (page, content), found in zip(first.items(), article_lines(list(first.values()), repeated), strict=True):
        if found:
            shown = Page(content).text
            ids.append(page)
            texts.append("\n".join(shown[n - 1] for n in found))
    return pa.table({"page_id": pa.array(ids, pa.int64()), "article": pa.array(texts, pa.string())})


MOST_BROADCAST = 1_000_000  # rows (of two numbers) up to which the shards of large hosts are broadcast


def host_shards(pages: DataFrame) -> DataFrame:
    """(page_id, content, host, shard, split): pages with the shard of their host, by page id, and whether the host has several.

    A host has as many shards as its own pages and characters ask for. The hosts with several are counted: up to
    ``MOST_BROADCAST`` are broadcast, more are joined by shuffle (whose skew is split at run time)."""
    rows = pages.where(F.col("page_id").isNotNull() & (F.col("content") != "")).select(F.col("page_id").cast("bigint").alias("page_id"), "content", F.xxhash64(F.coalesce(site_of(F.col("url")), F.lit(""))).alias("host"))
    sizes = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"))
    shards = F.ceil(F.greatest(F.col("n") / SHARD_PAGES, F.col("chars") / SHARD_CHARS)).cast("int")
    large = cut_lineage(sizes.select("host", shards.alias("shards")).where("shards > 1"))
    if large.count() <= MOST_BROADCAST:
        large = F.broadcast(large)
    shard = F.pmod(F.xxhash64("page_id"), F.coalesce("shards", F.lit(1))).cast("int")
    return rows.join(large, "host", "left").select("page_id", "content", "host", shard.alias("shard"), F.col("shards").isNotNull().alias("split"))


def _counts(t: pa.Table) -> pa.Table:
    owner, found = runs([Page(c) for c in _contents(t).values()])
    parts = [page_counts(owner, found, short) for short in (False, True)]
    n = sum(len(p) for p, _ in parts)
    key = {c: pa.array(np.full(n, t.column(c)[0].as_py(), kind)) for c, kind in (("host", np.int64), ("shard", np.int32))}
    return pa.table(key | {"run": pa.array(np.concatenate([p for p, _ in parts])), "short": pa.array(np.repeat([False, True], [len(p) for p, _ in parts])), "n": pa.array(np.concatenate([m for _, m in parts]).astype(np.int32))})


def repeated_runs(split: DataFrame) -> DataFrame:
    """(host, shard, run): of each shard of the split hosts, the runs that stand on enough distinct pages of the host. A page
    is in one shard only, so the shards' counts of distinct pages add up."""
    counts = split.groupBy("host", "shard").applyInArrow(_counts, "host bigint, shard int, run bigint, short boolean, n int")
    hosts = split.groupBy("host").agg(F.count_distinct("page_id").alias("pages"))
    runs_ = counts.groupBy("host", "run", "short").agg(F.sum("n").alias("n"), F.collect_list("shard").alias("shards")).where(F.col("n") >= MIN_PAGES)
    enough = salted_join(runs_, hosts, ["host"], F.col("run")).where(~F.col("short") | (F.col("n") >= F.lit(SHORT_SHARE) * F.col("pages")))
    return enough.select("host", F.explode("shards").alias("shard"), "run")


def _by_host(pages: DataFrame, others: tuple[DataFrame, ...], work, schema: str) -> DataFrame:
    """``work`` on the pages of every host, with the runs repeated on the host; without residue pages, which are found in all tables."""
    rows = host_shards(pages)
    whole = rows.where(~F.col("split")).select("page_id", "content", "host").groupBy("host").applyInArrow(lambda t: work(t), schema)
    split = rows.where("split").select("page_id", "content", "host", "shard")
    keys = ("host", "shard")
    parts = split.groupBy(*keys).cogroup(repeated_runs(split).groupBy(*keys)).applyInArrow(lambda t, runs: work(t, runs.column("run").to_numpy()), schema)
    return whole.unionByName(parts).join(residue.residue_pages(pages, *others), "page_id", "left_anti")


def main_lines(pages: DataFrame, *others: DataFrame) -> DataFrame:
    """(page_id, line_no): the lines of each page's article. Residue is that of problem 2 in ``pages`` and ``others``."""
    return _by_host(pages, others, _shard, "page_id bigint, line_no bigint")


def main_text(pages: DataFrame, *others: DataFrame) -> DataFrame:
    """(page_id, article): the visible text of the article lines of each page that has any, a line each. ``others`` as of ``main_lines``."""
    return _by_host(pages, others, _texts, "page_id bigint, article string")
