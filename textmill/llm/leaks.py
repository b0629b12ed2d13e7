"""Evaluation texts leaking into training text (problem 9).

Wu-Manber search over words: the patterns are all runs of ``run`` consecutive words of the evaluation items. A table of
word blocks tells how far the window may be moved without missing a pattern; where it can't be moved, the hash of the
window's last words selects the patterns with that ending, which are compared word by word.

Both sides are first brought to the one form of look-alike texts. The items are the stated query set, whatever their number: they are
spread over blocks of about ``BLOCK_CHARS`` characters, whose tables are built in the executors and broadcast one by one as packed
arrays. With one block the corpus is formed and searched in one pass; with several its forms are made once, kept in the checkpoint
folder and searched once a block.

Defined results: null ids and texts give nothing; an item or text of fewer than ``run`` words never matches; repeated rows
and several shared runs give one row.
"""

from __future__ import annotations

import pickle
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.visual_form import FormSql, one_form
from textmill.session import cut_lineage

BLOCK_CHARS = 16_000_000
_WORD = re.compile(r"[^\W_]+")


def words(form: str) -> list[str]:
    """Maximal runs of letters and digits in lower case."""
    return _WORD.findall(form.lower())


class WuManber:
    """The shift table and the suffix buckets of one block of items.

    The items' words are one array of numbers. The shift table has a byte for each hash of a word block: the least distance of such
    a block from a pattern's end, so blocks that share a hash only shorten a move. A bucket holds the places in the array at which the
    patterns with the hash of its last block end."""

    def __init__(self, items: list[tuple[int, str]], run: int = 12, block: int = 3) -> None:
        self.run, self.block = run, block
        self.vocabulary: dict[str, int] = {}
        self.text, self.owner = array("I"), array("q")  # all items' words, and the item of each
        spans = []
        for item, form in items:
            w = words(form)
            if len(w) >= run:
                spans.append((len(self.text), len(self.text) + len(w)))
                self.text.extend(self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w)
                self.owner.extend([item] * len(w))
        self.mask = (1 << max(10, (8 * len(self.text)).bit_length())) - 1
        beyond = run - block + 1
        self.shift = bytearray([beyond]) * (self.mask + 1)
        self.bucket: dict[int, int | list[int]] = {}
        for start, stop in spans:
            for end in range(start + block - 1, stop):
                key = self._hash(*self.text[end - block + 1 : end + 1])
                # the nearest pattern end at or after this block
                if (move := max(0, start + run - 1 - end)) < self.shift[key]:
                    self.shift[key] = move
                if not move:
                    got = self.bucket.get(key)
                    if got is None:
                        self.bucket[key] = end
                    elif isinstance(got, int):
                        self.bucket[key] = [got, end]
                    else:
                        got.append(end)

    def _hash(self, a: int, b: int, c: int) -> int:
        x = (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) & 0xFFFFFFFFFFFFFFFF
        return (x ^ (x >> 29)) & self.mask

    def search(self, form: str) -> set[int]:
        """The items of which a run of words stands in the text."""
        found: set[int] = set()
        run, shift, bucket, hash_, own, owner = self.run, self.shift, self.bucket, self._hash, self.text, self.owner
        get = self.vocabulary.get
        text = [get(w, -1) for w in words(form)]
        end, last = run - 1, len(text)
        while end < last:
            a, b, c = text[end - 2 : end + 1]
            if a < 0 or b < 0 or c < 0:  # no pattern has an unknown word: the window passes the last of them
                end += run if c < 0 else run - 1 if b < 0 else run - 2
                continue
            key = hash_(a, b, c)
            move = shift[key]
            if move:
                end += move
                continue
            window = None
            places = bucket[key]
            for place in (places,) if isinstance(places, int) else places:
                if owner[place] not in found:
                    if window is None:
                        window = text[end - run + 1 : end + 1]
                        if min(window) < 0:
                            break
                    if own[place - run + 1 : place + 1].tolist() == window:
                        found.add(owner[place])
            end += 1
        return found


def block_tables(items: DataFrame, run: int = 12, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(block, tables): for each block of items its pickled ``WuManber``, built where the block is."""
    rows = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n
    block = F.pmod(F.xxhash64("item_id"), F.lit(max(1, -(-chars // block_chars)))).cast("int")

    def build(t: pa.Table) -> pa.Table:
        forms = FormSql().of(t.column("text").combine_chunks()).to_pylist()
        tables = pickle.dumps(WuManber(list(zip(t.column("item_id").to_pylist(), forms, strict=True)), run), 5)
        return pa.table({"block": t.column("block").slice(0, 1), "tables": pa.array([tables], pa.binary())})

    return rows.withColumn("block", block).groupBy("block").applyInArrow(build, "block int, tables binary")


def leaked_items(docs: DataFrame, items: DataFrame, run: int = 12, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id) of every document and item that share at least ``run`` consecutive words.

    No document is shuffled, only the matches are made distinct. The driver passes the blocks' packed tables on, one at a time."""
    spark = docs.sparkSession
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    tables = cut_lineage(block_tables(items, run, block_chars))
    several = tables.count() > 1
    if several:
        rows = cut_lineage(one_form(rows, "doc_id", "text").select("doc_id", F.col("form").alias("text")))
    found = None
    for row in tables.select("tables").toLocalIterator():
        packed = spark.sparkContext.broadcast(bytes(row.tables))

        def scan(batches: Iterator[pa.RecordBatch], packed=packed) -> Iterator[pa.RecordBatch]:
            search = pickle.loads(packed.value).search
            formed = (lambda a: a) if several else FormSql().of
            for b in batches:
                docs_, items_ = [], []
                for doc, form in zip(b.column(0).to_pylist(), formed(b.column(1)).to_pylist(), strict=True):
                    for item in search(form):
                        docs_.append(doc)
                        items_.append(item)
                yield pa.RecordBatch.from_arrays([pa.array(docs_, pa.int64()), pa.array(items_, pa.int64())], ["doc_id", "item_id"])

        part = rows.mapInArrow(scan, "doc_id bigint, item_id bigint")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint")
    return found.distinct()
