"""128-bit SimHash of documents, exact and near duplicates.

Hashes are four 32-bit words in BIGINT columns w0 (lowest bits) to w3. Equal hashes are collapsed to one class before any
comparison, so copies never pair up. Near classes (at most six bits apart) meet in one of 28 tables, each keyed by two of the
hash's eight 16-bit blocks: six differing bits leave two blocks untouched, so no pair is missed, and a key of 32 bits brings
together few others even among billions of classes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions.text import hamming, tokens
from textmill.operators.skew import salted_join

WORDS = ("w0", "w1", "w2", "w3")
NEAR = 6


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    votes: dict[str, np.ndarray] = {}

    def vote(token: str) -> np.ndarray:
        got = votes.get(token)
        if got is None:
            if len(votes) > 200_000:
                votes.clear()
            digest = hashlib.md5(token.encode("ascii", "replace")).digest()
            bits = np.unpackbits(np.frombuffer(digest, np.uint8))[::-1]  # bit 0 first
            got = votes[token] = bits.astype(np.int64) * 2 - 1
        return got

    for b in batches:
        out: list[list[int | None]] = [[], [], [], []]
        for words in b.column(1).to_pylist():
            if not words:
                for o in out:
                    o.append(None)
                continue
            counts: dict[str, int] = {}
            for w in words:
                counts[w] = counts.get(w, 0) + 1
            total = np.zeros(128, np.int64)
            for w, n in counts.items():
                total += n * vote(w)
            packed = np.packbits(total > 0, bitorder="little").view("<u4")
            for o, w in zip(out, packed.tolist(), strict=True):
                o.append(w)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(o, pa.int64()) for o in out)], ["doc_id", *WORDS])


def simhashes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, w0..w3) of every document; nulls for a text without a token."""
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), tokens(F.col(text)).alias("words"))
    return rows.mapInArrow(_hash, "doc_id bigint, w0 bigint, w1 bigint, w2 bigint, w3 bigint")


def classes(hashes: DataFrame) -> DataFrame:
    """(w0..w3, first_id, members): classes of equal hashes; documents without a hash are in none."""
    return hashes.where(F.col("w0").isNotNull()).groupBy(*WORDS).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("members"))


def _keys() -> list[Column]:
    """For each of the 28 tables, its number and the values of its two blocks."""
    halves = [h for w in WORDS for h in (F.col(w).bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(w, 16))]
    tables = enumerate(combinations(range(len(halves)), 2))
    return [F.shiftleft(F.lit(n).cast("bigint"), 32) + F.shiftleft(halves[i], 16) + halves[j] for n, (i, j) in tables]


def near_class_pairs(found: DataFrame) -> DataFrame:
    """(id_a, id_b, distance): pairs of different classes within six bits, by their first ids, smaller first."""
    keyed = found.select("first_id", *WORDS, F.explode(F.array(*_keys())).alias("key"))
    a = keyed.select("key", F.col("first_id").alias("id_a"), *(F.col(w).alias(f"a{w}") for w in WORDS))
    b = keyed.select("key", F.col("first_id").alias("id_b"), *(F.col(w).alias(f"b{w}") for w in WORDS))
    distance = hamming([F.col(f"a{w}") for w in WORDS], [F.col(f"b{w}") for w in WORDS]).cast("bigint")
    met = a.join(b, "key").where(F.col("id_a") < F.col("id_b")).withColumn("distance", distance).where(F.col("distance") <= NEAR)
    return met.select("id_a", "id_b", "distance").distinct()


def kept(hashes: DataFrame) -> DataFrame:
    """(doc_id): documents without an earlier document (smaller id) within six bits. Documents without a hash are kept.

    A document is dropped if the smallest first id of its own and the near classes is below its id; that minimum is one number
    per class."""
    found = classes(hashes)
    pairs = near_class_pairs(found)
    both = pairs.select(F.col("id_b").alias("first_id"), F.col("id_a").alias("other")).unionByName(pairs.select(F.col("id_a").alias("first_id"), F.col("id_b").alias("other")))
    least = both.groupBy("first_id").agg(F.min("other").alias("other"))
    first = found.select(*WORDS, "first_id").join(least, "first_id", "left").select(*WORDS, F.least("first_id", F.coalesce("other", "first_id")).alias("earliest"))
    dropped = hashes.join(first, list(WORDS)).where(F.col("doc_id") > F.col("earliest")).select("doc_id")
    return hashes.select("doc_id").join(dropped, "doc_id", "left_anti")


def exact_classes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, first_id): the smallest id with the same text. One row per document with text; by a 256-bit digest."""
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("doc_id"), F.sha2(text, 256).alias("digest"))
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    return salted_join(rows, firsts, ["digest"], F.col("doc_id")).select("doc_id", "first_id")
