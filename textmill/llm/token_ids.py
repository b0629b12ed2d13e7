"""Encoding a corpus with a public byte-level BPE vocabulary (problem 8).

A streaming transducer: text is cut by the vocabulary's pattern as it arrives, and the bytes of each piece are run through a
left-to-right automaton whose state is, for each of the last ``reach`` byte positions, the one token that ends there in the
encoding of the prefix. ``reach`` is the merge list's sufficient lookahead: the length of its longest token, since a token
that is still to come begins at most that many bytes back. As soon as the chains of all positions within reach go through
one position, the tokens up to it are stable and are emitted, so memory doesn't grow with the text.

A token may follow another in a BPE encoding if and only if the encoding of the two together is those two; so the encoding
of every prefix is found with one compatibility test per candidate token, and nothing is ever merged again.

Defined results: null and empty texts have an empty list; strings that look like special tokens are ordinary text; lone
surrogates can't occur in a Spark string.
"""

from __future__ import annotations

import base64
import codecs
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = os.environ.get("TEXTMILL_BPE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK = 65_536  # characters of a long piece that the transducer is fed at a time; pieces of a longer text are found one by one
MAX_VOCABULARY_BYTES = 64_000_000  # the rank file is broadcast; a larger one is refused


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class Transducer:
    """Encodes and decodes with one vocabulary. One instance serves one worker."""

    def __init__(self, ranks: dict[bytes, int], cache: int = 200_000) -> None:
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.reach = max(map(len, ranks))
        ends: dict[bytes, set[int]] = {}
        for t in ranks:
            ends.setdefault(t[-2:], set()).add(len(t))
        self.lengths = {e: sorted(n, reverse=True) for e, n in ends.items()}  # of the tokens with these last bytes
        self.pieces = regex.compile(PATTERN)
        self.cache, self.cached = {}, cache  # pieces seen before; emptied when full, which costs time only
        self.compatible = lru_cache(500_000)(self._compatible)
        self.parts = lru_cache(200_000)(self._parts)

    def _merge(self, piece: bytes) -> list[bytes]:
        """Lowest rank first, leftmost first; used on strings of at most two tokens."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _parts(self, token: bytes) -> bool:
        """Whether a token is its own encoding (a vocabulary may hold tokens that merges never reach)."""
        return len(self._merge(token)) == 1

    def _compatible(self, a: bytes, b: bytes) -> bool:
        return self._merge(a + b) == [a, b]

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Ids of one piece that arrives in chunks of any size, each id as soon as it can't change any more."""
        reach, ranks, compatible, lengths = self.reach, self.ranks, self.compatible, self.lengths
        data = bytearray()  # bytes from ``base`` on
        base = 0  # position in the piece at which data begins; all before it has been emitted
        last: dict[int, bytes | None] = {0: None}  # position: the token that ends there
        at = 0
        for chunk in chunks:
            data += chunk
            while at < base + len(data):
                at += 1
                end = bytes(data[max(0, at - base - 2) : at - base])
                for n in (*lengths.get(end, ()), 1):
                    begin = at - n
                    if begin not in last:
                        continue
                    token = bytes(data[begin - base : at - base])
                    if token in ranks and self.parts(token):
                        before = last[begin]
                        if before is None or compatible(before, token):
                            last[at] = token
                            break
                if at - base >= 4 * reach and at % reach == 0:
                    stable = self._stable(last, at, base)
                    if stable > base:
                        out, p = [], stable
                        while p > base:
                            out.append(ranks[last[p]])
                            p -= len(last[p])
                        yield from reversed(out)
                        del data[: stable - base]
                        base = stable
                        for p in [p for p in last if p < stable]:
                            del last[p]
        out, p = [], at
        while p > base:
            out.append(ranks[last[p]])
            p -= len(last[p])
        yield from reversed(out)

    def _stable(self, last: dict[int, bytes | None], at: int, base: int) -> int:
        """The last position through which the chains of all positions within reach go."""
        heads = {p for p in range(at - self.reach + 1, at + 1) if p in last}
        while len(heads) > 1:
            p = max(heads)
            heads.discard(p)
            heads.add(p - len(last[p]) if p > base else base)
        return max(min(heads), base)

    def _piece(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.stream(piece[i : i + CHUNK].encode() for i in range(0, len(piece), CHUNK)))
        if len(piece) <= 64:
            if len(self.cache) >= self.cached:
                self.cache.clear()
            self.cache[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        if text:
            get, add = self.cache.get, ids.extend
            for piece in self.pieces.findall(text) if len(text) <= CHUNK else map(regex.Match.group, self.pieces.finditer(text)):
                add(get(piece) or self._piece(piece))
        return ids

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of ids as they come: a byte-to-text state machine holds back the bytes of an unfinished character."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if text := machine.decode(self.token[i]):
                yield text
        if text := machine.decode(b"", True):
            yield text


def _read(path: str) -> bytes:
    size = os.path.getsize(path)
    if size > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has {size} bytes; at most {MAX_VOCABULARY_BYTES} are broadcast")
    with open(path, "rb") as f:
        return f.read()


_READY: dict[int, Transducer] = {}


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every row, by one pass without a shuffle. The rank file (of checked size) is broadcast once."""
    ranks = docs.sparkSession.sparkContext.broadcast(_read(vocabulary))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = ranks.value
        machine = _READY.get(hash(data)) or _READY.setdefault(hash(data), Transducer(read_ranks(data)))
        for b in batches:
            for s in range(0, b.num_rows, 1000):
                part = b.slice(s, 1000)
                ids = pa.array(map(machine.encode, part.column(1).to_pylist()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(encode, "doc_id bigint, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); the inverse of ``encode_documents`` but for null texts, which come back empty."""
    ranks = encoded.sparkSession.sparkContext.broadcast(_read(vocabulary))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = ranks.value
        machine = _READY.get(hash(data)) or _READY.setdefault(hash(data), Transducer(read_ranks(data)))
        for b in batches:
            texts = pa.array(["".join(machine.decode(ids or ())) for ids in b.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), texts], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id bigint, text string")
