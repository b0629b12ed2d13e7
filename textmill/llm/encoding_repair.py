"""Garbled text from wrong decoding (problem 7): round-trip repair.

Words with characters beyond ASCII are re-encoded under each legacy encoding in which they could have been read and strictly
decoded as each encoding in which they could have been written, again and again for nested layers; the result that lowers
the garbling cost most is accepted if it lowers it enough. The cost of a word is its surprise, in bits, under a character
pair model counted over all rows of the input (garbled pairs are rare beside the right ones of the same language). Stretches
that lost characters on the way can't be restored; they are recognised by the lost character's stand-in or by what the loss
leaves behind inside a word.

Defined results: null and empty contents are never garbled; a claimed encoding is ignored; exact duplicate rows give one row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.visual_form import LOOK_ALIKES

# Encodings in which text is often written, and encodings in which it is often wrongly read.
INTENDED = ("utf-8", "cp1252", "cp1251", "koi8_r", "cp1253")
READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp437", "cp850", "cp866", "mac_roman", "koi8_r", "iso8859_2", "iso8859_5", "iso8859_7", "iso8859_15", "cp1254")
LAYERS = 3  # how often text may have been wrongly decoded
MIN_DROP = 7.0  # bits by which the cost must fall
MULTIBYTE = 6.0  # bits in favour of a reading in several bytes a character, which text hardly fits by chance

_PLAIN = str.maketrans({a: b for letters, latin in LOOK_ALIKES.values() for a, b in zip(letters, latin, strict=True)})
_SPLIT = re.compile(r"[ \t\r\n\f\v<>\"=]+")
_MARK = "�"
_LETTER = r"[^\W\d_]"
_SCRIPTS = (("A", "À", "ʯ"), ("C", "Ѐ", "ԯ"), ("G", "Ͱ", "Ͽ"), ("J", "぀", "ヿ"), ("J", "一", "鿿"))
_CONTROL = re.compile(r"[\x00-\x1f\x7f-\x84]")
# a sign that no orthography puts between letters: C1 controls, boxes, mathematical signs, currency and vulgar signs
_SIGNS = r"\x80-\x9f¡-¦¨©¬®-´¶¸¹¼-¾×÷ƒˆˇ˘˙˚˛˜˝†‡•…‰‹›⁄€™∂∏∑√∞∩∫≈≠≡≤≥─-▓■⌐⌠⌡∙ⁿ₧"
_AROUND = re.compile(r"([A-Za-z])\?+(?=([a-z]))")
_SIGN_IN_WORD = re.compile(rf"{_LETTER}[{_SIGNS}]+{_LETTER}|{_LETTER}[\x80-\x9f]|[\x80-\x9f]{_LETTER}|[Ãâ][{_SIGNS}]|[ГР][{_SIGNS}]")
_LOST = re.compile(rf"(?:[^\x00-\x7f]\?+|\?+[^\x00-\x7f])(?:{_LETTER}|[^\x00-\x7f])|{_LETTER}\?+{_LETTER}.*[^\x00-\x7f]|{_LETTER}�|�")
_ASCII_LOST = re.compile(r"[\W_]*[A-Za-z]+(?:\?+[a-z]+)+(?:[-'][A-Za-z]+)*[\W_]*")  # a whole word of letters, not a name with a query
LIKELY = 16.0  # bits that the two pairs around a lost letter may cost at most


def hard_words(text: str) -> list[str]:
    """The words with a character beyond ASCII, and those of ASCII letters between which a question mark stands."""
    return [w for w in _SPLIT.split(text) if not w.isascii() or "?" in w and _ASCII_LOST.fullmatch(w)]


def _alphabets() -> frozenset[str]:
    """The characters of the code pages beyond ASCII."""
    found = set()
    for name in {*INTENDED, *READ_AS} - {"utf-8"}:
        found |= {c for b in range(128, 256) if (c := bytes([b]).decode(name, "ignore"))}
    return frozenset(found | {_MARK})


def symbol(c: str) -> str:
    """What a character counts as in the pair model: characters of the code pages and ASCII as themselves, any other by its block of 256 and
    whether it is a letter. So a model has 8,700 symbols at most, and pairs
    mostly within a script."""
    return c if c < "\x80" or c in ALPHABETS else f"{ord(c) >> 8:x}{'L' if c.isalpha() else 'S'}"


def read_bytes(text: str, encoding: str) -> bytes | None:
    """The bytes that were read as ``text`` under ``encoding``. Readers leave undefined bytes of the Windows code pages as
    C1 controls, so those stand for themselves."""
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        if not encoding.startswith("cp12") or not any("\x80" <= c <= "\x9f" for c in text):
            return None
    out = bytearray()
    for c in text:
        if "\x80" <= c <= "\x9f":
            out.append(ord(c))
        else:
            try:
                out += c.encode(encoding)
            except UnicodeEncodeError:
                return None
    return bytes(out)


ALPHABETS = _alphabets()


class Repairer:
    """Judges words under a pair model. ``pairs`` counts (symbol, next symbol), with "" at a word's ends."""

    def __init__(self, pairs: dict[tuple[str, str], int], cache: int = 300_000) -> None:
        self.pairs = pairs
        self.firsts: Counter = Counter()
        for (a, _), n in pairs.items():
            self.firsts[a] += n
        size = max(2, len(self.firsts))
        # absolute discounting: a pair seen once says little, as garbled text leaves many of them
        bits = {(a, b): -math.log2((n - 0.98) / (self.firsts[a] + 0.02 * size)) for (a, b), n in pairs.items()}
        self.bits = {(a, b): x for (a, b), x in bits.items() if b}
        self.between: dict[tuple[str, str], bool] = {}
        self.letters = {a for a in self.firsts if a > "\x7f" and len(a) == 1 and a.isalpha()}
        self.ends = {a: x for (a, b), x in bits.items() if not b}
        self.unseen = {a: -math.log2(0.02 / (n + 0.02 * size)) for a, n in self.firsts.items()}
        self.seen: dict[str, tuple[bool, str]] = {}
        self.flags: dict[str, bool] = {}
        self.cache = cache

    def cost(self, word: str) -> float:
        bits, before, script = 0.0, "", ""
        get, unseen = self.bits.get, self.unseen
        for c in word:
            s = c if c < "\x80" or c in ALPHABETS else symbol(c)
            if c > "\x7f" or before > "\x7f" or not before:
                bits += get((before, s)) or unseen.get(before, 20.0)
            now = script_of(c)
            if now and script and now != script and "J" not in (now, script):
                bits += 12
            script, before = now, s
        if before > "\x7f":
            bits += self.ends.get(before) or unseen.get(before, 20.0)
        return bits + 12 * bool(_SIGN_IN_WORD.search(word)) + 40 * word.count(_MARK)

    def readings(self, word: str, controls: bool = False) -> Iterator[tuple[str, float]]:
        """Texts that one wrong decoding would have turned into ``word``, with what speaks for them beside their cost. Those with
        controls are no right text, but may hold a further layer."""
        done, read = {word}, set()
        for wrong in READ_AS:
            data = read_bytes(word, wrong)
            if data is None or data in read:
                continue
            read.add(data)
            for intended in INTENDED:
                try:
                    text = data.decode(intended)
                except UnicodeDecodeError:
                    continue
                if text not in done and (controls or not _CONTROL.search(text)):
                    done.add(text)
                    yield text, MULTIBYTE if intended == "utf-8" else 0.0

    def repaired(self, word: str) -> str:
        """The reading of least cost within ``LAYERS`` layers if it costs enough less, else the word."""
        best, least = word, self.cost(word) - MIN_DROP
        if least < 1 or disguised(word):
            return word
        layer, followed = [word], {word}
        for _ in range(LAYERS):
            found: dict[str, float] = {}
            for w in layer:
                for t, more in self.readings(w, controls=True):
                    found[t] = max(more, found.get(t, 0.0))
            costs = [(self.cost(t) - more, t) for t, more in found.items() if not _CONTROL.search(t)]
            least, best = min([(least, best), *(c for c in costs if c[0] < least)])
            # only a reading with fewer characters can hold a further layer of a multi-byte encoding; all of these are followed
            layer = [t for t in found if len(t) < len(word) and not t.isascii() and t not in followed]
            followed.update(layer)
        return best

    def likely(self, a: str, b: str) -> bool:
        """Whether some letter beyond ASCII may well stand between two letters."""
        got = self.between.get((a, b))
        if got is None:
            before = self.unseen.get(a, 20.0)
            got = self.between[a, b] = any((self.bits.get((a, c)) or before) + self.bits.get((c, b), 99.0) <= LIKELY for c in self.letters)
        return got

    def lost(self, word: str) -> bool:
        """Whether a word shows that characters were lost: by its signs, or, where it is ASCII, because question marks stand where the
        collection has letters beyond ASCII."""
        if not word.isascii():
            return lost(word)
        return bool(_ASCII_LOST.fullmatch(word)) and all(self.likely(m[1], m[2]) for m in _AROUND.finditer(word))

    def garbled(self, word: str) -> bool:
        """The first value of ``judge``, without a search for the best restoration where one layer settles it."""
        got = self.flags.get(word)
        if got is None:
            least = self.cost(word) - MIN_DROP
            got = self.lost(word) or least >= 1 and not disguised(word) and any(self.cost(t) - more < least for t, more in self.readings(word)) or self.repaired(word) != word
            if len(self.flags) >= self.cache:
                self.flags.clear()
            self.flags[word] = got
        return got

    def judge(self, word: str) -> tuple[bool, str]:
        """Whether a word is garbled, and its repaired form (the word itself where it can't be restored)."""
        got = self.seen.get(word)
        if got is None:
            fixed = self.repaired(word)
            got = (fixed != word or self.lost(word), fixed)
            if len(self.seen) >= self.cache:
                self.seen.clear()
            self.seen[word] = got
        return got


def script_of(c: str) -> str:
    """Alphabet of a letter (kana and ideographs count as one), "" for other characters."""
    if c < "\x80":
        return "A" if c.isalpha() else ""
    if not c.isalpha():
        return ""
    return next((k for k, lo, hi in _SCRIPTS if lo <= c <= hi), "")


def disguised(word: str) -> bool:
    """Whether a word is Latin but for several letters of another script with the shape of a Latin one (problem 10)."""
    plain = word.translate(_PLAIN)
    return plain.isascii() and sum(a != b for a, b in zip(word, plain, strict=True)) >= 2 and any("A" <= c <= "z" for c in word)


def lost(word: str) -> bool:
    """Whether a word beyond ASCII shows that characters were lost in wrong decoding."""
    return bool(_LOST.search(word)) or bool(_SIGN_IN_WORD.search(word))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: Counter = Counter()
    for b in batches:
        for text in b.column(0).to_pylist():
            words.update(hard_words(text))
        if len(words) > 500_000:
            yield _pairs(words)
            words = Counter()
    yield _pairs(words)


def _pairs(words: Counter) -> pa.RecordBatch:
    pairs: Counter = Counter()
    for w, n in words.items():
        before = ""
        for c in (*map(symbol, w), ""):
            pairs[before, c] += n
            before = c
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.string()), pa.array([b for _, b in pairs], pa.string()), pa.array(pairs.values(), pa.int64())], ["a", "b", "n"])


def pair_model(contents: DataFrame) -> dict[tuple[str, str], int]:
    """Symbol pair counts over the words beyond ASCII of all rows. What reaches the driver is one row per distinct pair of symbols: bounded
    by the fixed set of symbols, not by the rows or their scripts."""
    counted = contents.mapInArrow(_count, "a string, b string, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return {(r.a, r.b): r.n for r in counted.collect()}


def _model_of(rows: DataFrame):
    return rows.sparkSession.sparkContext.broadcast(pair_model(rows.select("content")))


def _hard_rows(tables: tuple[DataFrame, ...]) -> DataFrame:
    """(page_id, content) of the rows that could have a garbled word."""
    rows = tables[0].select("page_id", "content")
    for t in tables[1:]:
        rows = rows.unionByName(t.select("page_id", "content"))
    return rows.where(F.col("page_id").isNotNull() & F.col("content").rlike(r"[^\x00-\x7F]|[A-Za-z]\?+[a-z]"))


def judge_text(repairer: Repairer, text: str) -> tuple[bool, dict[str, str]]:
    """Whether a text has a garbled word, and the words to be replaced."""
    garbled, changes = False, {}
    for w in hard_words(text):
        bad, fixed = repairer.judge(w)
        garbled |= bad
        if fixed != w:
            changes[w] = fixed
    return garbled, changes


def garbled_pages(*tables: DataFrame) -> DataFrame:
    """(page_id): the records of the tables with a garbled stretch."""
    rows = _hard_rows(tables)
    model = _model_of(rows)

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        garbled = Repairer(model.value).garbled
        for b in batches:
            yield b.select(["page_id"]).filter(pa.array([any(map(garbled, hard_words(text))) for text in b.column(1).to_pylist()], pa.bool_()))

    return rows.mapInArrow(flag, f"page_id {rows.schema['page_id'].dataType.simpleString()}").distinct()


def repaired_pages(*tables: DataFrame) -> DataFrame:
    """(page_id, content): the restored text of every record in which something could be restored."""
    rows = _hard_rows(tables)
    model = _model_of(rows)

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = Repairer(model.value)
        for b in batches:
            ids, texts = [], []
            for page, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                _, changes = judge_text(repairer, text)
                if changes:
                    ids.append(page)
                    texts.append("".join(changes.get(part, part) for part in re.split(f"({_SPLIT.pattern})", text)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(texts, pa.string())], ["page_id", "content"])

    return rows.mapInArrow(restore, f"page_id {rows.schema['page_id'].dataType.simpleString()}, content string").distinct()
