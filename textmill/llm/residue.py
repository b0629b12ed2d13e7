"""Template residue and error-page text (problem 2).

Every record is cut into segments (lines, and texts between tags), of which slots, numbers, dotted names and words for the thing that was
asked for are masked. What is known beforehand is little: how an unfilled slot and filler look, and ``SEEDS``, some dozens of
labelled messages. A segment is trusted if it is made of slots or filler, or if it is a near-duplicate of a seed: the Hamming distance
of their word SimHashes is at most ``SEED_NEAR`` of 64 bits (the seeds are few, so all are compared at once) and they share at least
``SIMILAR`` of the words of the longer one. At least ``SUSPECT`` of a suspect's words are
words of seeds.

The distinct suspects get a second SimHash, over character shingles. Tables keyed by every pair of eight 8-bit partitions bring
together all pairs that differ in at most ``NEAR`` bits; Hamming distance and shared words are verified, and the trusted
label runs through the connected components of the verified links. A record with a labelled segment, and without content of its
own, is residue. Own content is what stands in other segments of six words or more, without lines that stand on several such records
of a site (those are the site's).

Defined results: null and empty contents are no residue; script, style, comment, code and noscript text isn't looked at;
exact duplicate rows give one row; identical segments are one, however many records have them; a page without a site shares no lines.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.site_lines import site_of
from textmill.operators.skew import salted_join
from textmill.session import cut_lineage

SEED_NEAR, BLOCKS, NEAR, SIMILAR, SUSPECT = 24, 8, 6, 0.8, 0.6
OWN_WORDS = 250  # words of its own from which a record has content
SITE_PAGES = 3  # suspected records of a site on which a line must stand to be the site's

# The well-known opening words of filler text.
FILLER = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore magna aliqua quis nostrud "
    "ullamco laboris nisi aliquip commodo consequat aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur "
    "excepteur sint occaecat cupidatat proident culpa officia deserunt mollit anim laborum veniam".split()
)
# Latin endings, by which made-up filler is known, and short words of living languages, which filler doesn't have.
_FILLER_START = re.compile("lorem|ipsum|dolor|consectetur|adipiscing|eiusmod|incididunt|magna|veniam|labor|irure|fugiat|pariatur|cillum|velit|nulla|aliqu|excepteur|occaecat|cupidatat|deserunt|mollit")
_LATIN = re.compile(r"\w{2,}(?:um|us|is|it|et|at|ur|am|em|ae|unt|ibus|orum|arum|isse|endo|ando)")
_LIVING = frozenset("the of and to in is a an for on that this with as by el la los las de y que en un una por con le les des du et est une pour dans der die das und ist ein eine von mit den o os do da em um uma para com não".split()) - {"et"}
# The keys under which idle fingers lie, and where such typing begins.
HOME_ROW = "asdfghjklqwe"
_AT_HOME = str.maketrans("", "", HOME_ROW + " ")
# Ways to write a slot. A name in single brackets or braces counts only as a field name.
_NAME = r"[A-Za-z]\w*(?:\.\w+)*"
_FIELD = r"(?i:\w+[_.]\w+|building|semester|instructor|term|room|title|name|course|date|email|phone|author|subject|city|address|year)"
_SLOT = re.compile(
    rf"\{{\{{\s*{_NAME}\s*\}}\}}|<%=?\s*{_NAME}\s*%>|<<{_NAME}>>|%\({_NAME}\)s|[$#]\{{{_NAME}\}}|\$\({_NAME}\)|@@{_NAME}@@|%%{_NAME}%%|%[A-Z][A-Z_]+%|\{{%-?\s*[A-Za-z][^{{}}%]*%\}}|###{_NAME}###"
    rf"|(?<![\[\w])\[{_FIELD}\](?![(\[\]])|(?<![\w$#{{])\{{{_FIELD}\}}(?!\}})|\[(?i:insert|enter|your|todo) {_NAME}\]|\[object Object\]|(?<![\w.])(?:undefined|null|NaN)(?![\w(]|\.\w)"
)
# Words for the thing that was asked for, and ways to name scripts; each counts as one word.
_THING = re.compile(r"\b(?:page|document|file|resource|url|link|folder|directory|site|website|application|app|portal|service|catalogue|system|block|section|chapter|paragraph)\b")
_SCRIPTS = re.compile(r"\b(?:a browser with )?(?:client-side )?(?:javascript|js|scripts?|scripting)\b")
#: messages that are labelled as residue, one a line
SEEDS = """
page not found; seite nicht gefunden; página no encontrada; erreur page introuvable; error; http status not found; http status unavailable; http status internal error; http status forbidden
not found; forbidden; access denied; internal server error; bad gateway; service unavailable; service temporarily unavailable; too many requests; your session has expired; something went wrong; oops something went wrong
the server is down for maintenance; please try again later; vuelva a intentarlo más tarde; versuchen sie es bitte später noch einmal; veuillez réessayer plus tard
the page you requested does not exist on this server; the page you requested has been removed; the page you requested is no longer here; the page you requested could not be found; the page you requested could not be located
the page you asked for does not exist on this server; the page you asked for has been removed; the page you asked for is no longer here; the page you asked for could not be found; the page you asked for could not be located
the page you are looking for does not exist on this server; the page you are looking for has been removed; the page you are looking for is no longer here; the page you are looking for could not be found
you do not have permission to view this page; you do not have permission to read this page; you do not have permission to open this page
fatal error call to undefined function § in § on line; fatal error uncaught § in § on line; warning include (§) failed to open stream in §; warning include (§) failed to open stream no such file or directory in § on line; at § (§); § no connection after s; § nullpointerexception
please enable javascript; please enable javascript to continue; please activate javascript to continue; please allow javascript to continue; please turn on javascript to continue; please switch on javascript to continue
please enable javascript to view this page; please activate javascript to view this page; please turn on javascript to view this page; please switch on javascript to view this page; please allow javascript to view this page
you need to enable javascript to run this app; you must enable javascript to use this page; bitte aktivieren sie javascript um die seite anzuzeigen; active javascript en su navegador para continuar; veuillez activer javascript pour afficher cette page
your browser does not support javascript; your browser has switched off javascript; your browser blocks javascript; your browser has blocked javascript; your browser cannot run javascript
this page depends on javascript; this page requires javascript; this page needs javascript; this page cannot run without javascript; this page does not work without javascript
the page depends on javascript; the page requires javascript; the page needs javascript; the page cannot run without javascript; the page does not work without javascript
please enable javascript to use the search; please turn on javascript to run this page; please switch on javascript to run this page; kindly activate javascript to run this page; kindly allow javascript to use this page; kindly activate javascript to use the search; turn on javascript to use the search; please allow javascript to run this page
you need to enable javascript to use the search; you need to enable javascript to continue; you need to activate javascript to view this page; you must enable javascript to continue; enable javascript to continue; enable javascript to use the search; turn on javascript to run this page
your browser blocks javascript the content was not loaded; your browser blocks javascript nothing can be shown; your browser blocks javascript please change the setting
pagina non trovata; página não encontrada; pagina niet gevonden; sidan hittades inte; nie znaleziono strony; siden ble ikke funnet; la página que busca no existe; la page demandée n existe pas; die angeforderte seite wurde nicht gefunden; diese seite existiert leider nicht mehr; we cannot find that page any longer; sorry this page could not be found
checking your browser before you continue; checking your browser before granting access; checking your browser before accessing the page; verifying your browser before you continue; verifying your browser before granting access
click to edit this block; your text goes here; your title goes here; headline goes here; your headline goes here; title goes here; subtitle goes here; text goes here; content goes here; title to be written; subtitle to be written
sample paragraph replace this with your own words; sample text replace this with your own words; insert the title of the page here; insert the description of the page here; here comes the title of the page to do; here comes the introduction of the page to do; this is a placeholder for the page; add some text about your page
"""
_HIDDEN = re.compile(r"(?is)<(script|style|noscript|title|pre|code|textarea)\b.*?(?:</\1\s*>|$)|<!--.*?(?:-->|$)")
_TAG = re.compile(r"<[/!]?[A-Za-z][^<>]*>?|\n")
_DIGITS = re.compile(r"\d+")
_DOTTED = re.compile(r"(?:/[\w.$-]+){2,}|\b\w+(?:[.$]\w+)+\b")  # paths, and dotted names
_WORD = re.compile(r"[^\W\d_]+")
_TERM = re.compile(r"(?<![^\W_])[^\W\d_]+(?![^\W_])|§")  # words without a digit
_EDGES = ".,;:!?()\"'“”"
_CLAUSE = re.compile(r"(?<=[^\W\d_])[.!?;]+\s")
_SLOTTED = re.compile(r"[{}\[<@%#(]|null|undefined|NaN")


def segments(content: str) -> list[str]:
    """Lines, and texts between tags, without what isn't shown."""
    text = content.replace("<%", "&lt;%").replace("%>", "%&gt;")
    if "<" in text:
        text = _HIDDEN.sub("\n", re.sub(r"<<(\w[\w.]*)>>", r"&lt;&lt;\1&gt;&gt;", text))
    return [t for s in _TAG.split(text) if (t := " ".join((html.unescape(s) if "&" in s else s).split()))]


def masked(segment: str) -> str:
    """Slots as §, dotted names as §, numbers as 0."""
    return _DIGITS.sub("0", _DOTTED.sub("§", _SLOT.sub("§", segment)))


def terms(segment: str) -> list[str]:
    """The words of a masked segment in lower case, with one word for things asked for and one for scripts."""
    return _TERM.findall(_SCRIPTS.sub("javascript", _THING.sub("page", masked(segment).lower())))


def idle(words: list[str]) -> bool:
    """Whether words are one word over and over, or keys struck along the home row."""
    if len(words) < 4:
        return False
    return len(set(words)) == 1 or len(set(words)) == 2 and len(words) >= 6 or sum(not w.strip(HOME_ROW) for w in words) >= 0.8 * len(words)


def filled(low: str, tokens: list[str] | None = None) -> bool:
    """Whether a lower-case segment is filler: mostly its words or words with Latin endings, or idle typing."""
    living = not _LIVING.isdisjoint(low.split() if tokens is None else tokens)
    if living and not _FILLER_START.search(low):
        return len(low.translate(_AT_HOME)) < 0.3 * len(low) and idle(_WORD.findall(low))
    words = _WORD.findall(low)
    if len(words) <= 2:
        return False
    if sum(w in FILLER for w in words) >= 0.6 * len(words):
        return True
    if len(words) >= 4 and _LIVING.isdisjoint(words):
        sure = sum(w in FILLER or bool(_LATIN.fullmatch(w)) for w in words)
        if sure >= 0.7 * len(words) or sure >= 0.3 * len(words) and len(words) >= 6 and sum(w in FILLER or bool(_LATIN.fullmatch(w)) or w[-1] in "aio" or w.endswith(("es", "or")) for w in words) >= 0.75 * len(words):
            return True
    return idle(words)


def word_simhash(words: list[str]) -> int:
    """64-bit SimHash over the words of a segment."""
    bits = np.unpackbits(np.array([_print(w) for w in words], np.uint64).view(np.uint8).reshape(len(words), 8), axis=1)
    return int(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(words)).view(np.uint64)[0])


def _print(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


def shared(a: list[str], b: list[str]) -> float:
    """The share of words that two segments have in common, of the longer one's."""
    return sum((Counter(a) & Counter(b)).values()) / max(len(a), len(b))


class Seeds:
    """The seeds with their SimHashes, and the judgement of segments against them."""

    def __init__(self, texts: str = SEEDS, near: int = SEED_NEAR, cache: int = 100_000) -> None:
        self.words = [w for line in texts.strip().split("\n") for t in line.split(";") if (w := terms(t.strip()))]
        self.vocabulary = {w for ws in self.words for w in ws}
        self.hashes = np.array([word_simhash(ws) for ws in self.words], np.uint64)
        self.plain = self.vocabulary | set(_THING.pattern[5:-3].split("|")) | set("javascript js script scripts scripting".split())
        self.near_bits, self.seen, self.cache = near, {}, cache

    def near(self, words: list[str]) -> bool:
        """Whether words are a near-duplicate of a seed. Fewer than SIMILAR of them being seeds' words rules that out at once."""
        if not words or sum(w in self.vocabulary for w in words) < SIMILAR * len(words):
            return False
        met = np.flatnonzero(np.bitwise_count(self.hashes ^ np.uint64(word_simhash(words))) <= self.near_bits)
        return any(shared(words, self.words[i]) >= SIMILAR for i in met.tolist())

    def label(self, segment: str) -> tuple[bool, bool]:
        """(suspect, trusted) of a segment."""
        got = self.seen.get(segment)
        if got is None:
            got = self._label(segment) if self.possible(segment) else (False, False)
            if len(segment) <= 300:
                if len(self.seen) >= self.cache:
                    self.seen.clear()
                self.seen[segment] = got
        return got

    def possible(self, segment: str) -> bool:
        """A quick test that no suspect fails: slots, filler, or enough words that may be those of seeds. A token that isn't letters only
        counts as often as it could have words."""
        if _SLOTTED.search(segment) and _SLOT.search(segment):
            return True
        low = segment.lower()
        tokens, plain = low.split(), self.plain
        rest = [t for t in tokens if t not in plain]
        spare = 2 * (len(tokens) - len(rest))  # 2 for each word of seeds, -3 for each other: below 0 where they are less than SUSPECT
        for t in rest:
            t = t.strip(_EDGES)
            if not t.isalpha():
                spare += 2 * ((len(t) + 1) // 2) if t.upper() != t or not t.isascii() else 2 * ("." in t)
            elif t in plain:
                spare += 2
            else:
                spare -= 3
        return spare >= 0 or filled(low, tokens)

    def _label(self, segment: str) -> tuple[bool, bool]:
        slots = len(_SLOT.findall(segment)) if _SLOTTED.search(segment) else 0
        if slots:
            rest = _WORD.findall(_SLOT.sub(" ", segment))
            made = len(rest) <= 3 * slots + 1 and not re.search("[\"'“`]|\\$\\w", _SLOT.sub(" ", segment)) and (len(rest) > 0 or slots > 1)
            if made:
                return True, True
        if filled(segment.lower()):
            return True, True
        words = terms(segment)
        if not words or sum(w in self.vocabulary for w in words) < SUSPECT * len(words):
            return slots > 0, False
        if self.near(words):
            return True, True
        parts = [terms(x) for x in _CLAUSE.split(segment)]  # a message and what is added to it
        return True, len(parts) > 1 and 2 * sum(len(x) for x in parts if self.near(x)) >= len(words)


_READY: list[Seeds] = []


def label(segment: str) -> tuple[bool, bool]:
    """(suspect, trusted) of a segment, against ``SEEDS``."""
    if not _READY:
        _READY.append(Seeds())
    return _READY[0].label(segment)


_SUSPECTS = "page_id {}, site bigint, row bigint, segments array<struct<id:binary,text:string,trusted:boolean>>, own array<struct<id:binary,n:int>>"


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = pa.list_(pa.struct([("id", pa.binary()), ("text", pa.string()), ("trusted", pa.bool_())]))
    lines = pa.list_(pa.struct([("id", pa.binary()), ("n", pa.int32())]))
    for b in batches:
        rows, found, own = [], [], []
        for i, content in enumerate(b.column(2).to_pylist()):
            shown = segments(content)
            labels = list(map(label, shown))
            if (True, False) in labels or (True, True) in labels:
                suspects, others = {}, {}
                for s, (suspect, trusted) in zip(shown, labels, strict=True):
                    m = masked(s)
                    if suspect:
                        suspects[m] = suspects.get(m, False) or trusted
                    if not trusted and (n := s.count(" ") + 1) >= 6:
                        others[m] = n
                rows.append(i)
                found.append([{"id": _id(m), "text": m, "trusted": t} for m, t in suspects.items()])
                own.append([{"id": _id(m), "n": n} for m, n in others.items()])
        at = pa.array(rows, pa.int32())
        prints = pa.array([xxhash.xxh3_64_intdigest(c.as_py().encode()) - (1 << 63) for c in b.column(2).take(at)], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), prints, pa.array(found, parts), pa.array(own, lines)], ["page_id", "site", "row", "segments", "own"])


def _id(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def suspects(*tables: DataFrame) -> DataFrame:
    """(page_id, site, row, segments, own): of every record with a suspect segment these segments (masked), and its other segments of six
    words or more. ``row`` tells contents of one page apart; ``site`` is null where the table has no url."""

    def of(t: DataFrame) -> DataFrame:
        site = F.xxhash64(site_of(F.col("url"))) if "url" in t.columns else F.lit(None).cast("bigint")
        known = site_of(F.col("url")).isNotNull() if "url" in t.columns else F.lit(False)
        return t.select("page_id", F.when(known, site).alias("site"), "content")

    rows = of(tables[0])
    for t in tables[1:]:
        rows = rows.unionByName(of(t))
    rows = rows.where(F.col("page_id").isNotNull() & (F.col("content") != ""))
    return rows.mapInArrow(_suspects, _SUSPECTS.format(rows.schema["page_id"].dataType.simpleString()))


def simhash(text: str) -> int:
    """Signed 64-bit SimHash over the four-character shingles of the lower-case text."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = max(1, len(codes) - 3)
    grams = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(4, len(codes))):
            grams = (grams * np.uint64(0x100000001B3)) ^ codes[i : i + n]
        grams ^= grams >> np.uint64(33)
        grams *= np.uint64(0xFF51AFD7ED558CCD)
        grams ^= grams >> np.uint64(33)
        grams *= np.uint64(0xC4CEB9FE1A85EC53)
        grams ^= grams >> np.uint64(33)
    bits = np.unpackbits(grams.view(np.uint8).reshape(n, 8), axis=1)
    votes = bits.sum(axis=0, dtype=np.int64) * 2 > n
    return int(np.packbits(votes).view(np.int64)[0])


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hashes = pa.array([simhash(t) for t in b.column(1).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([*b.columns, hashes], [*b.schema.names, "sim"])


def tabled(distinct: DataFrame) -> DataFrame:
    """(id, sim, trusted, key): the 28 table keys of each of ``distinct`` (id, text, trusted), one for every pair of the hash's partitions."""
    hashed = distinct.select("id", "text", "trusted").mapInArrow(_hash, "id binary, text string, trusted boolean, sim bigint")
    blocks = [F.shiftrightunsigned("sim", 8 * i).bitwiseAND(F.lit(255)) for i in range(BLOCKS)]
    keys = [F.lit(n << 16) + blocks[i] * 256 + blocks[j] for n, (i, j) in enumerate(combinations(range(BLOCKS), 2))]
    return hashed.select("id", "sim", "trusted", F.explode(F.array(*keys)).alias("key"))


def near_links(rest: DataFrame, fresh: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): the ids of verified links from ``rest`` to ``fresh``, both as of ``tabled``; ``texts`` (id, text).

    A pair within six bits leaves two of the eight partitions untouched, so it meets in one of the tables. Hashes decide first; only the
    texts of near pairs are fetched."""
    a = rest.select("key", F.col("id").alias("a"), F.col("sim").alias("sa"))
    b = fresh.select("key", F.col("id").alias("b"), F.col("sim").alias("sb"))
    near = F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) <= NEAR
    pairs = a.join(b, "key").where(near).select("a", "b").distinct()
    words = texts.select("id", F.split("text", " ").alias("w"))
    both = pairs.join(words.select(F.col("id").alias("a"), F.col("w").alias("wa")), "a").join(words.select(F.col("id").alias("b"), F.col("w").alias("wb")), "b")
    common = F.size(F.array_intersect("wa", "wb")) / F.greatest(F.size(F.array_distinct("wa")), F.size(F.array_distinct("wb")))
    return both.where(common >= SIMILAR).select("a", "b")


def labelled_segments(found: DataFrame) -> DataFrame:
    """(id): every suspect segment in a connected component with a trusted one. ``found`` as of ``suspects``.

    The label goes out from what was labelled last to what isn't yet, so links among unlabelled segments, however many of them are
    alike, are never made, and none is made twice."""
    each = found.select(F.explode("segments").alias("s")).select("s.id", "s.text", "s.trusted")
    distinct = cut_lineage(each.groupBy("id").agg(F.min("text").alias("text"), F.max("trusted").alias("trusted")))
    tables = cut_lineage(tabled(distinct))
    known = distinct.where("trusted").select("id")
    rest, fresh = tables.where(~F.col("trusted")), tables.where("trusted")
    while True:
        reached = cut_lineage(near_links(rest, fresh, distinct).select(F.col("a").alias("id")).distinct())
        if reached.isEmpty():
            return known
        known = known.unionByName(reached)
        fresh, rest = rest.join(reached, "id", "left_semi"), rest.join(reached, "id", "left_anti")


def residue_pages(*tables: DataFrame) -> DataFrame:
    """(page_id): the records of the tables that are residue."""
    found = cut_lineage(suspects(*tables))
    labelled = labelled_segments(found)
    each = found.select("page_id", "row", F.explode("segments.id").alias("id"))
    hit = cut_lineage(salted_join(each, labelled, ["id"], F.struct("page_id", "row")).select("page_id", "row").distinct())
    rows = found.join(hit, ["page_id", "row"], "left_semi").select("page_id", "site", "row", "own").dropDuplicates(["page_id", "row"])
    total = F.aggregate("own", F.lit(0), lambda a, x: a + x["n"])
    short, long = rows.where(total < OWN_WORDS), rows.where(total >= OWN_WORDS)
    lines = rows.where(F.col("site").isNotNull()).select("site", "page_id", F.explode("own.id").alias("id")).distinct()
    common = lines.groupBy("site", "id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SITE_PAGES).select("site", "id")
    own = long.select("page_id", "site", "row", F.explode("own").alias("o")).select("page_id", "site", "row", "o.id", "o.n")
    own = salted_join(salted_join(own, common, ["site", "id"], F.struct("page_id", "row"), how="left_anti"), labelled, ["id"], F.struct("page_id", "row"), how="left_anti")
    full = own.groupBy("page_id", "row").agg(F.sum("n").alias("n")).where(F.col("n") >= OWN_WORDS).select("page_id", "row")
    return short.select("page_id").unionByName(long.join(full, ["page_id", "row"], "left_anti").select("page_id")).distinct()


def without_residue(*tables: DataFrame) -> DataFrame:
    """The rows of the tables (of the same columns) that are no residue, with all their columns. Residue is found in all of them."""
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    return rows.join(residue_pages(*tables), "page_id", "left_anti")


def is_residue(content: str) -> bool:
    """Whether one content has a trusted segment and no content of its own; what ``residue_pages`` finds before links."""
    trusted, own = False, 0
    for s in segments(content):
        if label(s)[1]:
            trusted = True
        elif (n := s.count(" ") + 1) >= 6:
            own += n
    return trusted and own < OWN_WORDS
