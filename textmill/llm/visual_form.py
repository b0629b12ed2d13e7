"""One form for texts that look the same (problem 10).

Each Arrow batch is handed to a DuckDB connection inside the Python worker; the form is an SQL expression made of
``translate`` (full-width and half-width forms, kinds of space, letters of other scripts with the shape of a Latin one),
``regexp_replace`` (invisible characters) and ``nfc_normalize`` (combining accents).

Defined results: null stays null, an empty text stays empty; case, accents, words, punctuation and line breaks are kept.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.operators.skew import salted_join
from textmill.session import cut_lineage

# Letters of other scripts and the Latin letters of the same shape.
LOOK_ALIKES = {
    "Cyrillic": ("АВЕЅІЈКМНОРСТУХҺӀԀԚԜаеѕіјорсухһӏԁԛԝЁёЇї", "ABESIJKMHOPCTYXhIdQWaesijopcyxhldqwËëÏï"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹονρϲόΌΆΈΊΎ", "ABEZHIKMNOPTYXCovpcóÓÁÉÍÝ"),
    "Armenian": ("Օօ", "Oo"),
}
# Spaces other than U+0020.
SPACES = "".join(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))
# Characters without a width of their own, as a regular expression.
INVISIBLE = r"[\x{00AD}\x{034F}\x{061C}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}]+"


def _compatibility() -> dict[str, str]:
    """Full-width and half-width forms with their ordinary ones, by the Unicode rule."""
    pairs = ((chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(0xFF01, 0xFFEF))
    return {a: b for a, b in pairs if a != b and len(b) == 1}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def form_sql(column: str) -> str:
    """The DuckDB expression that brings ``column`` to its one form."""
    table = _compatibility() | dict.fromkeys(SPACES, " ")
    for letters, latin in LOOK_ALIKES.values():
        table |= dict(zip(letters, latin, strict=True))
    visible = f"nfc_normalize(regexp_replace({column}, '{INVISIBLE}', '', 'g'))"
    return f"nfc_normalize(translate({visible}, {_quoted(''.join(table))}, {_quoted(''.join(table.values()))}))"


class FormSql:
    """A DuckDB connection of one worker; ``of`` maps an Arrow array of texts to their forms, ``columns`` to what ``sql`` selects,
    in order."""

    def __init__(self) -> None:
        self.db = duckdb.connect(config={"threads": 1})
        self.sql = f"SELECT {form_sql('text')} AS form FROM batch ORDER BY n"

    def columns(self, texts: pa.Array) -> list[pa.Array]:
        self.db.register("batch", pa.table({"n": pa.array(range(len(texts)), pa.int64()), "text": texts.cast(pa.string())}))
        try:
            got = self.db.sql(self.sql).to_arrow_table()
        finally:
            self.db.unregister("batch")
        return [pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in got.columns]

    def of(self, texts: pa.Array) -> pa.Array:
        return self.columns(texts)[0].cast(pa.string()) if len(texts) else pa.array([], pa.string())


def _add_form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    duck = FormSql()
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, duck.of(b.column(b.num_columns - 1))], [*b.schema.names, "form"])


def one_form(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, form) of every row; other columns of ``docs`` aren't read."""
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("text"))
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(_add_form, f"{key} {kind}, text string, form string")


PRINTS = ("f1", "f2", "t1", "t2", "lettered", "changed")


def _add_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    duck = FormSql()
    digests = ", ".join(f"md5_number_{half}({column})" for column in ("form", "text") for half in ("lower", "upper"))
    duck.sql = f"SELECT {digests}, regexp_matches(form, '\\p{{L}}'), text <> form FROM (SELECT n, text, {form_sql('text')} AS form FROM batch) ORDER BY n"
    for b in batches:
        if b.num_rows:
            *halves, lettered, changed = duck.columns(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(h.to_numpy().view("int64")) for h in halves), lettered, changed], ["doc_id", *PRINTS])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, f1, f2, t1, t2, lettered, changed) of every row with a text: 128-bit digests of form and text, whether the form
    has a letter and whether the text differs from it. Made in the embedded SQL in one pass, so no text leaves a worker."""
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_add_prints, "doc_id bigint, f1 bigint, f2 bigint, t1 bigint, t2 bigint, lettered boolean, changed boolean")


def look_alike_pairs(docs: DataFrame, salts: int = 16) -> DataFrame:
    """(doc_id_a, doc_id_b), smaller first: documents whose texts differ as strings and have the same form with a letter.

    The fingerprints are made once and kept in the checkpoint folder; only they are shuffled. A form with one distinct text
    (however many exact copies) is dropped by a partial aggregate before any join; the surviving forms are joined with salts.
    The pairs themselves are the stated result, those of two altered texts included. Rows of one doc_id are taken once per
    distinct text."""
    prints = cut_lineage(fingerprints(docs).where("lettered").drop("lettered", "changed"))
    both = F.struct("t1", "t2")
    mixed = prints.groupBy("f1", "f2").agg(F.min(both).alias("lo"), F.max(both).alias("hi")).where(F.col("lo") != F.col("hi")).select("f1", "f2")
    kept = salted_join(prints, mixed, ["f1", "f2"], F.col("doc_id"), salts).select("f1", "f2", "doc_id", "t1", "t2").distinct()
    kept = cut_lineage(kept)
    a = kept.select("f1", "f2", *(F.col(c).alias(f"{c}_a") for c in ("doc_id", "t1", "t2")))
    b = kept.select("f1", "f2", *(F.col(c).alias(f"{c}_b") for c in ("doc_id", "t1", "t2")))
    pairs = salted_join(a, b, ["f1", "f2"], F.col("doc_id_a"), salts)
    differ = (F.col("t1_a") != F.col("t1_b")) | (F.col("t2_a") != F.col("t2_b"))
    return pairs.where(differ & (F.col("doc_id_a") < F.col("doc_id_b"))).select("doc_id_a", "doc_id_b").distinct()


def form_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, changed): the smallest doc_id with the same form, and whether the text differs from its form.

    One row per document. Class ids are a partial aggregate over fingerprints, joined back with salts."""
    rows = cut_lineage(fingerprints(docs).select("doc_id", "f1", "f2", "changed"))
    classes = rows.groupBy("f1", "f2").agg(F.min("doc_id").alias("class_id"))
    return salted_join(rows, classes, ["f1", "f2"], F.col("doc_id")).select("doc_id", "class_id", "changed")
