"""Scalar text functions as Spark columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tags whose direct text is counted, and the weight of each in a score.
TAGS = ("h1", "h2", "h3", "title", "b", "strong", "other")
TAG_WEIGHTS = {"h1": 0.2, "h2": 0.15, "h3": 0.1, "title": 0.4, "b": 0.075, "strong": 0.055, "other": 0.02}
# What makes a word strange: three vowels, seven other characters, or three signs in a row.
STRANGE = ("[aeiou]{3,}", "[^aeiou]{7,}", "[^a-zA-Z0-9]{3,}")


def tokens(text: Column) -> Column:
    """Lower-cased maximal runs of ASCII letters and decimal digits of any script, as an array; empty for null."""
    return F.coalesce(F.transform(F.regexp_extract_all(text, F.lit(r"([a-zA-Z\p{Nd}]+)"), F.lit(1)), F.lower), F.array().cast("array<string>"))


def raw_terms(query: Column) -> Column:
    """The distinct whitespace-separated terms of a query in lower case, punctuation kept."""
    return F.array_distinct(F.filter(F.split(F.trim(F.lower(query)), r"\s+"), lambda t: t != ""))


def terms(query: Column) -> Column:
    """The distinct tokens of a query."""
    return F.array_distinct(tokens(query))


def is_strange(word: Column) -> Column:
    """Whether a word has a pattern that no spelling correction is tried on."""
    return word.rlike(STRANGE[0]) | word.rlike(STRANGE[1]) | word.rlike(STRANGE[2])


def ascii_or_mark(word: Column) -> Column:
    """The word with a question mark for every character beyond ASCII."""
    return F.regexp_replace(word, r"[^\x00-\x7F]", "?")


def idf(n_docs: Column, df: Column) -> Column:
    """ln(N / df), 0 where either is 0."""
    return F.when((df == 0) | (n_docs == 0), F.lit(0.0)).otherwise(F.log(n_docs.cast("double") / df))


def hamming(a: list[Column], b: list[Column]) -> Column:
    """Number of differing bits of two hashes given as words."""
    total = F.lit(0)
    for x, y in zip(a, b, strict=True):
        total = total + F.bit_count(x.bitwiseXOR(y))
    return total


def similarity(distance: Column, bits: int = 128) -> Column:
    return 1 - distance / F.lit(float(bits))


def safe_name(name: Column) -> Column:
    """A file name with reserved characters as underscores."""
    return F.regexp_replace(name, r'[<>:"/\\|?*]', "_")
