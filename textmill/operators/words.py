"""Lemmas and spelling from the corpus's own vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The public noun endings and what replaces them.
NOUN_RULES = (("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"), ("s", ""))


def lemma_candidates(token: Column) -> Column:
    """Forms that a noun rule makes of a token; words of up to two letters and those in -ss or -us have none."""
    made = [F.when(token.endswith(a), F.concat(F.substring(token, F.lit(1), F.length(token) - len(a)), F.lit(b))) for a, b in NOUN_RULES]
    forms = F.filter(F.array(*made), lambda x: x.isNotNull() & (x != ""))
    return F.when((F.length(token) <= 2) | token.endswith("ss") | token.endswith("us"), F.array().cast("array<string>")).otherwise(forms)


def lemma_map(vocabulary: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """(token, lemma): the shortest (then first) candidate that the lexicon knows, else the token. The lexicon is the
    vocabulary itself unless given. A dictionary join, built once per index."""
    known = (lexicon or vocabulary).select(F.col("token").alias("form")).distinct()
    tried = vocabulary.select("token", F.explode(lemma_candidates(F.col("token"))).alias("form"))
    best = tried.join(known, "form").groupBy("token").agg(F.min(F.struct(F.length("form"), "form"))["form"].alias("lemma"))
    return vocabulary.select("token").distinct().join(best, "token", "left").select("token", F.coalesce("lemma", "token").alias("lemma"))


def lemmatized(frequencies: DataFrame, lemmas: DataFrame) -> DataFrame:
    """(doc_id, token, n) with tokens replaced by their lemmas and counts added up."""
    return frequencies.join(lemmas, "token").groupBy("doc_id", F.col("lemma").alias("token")).agg(F.sum("n").alias("n"))


def _parts(length: Column) -> list[tuple[Column, Column]]:
    """(start, length) of the three parts of a word; words of one or two letters have empty ones."""
    n = F.floor(length / 3).cast("int")
    return [(F.lit(1), n), (n + 1, n), (2 * n + 1, length - 2 * n)]


def spelling_candidates(words: DataFrame, dfs: DataFrame) -> DataFrame:
    """(word, candidate, distance, df): for each of ``words`` (word) the vocabulary within two edits.

    Two edits leave one of three parts of a candidate as it is, moved by two places at most. So every candidate has three keys (its
    length, the part's number, the part) and a word has those keys for which it could be a match: an equi-join, of which the
    words' side is small; what meets is tested. Candidates of one or two letters, of which an alphabet has few, have one key a length."""
    vocabulary = dfs.select(F.col("token").alias("candidate"), "df", F.length("token").alias("n"))
    part = [F.struct("n", F.lit(i).alias("i"), F.substring("candidate", a, b).alias("s")) for i, (a, b) in enumerate(_parts(F.col("n")))]
    short = F.array(F.struct("n", F.lit(0).alias("i"), F.lit("").alias("s")))
    keyed = vocabulary.select("candidate", "df", F.explode(F.when(F.col("n") < 3, short).otherwise(F.array(*part))).alias("key"))
    size = F.length("word")
    asked = words.select("word").where(F.col("word") != "").distinct().select("word", F.explode(F.sequence(F.greatest(size - 2, F.lit(1)), size + 2)).alias("n"))
    tried = []
    for i, (a, b) in enumerate(_parts(F.col("n"))):
        for move in range(-2, 3):
            at = a + move
            fits = (F.col("n") >= 3) & (at >= 1) & (at + b - 1 <= F.length("word"))
            tried.append(F.when(fits, F.struct("n", F.lit(i).alias("i"), F.substring("word", at, b).alias("s"))))
    tried.append(F.when(F.col("n") < 3, F.struct("n", F.lit(0).alias("i"), F.lit("").alias("s"))))
    keys = asked.select("word", F.explode(F.array_distinct(F.filter(F.array(*tried), lambda k: k.isNotNull()))).alias("key"))
    met = keys.join(keyed, "key").select("word", "candidate", "df").distinct()
    near = met.withColumn("distance", F.levenshtein("word", "candidate", 2).cast("bigint")).where(F.col("distance") >= 0)
    return near.select("word", "candidate", "distance", "df")


def corrected(words: DataFrame, dfs: DataFrame) -> DataFrame:
    """(word, corrected): the word itself if known, else the nearest candidate, then the most frequent, then the first;
    a word without a candidate isn't in the result."""
    order = F.struct("distance", -F.col("df"), "candidate")
    return spelling_candidates(words, dfs).groupBy("word").agg(F.min(order)["candidate"].alias("corrected"))
