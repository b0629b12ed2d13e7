"""Conjunctive keyword search over postings: tag-weighted scores, top-k pruning and cosine re-ranking, for many queries at once.

A query is a row (query_id, text); thousands are answered by one job. Every query's terms meet the postings in a join on the
token, in which heavy tokens stay where they are; a document survives if it has all terms (a count), at most ``depth`` documents
a query are kept by score, and only those meet the document vectors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions.text import TAG_WEIGHTS, TAGS, idf, is_strange, raw_terms, terms, tokens
from textmill.operators.skew import salted_join
from textmill.operators.words import corrected
from textmill.session import cut_lineage

DEPTH, PAGE_SIZE = 50, 5


def query_terms(queries: DataFrame, mode: str = "tokens") -> DataFrame:
    """(query_id, token, n_terms): distinct terms of each query. Mode "strict" splits at white space only and keeps signs."""
    split = raw_terms if mode == "strict" else terms
    rows = queries.select("query_id", split(F.col("text")).alias("ts"))
    return rows.select("query_id", F.size("ts").cast("bigint").alias("n_terms"), F.explode("ts").alias("token"))


def tag_weighted(n_docs: Column) -> Column:
    """Score of one posting: idf · (1 + Σ weight · ln f over the tags with f ≥ 1)."""
    total = F.lit(1.0)
    for t in TAGS:
        total = total + F.when(F.col(f"f_{t}") >= 1, F.lit(TAG_WEIGHTS[t]) * F.log(F.col(f"f_{t}").cast("double"))).otherwise(F.lit(0.0))
    return idf(n_docs, F.col("df")) * total


FEW_TERMS = 1000  # distinct query terms up to which they are a filter of the scan


def of_terms(postings: DataFrame, asked: DataFrame) -> DataFrame:
    """The postings of the tokens in ``asked`` (token). Up to ``FEW_TERMS`` tokens are a filter that reaches the scan; more are a semi-join
    (broadcast only if Spark finds them small enough). The result is the same."""
    tokens_ = asked.select("token").distinct()
    few = [r.token for r in tokens_.limit(FEW_TERMS + 1).collect()]
    if len(few) > FEW_TERMS:
        return postings.join(tokens_, "token", "left_semi")
    return postings.where(F.col("token").isin(*few)) if few else postings.limit(0)


def respelled(queries: DataFrame, dfs: DataFrame) -> DataFrame:
    """(query_id, text): the queries' distinct terms with every unknown one corrected from the vocabulary. An unknown term of a strange
    pattern is left out; one without a candidate stays, and finds nothing."""
    rows = query_terms(queries).select("query_id", "token")
    asked = rows.select("token").distinct()
    unknown = asked.join(dfs, "token", "left_anti").where(~is_strange(F.col("token")))
    fixed = corrected(unknown.select(F.col("token").alias("word")), dfs).withColumnRenamed("word", "token")
    state = asked.join(dfs.select("token", F.lit(True).alias("known")), "token", "left").join(fixed, "token", "left")
    kept = F.when(F.col("known"), F.col("token")).when(F.col("corrected").isNotNull(), F.col("corrected")).when(~is_strange(F.col("token")), F.col("token"))
    terms_ = rows.join(state.select("token", kept.alias("kept")), "token").where(F.col("kept").isNotNull())
    return cut_lineage(terms_.groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_set("kept")), " ").alias("text")))


def matches(queries: DataFrame, postings: DataFrame, dfs: DataFrame, n_docs: Column, mode: str = "tokens") -> DataFrame:
    """(query_id, doc_id, tfidf): documents that have every term of a query. Queries without terms match nothing.

    Only documents with a query's rarest term can match, so those are its candidates, and the other terms are looked up for
    the candidates alone, by (doc_id, token), a key that no frequent token makes hot. A query with an unknown term is dropped
    at once."""
    asked = query_terms(queries, mode)
    postings, known = of_terms(postings, asked), asked.join(dfs, "token")
    whole = known.groupBy("query_id", "n_terms").agg(F.count(F.lit(1)).alias("known"), F.min(F.struct("df", "token"))["token"].alias("token")).where(F.col("known") == F.col("n_terms"))
    candidates = salted_join(postings.select("doc_id", "token"), whole.select("query_id", "token"), ["token"], F.col("doc_id"), 8).select("query_id", "doc_id")
    wanted = salted_join(candidates, known, ["query_id"], F.col("doc_id"), 8)
    hits = postings.join(wanted, ["doc_id", "token"]).withColumn("s", tag_weighted(n_docs))
    found = hits.groupBy("query_id", "doc_id", "n_terms").agg(F.count(F.lit(1)).alias("present"), F.sum("s").alias("tfidf"))
    return found.where(F.col("present") == F.col("n_terms")).select("query_id", "doc_id", "tfidf")


def top(found: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The best ``depth`` documents of each query by score, ties by doc_id; pruned before the shuffle too."""
    order = Window.partitionBy("query_id").orderBy(F.round("tfidf", 9).desc(), "doc_id")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= depth).drop("r")


def rerank(best: DataFrame, queries: DataFrame, vectors: DataFrame, norms: DataFrame) -> DataFrame:
    """(query_id, rank, doc_id, tfidf, cosine): by cosine of raw counts, then score, then doc_id."""
    q = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("qn"))
    qnorm = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qn") * F.col("qn")).cast("double")).alias("qnorm"))
    dots = best.join(q, "query_id").join(vectors, ["doc_id", "token"]).groupBy("query_id", "doc_id").agg(F.sum(F.col("qn") * F.col("n")).cast("double").alias("dot"))
    scored = best.join(dots, ["query_id", "doc_id"], "left").join(qnorm, "query_id", "left").join(norms, "doc_id", "left")
    cosine = F.coalesce(F.try_divide("dot", F.col("qnorm") * F.col("norm")), F.lit(0.0))
    order = Window.partitionBy("query_id").orderBy(F.round(cosine, 9).desc(), F.round("tfidf", 9).desc(), "doc_id")
    return scored.select("query_id", F.row_number().over(order).cast("bigint").alias("rank"), "doc_id", "tfidf", cosine.alias("cosine"))


def page(ranked: DataFrame, number: int, size: int = PAGE_SIZE) -> DataFrame:
    """One page of results of each query, from 1; beyond the last page nothing."""
    if number < 1:
        raise ValueError(f"pages are numbered from 1, not {number}")
    return ranked.where((F.col("rank") > (number - 1) * size) & (F.col("rank") <= number * size))


def counts(found: DataFrame, depth: int = DEPTH, size: int = PAGE_SIZE) -> DataFrame:
    """(query_id, n_matched, n_ranked, pages)."""
    n = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_matched"))
    ranked = F.least("n_matched", F.lit(depth).cast("bigint"))
    return n.select("query_id", "n_matched", ranked.alias("n_ranked"), F.ceil(ranked / size).cast("bigint").alias("pages"))


def with_urls(ranked: DataFrame, urls: DataFrame) -> DataFrame:
    """Results with the url (and path) of their page; pages without an own url are left out. ``urls``: (url, doc_id, path), first page wins."""
    return ranked.join(urls, "doc_id")
