"""Counting terms: flat postings, nested entries, document frequencies, vectors and statistics.

The base table is flat, a row per (token, doc_id), so every aggregate is a partial-then-final hash aggregate and no token's
list is ever one task's. Nested entries are a view for small results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions.html import with_text_nodes
from textmill.functions.text import TAGS, idf, tokens


def exploded(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, token), a row per occurrence. Null texts have none."""
    return docs.select(F.col(key).alias("doc_id"), F.explode(tokens(F.col(text))).alias("token"))


def word_frequencies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, token, n): occurrences of each token in each document; also the document vectors."""
    return exploded(docs, key, text).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))


def tag_frequencies(pages: DataFrame, key: str = "page_id", content: str = "content") -> DataFrame:
    """(doc_id, token, f_h1 ... f_other, tf): occurrences by the tag of the text node's parent; others count as other."""
    nodes = with_text_nodes(pages, key, content).select("doc_id", F.explode("nodes").alias("x"))
    words = nodes.select("doc_id", F.col("x.tag").alias("tag"), F.explode(tokens(F.col("x.text"))).alias("token"))
    named = [F.count_if(F.col("tag") == t).alias(f"f_{t}") for t in TAGS[:-1]]
    counted = words.groupBy("doc_id", "token").agg(*named, F.count(F.lit(1)).alias("tf"))
    return counted.withColumn("f_other", F.col("tf") - sum(F.col(f"f_{t}") for t in TAGS[:-1])).select("doc_id", "token", *(f"f_{t}" for t in TAGS), "tf")


def plain_postings(frequencies: DataFrame) -> DataFrame:
    """Word frequencies as postings: all counts in other."""
    return frequencies.select("doc_id", "token", *(F.lit(0).cast("bigint").alias(f"f_{t}") for t in TAGS[:-1]), F.col("n").alias("f_other"), F.col("n").alias("tf"))


def indexed_postings(rows: DataFrame) -> DataFrame:
    """Rows of an index with tag maps as postings: of several rows of one (token, doc_id) the one of the highest run, once;
    rows without token or page are left out; missing tags are 0; tf is the sum of the map."""
    maps = F.coalesce("tag_frequencies", F.create_map().cast("map<string,bigint>"))
    counts = F.struct("run_id", *(F.coalesce(F.try_element_at(maps, F.lit(t)), F.lit(0).cast("bigint")).alias(f"f_{t}") for t in TAGS))
    last = rows.where((F.col("token") != "") & F.col("doc_id").isNotNull()).groupBy("token", "doc_id").agg(F.max(counts).alias("c"))
    return last.select("doc_id", "token", *(F.col(f"c.f_{t}") for t in TAGS), sum((F.col(f"c.f_{t}") for t in TAGS[1:]), F.col(f"c.f_{TAGS[0]}")).alias("tf"))


def document_frequencies(postings: DataFrame) -> DataFrame:
    """(token, df) of postings, which have one row per token and document."""
    return postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def with_idf(dfs: DataFrame, n_docs: Column) -> DataFrame:
    """``dfs`` (token, df) with idf for a collection of ``n_docs`` documents."""
    return dfs.withColumn("idf", idf(n_docs, F.col("df")))


def nested_entries(postings: DataFrame, most: int | None = None) -> DataFrame:
    """(token, df, postings): lists of (doc_id, frequency) in the order of documents; of all tokens, or of the ``most`` tokens of greatest
    df (ties by token), which are chosen before a list is built."""
    if most is not None:
        postings = postings.join(F.broadcast(document_frequencies(postings).orderBy(F.col("df").desc(), "token").limit(most).select("token")), "token", "left_semi")
    lists = postings.groupBy("token").agg(F.sort_array(F.collect_list(F.struct("doc_id", F.col("tf").alias("frequency")))).alias("postings"))
    return lists.select("token", F.size("postings").cast("bigint").alias("df"), "postings")


def bad_residuals(postings: DataFrame) -> DataFrame:
    """Postings whose other count is negative; always empty for counts made here."""
    return postings.where(F.col("f_other") < 0)


def stale_frequencies(rows: DataFrame) -> DataFrame:
    """(token, doc_id, run_id, frequency, tf): index rows whose frequency is null or isn't the sum of their map."""
    tf = F.aggregate(F.map_values("tag_frequencies"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.select("token", "doc_id", "run_id", "frequency", tf.alias("tf")).where(~F.col("frequency").eqNullSafe(F.col("tf")))


def norms(frequencies: DataFrame) -> DataFrame:
    """(doc_id, norm): Euclidean norm of each document's counts."""
    return frequencies.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")).alias("norm"))


def statistics(docs: DataFrame, postings: DataFrame) -> DataFrame:
    """One row: documents, distinct tokens, postings, occurrences."""
    per_token = postings.groupBy("token").agg(F.count(F.lit(1)).alias("p"), F.sum("tf").alias("w"))
    sums = per_token.agg(F.count(F.lit(1)).alias("n_tokens"), F.coalesce(F.sum("p"), F.lit(0)).cast("bigint").alias("n_postings"), F.coalesce(F.sum("w"), F.lit(0)).cast("bigint").alias("n_words"))
    return sums.withColumn("n_docs", docs.agg(F.count(F.lit(1)).alias("c")).scalar())


def partition_statistics(postings: DataFrame) -> DataFrame:
    """(partition, first_token, last_token, postings) per file of a stored index, numbered from 1 in the order of tokens."""
    files = postings.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("token").alias("first_token"), F.max("token").alias("last_token"), F.count(F.lit(1)).alias("postings"))
    return files.select(F.row_number().over(Window.orderBy("first_token", "file")).cast("bigint").alias("partition"), "first_token", "last_token", "postings")
