"""How distinctive a term is per record (problem 1).

Every (token, page) gets the log-likelihood ratio of its two-by-two table (this term or another, this page or the rest of
the collection), signed by whether the term is over-represented, and beside it the product of tag count and inverse
document frequency by which the stated cases are defined.

Defined results: rows without a token (null or empty) are ignored; of several rows of one (token, page) the one with the
highest run counts, and of equal runs the greatest count; a null or empty tag map is a count of 0; null page ids are
ignored; an empty table gives no rows. Equal weights at the top of a page give no case unless all others are 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmill.operators.skew import join_split
from textmill.session import cut_lineage


def latest_counts(postings: DataFrame) -> DataFrame:
    """(token, doc_id, tf): one row per token and page, by a hash aggregate on both, so a hot token is spread evenly."""
    tf = F.coalesce(F.aggregate(F.map_values("tag_frequencies"), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0))), F.lit(0))
    rows = postings.where(F.col("token").isNotNull() & (F.col("token") != "") & F.col("doc_id").isNotNull()).select("token", "doc_id", F.struct(F.col("run_id"), tf.alias("tf")).alias("last"))
    return rows.groupBy("token", "doc_id").agg(F.max("last")["tf"].alias("tf"))


def score_terms(postings: DataFrame, min_df: int = 2) -> DataFrame:
    """(doc_id, token, tf, df, weight, llr) for every token of at least ``min_df`` pages.

    The counts are made once and kept in the checkpoint folder; every later step reads them there. Token states (df, collection count)
    are pre-aggregated map-side; heavy tokens (a bounded number) are joined by broadcast and the others by shuffle. Page totals come
    from a window over the page's own rows; who doesn't read the ratio doesn't pay for them."""
    counts = cut_lineage(latest_counts(postings))
    tokens = counts.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("ctf"))
    n_pages = counts.select("doc_id").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    total = counts.agg(F.sum("tf").alias("s")).scalar()
    page = Window.partitionBy("doc_id")
    rows = join_split(counts, tokens, "token", "df").withColumn("dtf", F.sum("tf").over(page)).where(F.col("df") >= min_df)
    rows = rows.withColumn("weight", F.col("tf") * F.log(n_pages / F.col("df"))).withColumn("_all", total)
    k11, k12, k21 = (c.cast("double") for c in (F.col("tf"), F.col("dtf") - F.col("tf"), F.col("ctf") - F.col("tf")))
    k22 = (F.col("_all") - F.col("dtf") - F.col("ctf") + F.col("tf")).cast("double")
    n = F.col("_all").cast("double")

    def part(k, row, col):
        return F.when(k > 0, k * F.log(k * n / (row * col))).otherwise(F.lit(0.0))

    r1, r2, c1, c2 = k11 + k12, k21 + k22, k11 + k21, k12 + k22
    g2 = 2 * (part(k11, r1, c1) + part(k12, r1, c2) + part(k21, r2, c1) + part(k22, r2, c2))
    sign = F.when(k11 * n >= r1 * c1, F.lit(1.0)).otherwise(F.lit(-1.0))
    return rows.select("doc_id", "token", "tf", "df", "weight", (sign * g2).alias("llr"))


def dominant_terms(postings: DataFrame, factor: float = 2.0) -> DataFrame:
    """(doc_id, token): the token of greatest weight of a page, if that is at least ``factor`` times the second greatest.

    The weights are those of ``score_terms``. The rank filter is applied before the shuffle too (at most two rows per page
    and task move on), so a page with very many tokens isn't gathered in one task."""
    best = Window.partitionBy("doc_id").orderBy(F.col("weight").desc(), F.col("token"))
    top = score_terms(postings).select("doc_id", "token", "weight").withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= 2)
    pairs = top.groupBy("doc_id").agg(
        F.max(F.when(F.col("_r") == 1, F.col("token"))).alias("token"),
        F.max(F.when(F.col("_r") == 1, F.col("weight"))).alias("_w1"),
        F.coalesce(F.max(F.when(F.col("_r") == 2, F.col("weight"))), F.lit(0.0)).alias("_w2"),
    )
    return pairs.where((F.col("_w1") > 0) & (F.col("_w1") >= factor * F.col("_w2"))).select("doc_id", "token")
