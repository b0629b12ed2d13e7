"""Per-token results over nested posting lists in which a few tokens hold most elements, by eager aggregation through joins: the
entries and their distinct (token, page) elements are each reduced to one state per token before they are joined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.operators.skew import eager_join_aggregate, eager_join_states, heavy_keys


def page_elements(entries: DataFrame) -> DataFrame:
    """(token, doc_id), distinct, over all lists of a token.

    Repeats within a list are dropped inside the row; repeats across the lists of several runs by a hash aggregate on
    (token, doc_id), whose partitions are even however hot a token is. Null tokens, null lists and null ids give nothing."""
    ids = entries.where(F.col("token").isNotNull()).select("token", F.explode(F.array_distinct(F.transform("postings", lambda p: p["doc_id"]))).alias("doc_id"))
    return ids.where(F.col("doc_id").isNotNull()).distinct()


def token_pages(entries: DataFrame) -> DataFrame:
    """(token, pages): distinct pages over all lists of a token; what moves is one partial count per task and token."""
    return page_elements(entries).groupBy("token").agg(F.count(F.lit(1)).alias("pages"))


def heavy_token_entries(entries: DataFrame, share_num: int = 3, share_den: int = 200) -> DataFrame:
    """(token, run_id) of every entry of a token whose pages are at least share_num/share_den of the pages of all tokens.

    The join of entries and elements is never built: both sides are states per token (entries, pages), of which at most
    share_den/share_num tokens can qualify. Those are the broadcast side of the roll-down to entries, which keep only token and run."""
    states = eager_join_states(entries.select("token"), page_elements(entries), "token")
    heavy = heavy_keys(states, "right_rows", share_num, share_den).select("token")
    return entries.select("token", "run_id").join(F.broadcast(heavy), "token")


def token_join_totals(entries: DataFrame, postings: DataFrame) -> DataFrame:
    """Per token, totals over the join of list elements with index rows, by eager aggregation: join_rows (pairs),
    sum_list_frequency and sum_row_frequency over the pairs. A hot token has millions of pairs but one state a side."""
    lists = entries.select("token", F.explode("postings").alias("p")).select("token", F.col("p.frequency").alias("list_frequency"))
    rows = postings.select("token", F.col("frequency").alias("row_frequency"))
    return eager_join_aggregate(lists, rows, "token", ["list_frequency"], ["row_frequency"])


def token_report(entries: DataFrame) -> DataFrame:
    """Per token: runs, list elements, true pages, the df that the runs wrote (nulls as 0), and the difference."""
    stated = entries.select("token", F.when(F.col("postings").isNotNull(), F.size("postings")).alias("elements"), "df")
    states = eager_join_states(stated, page_elements(entries), "token", ["elements", "df"], how="left")
    pages, df = F.col("right_rows").cast("bigint"), F.col("l_df").cast("bigint")
    return states.select("token", F.col("left_rows").alias("runs"), F.col("l_elements").cast("bigint").alias("elements"), pages.alias("pages"), df.alias("stated_df"), (df - pages).alias("overstated"))
