"""Building blocks for keys that hold a large share of all rows.

Three devices, used by every operator whose key may be hot:

* ``heavy_keys`` picks the keys that hold at least a given share of a total. At most ``1/share`` keys can, whatever the
  data, so the result has a proven bound and may be broadcast.
* ``salted_join`` joins a large side to a compact one with the hot keys spread over a fixed number of salts.
* ``join_split`` joins rows to per-key states: the heavy keys by broadcast (bounded as above), the others by shuffle.
* ``eager_join_states`` and ``eager_join_aggregate`` replace aggregate-over-join by join-over-aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def heavy_keys(states: DataFrame, weight: str, share_num: int, share_den: int) -> DataFrame:
    """Rows of ``states`` (one per key) whose ``weight`` is at least share_num/share_den of the sum of all weights.

    Since the weights of distinct keys add up to the total, at most share_den/share_num rows come out. The comparison is in
    whole numbers. Null weights count as 0; an empty input gives an empty output."""
    total = states.agg(F.sum(weight).alias("t")).scalar()
    return states.where(F.col(weight) * F.lit(share_den) >= total * F.lit(share_num)).where(F.col(weight) > 0)


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], spread: Column, salts: int = 16, how: str = "inner") -> DataFrame:
    """Equi-join with every key of ``small`` repeated once per salt and the rows of ``big`` spread by ``spread`` (a column
    that differs within a key). A key with a third of all rows is then read by ``salts`` tasks. Null keys never match."""
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def join_split(rows: DataFrame, states: DataFrame, key: str, weight: str, share_den: int = 2000) -> DataFrame:
    """Inner join of ``rows`` to ``states`` (one row per key, ``weight`` = rows of that key in ``rows``).

    Keys with at least 1/share_den of all rows (at most share_den keys: a proven bound) are broadcast and their rows stay
    where they are; the rest, none of which is hot, is joined by shuffle."""
    heavy = heavy_keys(states, weight, 1, share_den)
    names = heavy.select(F.col(key))
    hot = rows.join(F.broadcast(heavy), key)
    light = states.join(F.broadcast(names), key, "left_anti")
    cold = rows.join(F.broadcast(names), key, "left_anti").join(light.hint("shuffle_merge"), key)
    return hot.unionByName(cold)


def eager_join_states(left: DataFrame, right: DataFrame, key: str, left_sums: list[str] = (), right_sums: list[str] = (), how: str = "inner") -> DataFrame:
    """The compact states of a join's inputs, joined: key, left_rows, right_rows, and l_<c> and r_<c> for the sums of either side.

    Both inputs are first reduced to one state per key (row count and sums, combined map-side, so a hot key costs one partial row per
    task); only the states are joined. Null keys never join; a null value counts as 0 in its sum; with ``how="left"`` a key without
    rows on the right has 0 there."""
    a = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("left_rows"), *[F.coalesce(F.sum(c), F.lit(0)).alias(f"l_{c}") for c in left_sums])
    b = right.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("right_rows"), *[F.coalesce(F.sum(c), F.lit(0)).alias(f"r_{c}") for c in right_sums])
    joined = a.join(b, key, how)
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in b.columns if c != key})


def eager_join_aggregate(left: DataFrame, right: DataFrame, key: str, left_sums: list[str], right_sums: list[str]) -> DataFrame:
    """Aggregates of the inner join of two inputs per key, without building the join: from the joined states, counts multiply and a sum
    of one side is scaled by the count of the other. Result: key, join_rows, and sum_<c> for each column of left_sums and
    right_sums."""
    return eager_join_states(left, right, key, left_sums, right_sums).select(
        key,
        (F.col("left_rows") * F.col("right_rows")).alias("join_rows"),
        *[(F.col(f"l_{c}") * F.col("right_rows")).alias(f"sum_{c}") for c in left_sums],
        *[(F.col(f"r_{c}") * F.col("left_rows")).alias(f"sum_{c}") for c in right_sums],
    )
