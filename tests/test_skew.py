"""Hot keys: results equal the plain ones, and the state that is broadcast stays bounded."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from textmill.operators import skew
from textmill.operators import token_sizes as ts

ENTRIES = "token string, df bigint, run_id bigint, postings array<struct<doc_id bigint, frequency bigint>>"


def entries(spark):
    r = random.Random(3)
    rows = []
    for run in range(4):
        for t in range(60):
            n = 300 if t == 0 else r.randint(1, 4)
            rows.append((f"t{t}", None if r.random() < 0.1 else n, run, [(r.randint(0, 400), r.randint(1, 3)) for _ in range(n)]))
    rows += [("empty", 0, 0, []), ("none", 1, 0, None), (None, 1, 9, [(1, 1)]), ("nullid", 1, 0, [(None, 1), (5, None)])]
    return rows, spark.createDataFrame(rows, ENTRIES)


def test_heavy_tokens_and_report(spark):
    rows, df = entries(spark)
    pages = defaultdict(set)
    for token, _, _, postings in rows:
        if token is not None:
            pages[token] |= {d for d, _ in postings or [] if d is not None}
    total = sum(map(len, pages.values()))
    heavy = {t for t, p in pages.items() if 200 * len(p) >= 3 * total}
    assert {(r.token, r.run_id) for r in ts.heavy_token_entries(df).collect()} == {(t, run) for t, _, run, _ in rows if t in heavy}
    report = {r.token: r for r in ts.token_report(df).collect()}
    assert {t: r.pages for t, r in report.items()} == {t: len(p) for t, p in pages.items()}
    assert report["none"].elements == 0 and report["t0"].runs == 4
    empty = df.limit(0)
    assert ts.heavy_token_entries(empty).count() == 0 and ts.token_report(empty).count() == 0


def test_clashing_extra_columns(spark):
    _, df = entries(spark)
    extra = df.withColumn("pages", F.lit("x")).withColumn("doc_id", F.lit("y")).withColumn("_salt", F.lit(1))
    assert sorted(map(tuple, ts.heavy_token_entries(extra).collect())) == sorted(map(tuple, ts.heavy_token_entries(df).collect()))
    assert ts.token_report(extra).count() == ts.token_report(df).count()


def test_join_totals_equal_the_join(spark):
    _, df = entries(spark)
    r = random.Random(4)
    rows = spark.createDataFrame([(f"t{r.randint(0, 70)}" if r.random() > 0.3 else "t0", None if r.random() < 0.1 else r.randint(1, 9)) for _ in range(500)] + [(None, 1)], "token string, frequency bigint")
    got = {x.token: tuple(x) for x in ts.token_join_totals(df, rows).collect()}
    lists = df.select("token", F.explode("postings").alias("p")).select("token", F.col("p.frequency").alias("a"))
    joined = lists.join(rows.withColumnRenamed("frequency", "b"), "token").groupBy("token").agg(F.count(F.lit(1)), F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0)))
    assert got == {x.token: tuple(x) for x in joined.collect()}


def test_salted_and_split_joins(spark):
    big = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id")
    big = big.unionByName(spark.createDataFrame([(None, -1)], "k string, id bigint"))
    states = big.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    plain = sorted(map(tuple, big.join(states, "k").select("k", "id", "n").collect()))
    assert sorted(map(tuple, skew.salted_join(big, states, ["k"], F.col("id"), 8).select("k", "id", "n").collect())) == plain
    assert sorted(map(tuple, skew.join_split(big, states, "k", "n", 10).select("k", "id", "n").collect())) == plain
    assert {r.k for r in skew.heavy_keys(states, "n", 1, 4).collect()} == {"hot"}
    assert skew.heavy_keys(states, "n", 1, 10).count() <= 10
