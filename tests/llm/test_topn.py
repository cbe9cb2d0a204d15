from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import topn

SCHEMA = "grp0 string, score double, tie int, key long, rank string"


def brute(rows, n):
    by = {}
    for g, s, t, k, _ in rows:
        if g is not None and s is not None and not math.isnan(s) and k is not None:
            by.setdefault(g, []).append((-s, t or 0, k))
    return {(g, r + 1, x[2]) for g, xs in by.items() for r, x in enumerate(sorted(xs)[:n])}


@pytest.mark.parametrize("n", [1, 3])
def test_against_brute_force_with_a_hot_group(spark, n):
    rng = random.Random(n)
    rows = [("hot" if rng.random() < 0.35 else f"g{rng.randrange(60)}", rng.choice([0.5, 0.5, 0.7, round(rng.random(), 2)]), rng.choice([None, 0, 1, 2]), k, "x") for k in range(4000)]
    rows += [("g0", None, 0, 9001, "x"), ("g0", float("nan"), 0, 9002, "x"), (None, 1.0, 0, 9003, "x"), ("g0", 1.0, 0, None, "x")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = topn.top_n(df, F.col("grp0"), n, F.col("score"), F.col("tie"), F.col("key"), "key")
    assert {(r["grp"], r["rank"], r["key"]) for r in got.collect()} == brute(rows, n)


def test_bounds_drop_most_rows_of_a_hot_group(spark):
    df = spark.range(20_000).select(F.lit("g").alias("grp"), (-F.rand(1)).alias("o1"), F.lit(0).cast("long").alias("o2"), F.col("id").alias("o3")).repartition(4).cache()
    left = topn.survivors(df, 3)
    assert 3 <= left.count() <= 12 and {r["o3"] for r in df.orderBy("o1").limit(3).collect()} <= {r["o3"] for r in left.collect()}
    df.unpersist()


def test_empty(spark):
    assert topn.top_n(spark.createDataFrame([], SCHEMA), F.col("grp0"), 3, F.col("score"), F.col("tie"), F.col("key"), "key").count() == 0


def test_bounds_of_many_groups_drop_rows(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(f"g{rng.randrange(20_000)}" if k % 3 else "hot", rng.random(), k) for k in range(240_000)]
    df = spark.createDataFrame(rows, "grp string, score double, key long").repartition(3, "key")
    held = df.selectExpr("grp", "-score AS o1", "0L AS o2", "key AS o3")
    left, local = topn.survivors(held, 2), topn.local_best(held, 2)
    assert local.where("place = 2").select("grp").distinct().count() > 15_000
    assert left.count() < 0.6 * local.count() and left.where("grp = 'hot'").count() <= 3 * 2
    want = {(r["grp"], r["o3"]) for r in topn.top_n(df, F.col("grp"), 2, F.col("score"), F.lit(0), F.col("key"), "key").selectExpr("grp", "key AS o3").collect()}
    best = {}
    for g, s, k in rows:
        best.setdefault(g, []).append((-s, k))
    assert want == {(g, k) for g, x in best.items() for _, k in sorted(x)[:2]}
    monkeypatch.setattr(topn, "BROADCAST", 10)  # the join by a shuffle
    assert {(r["grp"], r["o3"]) for r in topn.survivors(held, 2).select("grp", "o3").collect()} == {(r["grp"], r["o3"]) for r in left.collect()}
