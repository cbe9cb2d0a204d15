from __future__ import annotations

import random
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from lodestone.operators.orphans import OrphanState, advance, orphan_counts, parent_events
from lodestone.operators.records import latest
from lodestone.streaming.orphans import OrphanTracker

START = datetime(2024, 1, 1)
PARENTS = "k string, a timestamp, b timestamp, k2 string"
REFS = "ref_table string, ref_id long, key string, at timestamp, extra string"


def day(n: float) -> datetime:
    return START + timedelta(days=n)


def made(spark, parents, refs):
    p = spark.createDataFrame([(*x, "z") for x in parents], PARENTS)
    return parent_events(p, F.col("k"), F.col("a"), F.col("b")), spark.createDataFrame([(*x, "z") for x in refs], REFS)


def brute(parents, refs):
    return {(t, i, k) for t, i, k, at in refs if k is not None and at is not None and not any(p == k and a is not None and a <= at and (b is None or b > at) for p, a, b in parents)}


def keys(df):
    return {(r["ref_table"], r["ref_id"], r["key"]) for r in df.collect()}


def test_edges_of_periods(spark):
    parents = [("a", day(1), day(5)), ("a", day(9), None), ("b", day(5), day(2)), ("c", None, day(9)), (None, day(0), None)]
    refs = [("t", 1, "a", day(0)), ("t", 2, "a", day(1)), ("t", 3, "a", day(5)), ("t", 4, "a", day(9)), ("t", 5, "b", day(3)), ("t", 6, "c", day(3)), ("t", 7, None, day(3)), ("t", 8, "a", None), ("t", 9, "zz", day(3)), ("t", 9, "zz", day(3))]
    events, rows = made(spark, parents, refs)
    got = advance(OrphanState.empty(spark), rows, events).orphans
    assert keys(got) == brute(parents, refs) == {("t", 1, "a"), ("t", 3, "a"), ("t", 5, "b"), ("t", 6, "c"), ("t", 9, "zz")}
    assert got.count() == 5
    assert {r["ref_id"]: r["is_open"] for r in got.collect()} == {1: False, 3: False, 5: True, 6: True, 9: True}


def test_random_against_brute_force_whole_and_in_steps(spark):
    rng = random.Random(3)
    # Key "hot" holds a third of all rows.
    key = lambda: "hot" if rng.random() < 0.35 else f"k{rng.randrange(12)}"
    parents = [(key(), day(rng.randrange(200)), None if rng.random() < 0.3 else day(rng.randrange(240))) for _ in range(60)]
    parents += parents[:5]
    refs = [(f"t{rng.randrange(2)}", i, key(), day(rng.randrange(220))) for i in range(600)]
    events, rows = made(spark, parents, refs)
    once = advance(OrphanState.empty(spark), rows, events)
    want = brute(parents, refs)
    assert keys(once.orphans) == want

    tracker = OrphanTracker(OrphanState.empty(spark))
    for a, b in ((-1, 60.5), (60.5, 61), (61, 400)):
        inside = (F.col("at") > F.lit(day(a))) & (F.col("at") <= F.lit(day(b)))
        tracker.step(rows.where(inside), events.where(inside))
    assert keys(tracker.state.orphans) == want
    assert {tuple(r) for r in tracker.state.orphans.collect()} == {tuple(r) for r in once.orphans.collect()}
    assert {tuple(r) for r in tracker.state.live.collect()} == {tuple(r) for r in once.live.collect()}
    assert sum(r["n_orphans"] for r in tracker.counts().collect()) == len(want)


def test_references_that_load_late(spark):
    parents = [("a", day(1), day(5)), ("a", day(9), None), ("b", day(1), day(20))]
    early = [("t", 1, "a", day(10)), ("t", 2, "c", day(10))]
    late = [("t", 2, "c", day(10)), ("t", 3, "a", day(6)), ("t", 4, "a", day(2)), ("t", 5, "b", day(3)), ("t", 6, "b", day(21))]
    events, rows = made(spark, parents, early)
    tracker = OrphanTracker(OrphanState.empty(spark))
    tracker.step(rows, events)
    none, rows = made(spark, [], late)
    tracker.step(rows, none)
    assert keys(tracker.state.orphans) == brute(parents, early + late) == {("t", 2, "c"), ("t", 3, "a"), ("t", 6, "b")}
    assert {r["ref_id"]: r["is_open"] for r in tracker.state.orphans.collect()} == {2: True, 3: False, 6: True}
    assert tracker.state.orphans.count() == 3


def test_parents_and_ends_that_load_late(spark):
    parents = [("a", day(1), None), ("b", day(2), day(8)), ("c", day(1), None), ("d", day(4), day(6))]
    refs = [("t", 1, "a", day(5)), ("t", 2, "b", day(9)), ("t", 3, "b", day(3)), ("t", 4, "c", day(5)), ("t", 5, "d", day(5)), ("t", 6, "d", day(7)), ("t", 7, "x", day(5))]
    events, rows = made(spark, parents, refs)
    for order in ([("c",), ("a", "b", "d")], [("a", "b", "c", "d"), ()], [("d", "b"), ("b", "a"), ("c",)]):
        tracker = OrphanTracker(OrphanState.empty(spark), compact=2)
        tracker.step(rows, events.limit(0))
        assert len(keys(tracker.state.orphans)) == 7  # no parent yet
        for some in order:
            tracker.step(rows.where("ref_id in (1, 6)"), events.where(F.col("key").isin(*some)))  # references again
        assert keys(tracker.state.orphans) == brute(parents, refs) == {("t", 2, "b"), ("t", 6, "d"), ("t", 7, "x")}
        assert tracker.state.orphans.count() == 3 and tracker.state.verdicts.count() == 3
    tracker = OrphanTracker(OrphanState.empty(spark))
    begins, ends = events.where("step > 0"), events.where("step < 0")
    tracker.step(rows, begins)
    assert keys(tracker.state.orphans) == {("t", 7, "x")}
    tracker.step(rows.limit(0), ends)  # ends of parents that had been found
    tracker.step(rows.limit(0), ends)
    assert keys(tracker.state.orphans) == brute(parents, refs)
    assert {r["ref_id"]: r["is_open"] for r in tracker.state.orphans.collect()} == {2: True, 6: True, 7: True}


def test_the_tables_of_old_states_are_deleted(spark):
    events, rows = made(spark, [("a", day(1), None)], [("t", 1, "b", day(2))])
    tracker = OrphanTracker(OrphanState.empty(spark), compact=3)
    for _ in range(2):
        tracker.step(rows, events)
    old = [f for t in (*tracker.state.refs, *tracker.state.found, *tracker.state.events) for f in t.inputFiles()]
    tracker.step(rows, events)
    assert len(tracker.state.refs) == 1 and keys(tracker.state.orphans) == {("t", 1, "b")}
    assert old and not any(Path(f.removeprefix("file://")).exists() for f in old)


def test_counts_reopen(spark):
    parents = [("a", day(40), day(70))]
    refs = [("t", 1, "a", day(3)), ("t", 2, "a", day(50)), ("t", 3, "x", day(45))]
    events, rows = made(spark, parents, refs)
    state = advance(OrphanState.empty(spark), rows, events)
    got = {r["period"].month: (r["n_orphans"], r["n_open"]) for r in orphan_counts(state.orphans, OrphanState.empty(spark).live, events).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 2)}  # resolved by the arrival in February, open again in March


def test_empty_tables(spark):
    events, rows = made(spark, [], [])
    state = advance(OrphanState.empty(spark), rows, events)
    assert state.orphans.count() == 0 and state.live.count() == 0
    assert orphan_counts(state.orphans, state.live, events).count() == 0


def test_latest_delivery(spark):
    rows = spark.createDataFrame([(1, "old", day(1), "x"), (1, None, day(2), "y"), (2, "one", None, "x"), (2, "one", None, "x"), (None, "no", day(1), "x")], "id long, v string, loaded timestamp, extra string")
    assert {tuple(r) for r in latest(rows, "id", "loaded", "id", "v").collect()} == {(1, None), (2, "one")}


def test_latest_of_a_table_with_few_and_with_many_repeats(spark, tmp_path):
    rows = [(k, f"v{k}", day(k % 9), "x") for k in range(3000)] + [(k, f"w{k}", day(20 + k % 3), "x") for k in range(0, 3000, 50)] + [(7, "v7", day(7), "x")]
    df = spark.createDataFrame(rows, "id long, v string, loaded timestamp, row string")
    df.write.parquet(f"{tmp_path}/t")
    for table in (df, spark.read.parquet(f"{tmp_path}/t"), spark.read.parquet(f"{tmp_path}/t")):
        got = {r["id"]: r["v"] for r in latest(table, "id", "loaded", "id", "v").collect()}
        assert got == {k: f"w{k}" if k % 50 == 0 else f"v{k}" for k in range(3000)}
        assert latest(table, "id", "loaded", "v", "id", "row").columns == ["v", "id", "row"] and latest(table, "id", "loaded", "id").count() == 3000
    df.limit(10).write.mode("overwrite").parquet(f"{tmp_path}/t")  # other files: nothing known holds
    assert latest(spark.read.parquet(f"{tmp_path}/t"), "id", "loaded", "id").count() == 10
    every = df.unionByName(df.withColumn("v", F.upper("v")))
    assert latest(every, "id", "loaded", "id", "v").count() == 3000
