from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest

from lodestone.llm import buckets


def everything():
    def match(table):  # an inner function is sent to the tasks by value
        yield from buckets.offsets(buckets.run_ends(table["key"].to_numpy()), np.ones(table.num_rows, bool))

    return match


@pytest.mark.parametrize("cap", [4, 4096])
def test_all_pairs_of_a_bucket_even_of_a_hot_one(spark, cap):
    # Key 7 holds a third of all rows and is cut into blocks.
    rows = [(7, r) for r in range(60)] + [(100 + r // 3, r) for r in range(60, 180)]
    df = spark.createDataFrame(rows, "key long, rid long")
    got = {tuple(r) for r in buckets.pair_rows(buckets.split_hot(df, len(rows), cap), [], everything()).collect()}
    by = {}
    for key, rid in rows:
        by.setdefault(key, []).append(rid)
    assert got == {p for rids in by.values() for p in combinations(sorted(rids), 2)}


def test_empty(spark):
    df = spark.createDataFrame([], "key long, rid long")
    assert buckets.pair_rows(buckets.split_hot(df, 0), [], everything()).count() == 0


def test_runs_cross_batches():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"key": k}) for k in ([1, 1, 2], [2, 2], [3], [], [3, 4])]
    batches[3] = pa.RecordBatch.from_arrays([pa.array([], pa.int64())], ["key"])
    assert [t["key"].to_pylist() for t in buckets.complete_runs(iter(batches), 3)] == [[1, 1], [2, 2, 2], [3, 3], [4]]
