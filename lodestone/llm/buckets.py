"""Pairs of rows that fall into one bucket, for hash-based candidate search.

Rows ``(key, rid, ...)`` are shuffled by ``key`` and sorted, and the pairs of each run of equal keys
are enumerated by NumPy inside the task, where a test on a short sketch drops nearly all of them;
only what passes leaves the task. A bucket above ``cap`` rows is cut into blocks and each pair of
blocks becomes a bucket of its own, so no task holds more than two blocks of one bucket and
still every pair is tested.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a bucket that one block holds.
CAP = 4096
#: Buckets counted together when hot ones are looked for; an upper bound is enough there.
SLOTS_PER_ROW = 16
#: More hot slots than this are joined by a shuffle.
BROADCAST_SLOTS = 200_000


def split_hot(rows: DataFrame, n_rows: int, cap: int = CAP) -> DataFrame:
    """``rows`` with the key of hot buckets replaced by one key for each pair of blocks.

    ``n_rows`` (about the number of rows) sets how finely buckets are counted.
    """
    slots = 1 << max(16, (max(n_rows, 1) // SLOTS_PER_ROW).bit_length())
    slot = F.pmod(F.col("key"), F.lit(slots))
    hot = rows.groupBy(slot.alias("slot")).agg(F.count("*").alias("n")).where(F.col("n") > cap)
    hot = hot.select("slot", F.ceil(F.col("n") / cap).cast("int").alias("blocks"))
    few = hot.limit(BROADCAST_SLOTS + 1).collect()  # bounded by the limit
    if not few:
        return rows
    if len(few) <= BROADCAST_SLOTS:
        hot = F.broadcast(rows.sparkSession.createDataFrame(few, hot.schema))
    own = F.pmod(F.col("rid"), F.col("blocks")).cast("int")
    joined = rows.withColumn("slot", slot).join(hot, "slot", "left")
    other = F.explode(F.coalesce(F.sequence(F.lit(0), F.col("blocks") - 1), F.array(F.lit(-1))))
    wide = joined.withColumn("own", own).withColumn("other", other)
    key = F.when(F.col("other") < 0, F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    return wide.select(key.alias("key"), *[c for c in rows.columns if c != "key"])


def complete_runs(batches: Iterator[pa.RecordBatch], least: int = 1 << 16) -> Iterator[pa.Table]:
    """Tables of about ``least`` rows that end where the key changes; the input is sorted by key."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        key = table["key"].to_numpy()
        cut = int(np.searchsorted(key, key[-1], "left"))
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
            n -= cut
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def run_ends(key: np.ndarray) -> np.ndarray:
    """For each row the index after the last row of its run of equal keys."""
    last = np.flatnonzero(np.r_[key[1:] != key[:-1], True])
    return np.repeat(last + 1, np.diff(np.r_[0, last + 1]))


def offsets(ends: np.ndarray, active: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), j > i of one run, for every i that is active; a constant j - i at a time."""
    i = np.flatnonzero(active)
    step = 1
    i = i[i + step < ends[i]]
    while i.size:
        yield i, i + step
        step += 1
        i = i[i + step < ends[i]]


def pair_rows(rows: DataFrame, order: list[str], match: Callable[[pa.Table], Iterator[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """Distinct ``(a, b)``, a < b, of the pairs of ``rid`` that ``match`` gives for runs of equal keys."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in complete_runs(batches):
            rid = table["rid"].to_numpy()
            for i, j in match(table):
                if i.size:
                    a, b = np.minimum(rid[i], rid[j]), np.maximum(rid[i], rid[j])
                    real = a != b
                    yield pa.RecordBatch.from_arrays([pa.array(a[real]), pa.array(b[real])], ["a", "b"])

    ordered = rows.repartition(F.col("key")).sortWithinPartitions("key", *order)
    return ordered.mapInArrow(search, "a long, b long").distinct()


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))
