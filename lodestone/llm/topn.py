"""Top N items within every group (problem 3).

Partition lower bounds: if a partition holds N rows of a group, its N-th best row bounds the answer
from below, for the group's N best rows of the whole table cannot be worse. One pass over the rows keeps, in each
partition, what its own bounds leave; the best bound of each group is joined to that, drops the rows behind it,
and only the survivors are ranked. Of a group with a third of all rows at most N rows per partition
are left before the join, whatever its size, so no key of the join or of the ranking is hot.

Every group has a bound if some partition holds N of its rows. The bounds are broadcast while they are few, which is
counted; more of them are joined by the shuffle that the ranking needs anyway.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.scratch import materialise

#: Rows held before a partition's rows are cut to the best N of each group.
HELD = 1 << 17
#: Bounds up to this number are broadcast, some 10 MB.
BROADCAST = 100_000
ORDER = ("o1", "o2", "o3")


def _cut(held: list[pa.RecordBatch], n: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """The best ``n`` rows of each group, with their places from 1."""
    table = pa.Table.from_batches(held).combine_chunks()
    code = pc.dictionary_encode(table["grp"]).combine_chunks().indices.to_numpy()
    order = np.lexsort((*(table[c].to_numpy() for c in reversed(ORDER)), code))
    code = code[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    place = np.arange(len(code)) - np.repeat(first, np.diff(np.r_[first, len(code)])) + 1
    kept = place <= n
    return table.take(pa.array(order[kept])).combine_chunks().to_batches()[0], place[kept]


def local_best(rows: DataFrame, n: int) -> DataFrame:
    """``rows(grp, o1, o2, o3, ...)`` without those behind the bound of their own partition, and their ``place`` in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, limit = 0, HELD
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size >= limit:
                held = [_cut(held, n)[0]]
                size = held[0].num_rows
                limit = max(HELD, 2 * size)  # many groups: wait until as many rows again have come
        if size:
            best, place = _cut(held, n)
            yield best.append_column("place", pa.array(place.astype(np.int32)))

    return rows.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", place int")


def survivors(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` without those behind the best bound of their group; at most ``n`` rows of a group and partition."""
    local = materialise(local_best(rows, n), "best")
    bounds = materialise(local.where(F.col("place") == n).groupBy("grp").agg(F.min(F.struct(*ORDER)).alias("bound")), "bounds")
    few = bounds.count() <= BROADCAST
    joined = local.join(F.broadcast(bounds) if few else bounds.hint("merge"), "grp", "left")
    return joined.where(F.col("bound").isNull() | (F.struct(*ORDER) <= F.col("bound"))).drop("bound", "place")


def top_n(rows: DataFrame, group: Column, n: int, score: Column, ties: Column, key: Column, *keep: str) -> DataFrame:
    """The ``n`` rows of each group with the highest score, with ``grp``, ``rank`` and the ``keep`` columns.

    Equal scores rank by smaller ``ties`` (null counts as 0), then by smaller ``key``, so the order is the same
    on every run if ``key`` is unique. Rows whose group, key or score is null, or whose score is NaN, take
    no part. A group with fewer rows gives them all. ``ties`` and ``key`` must be numbers.
    """
    held = rows.select(group.cast("string").alias("grp"), (-score.cast("double")).alias("o1"), F.coalesce(ties.cast("long"), F.lit(0)).alias("o2"), key.cast("long").alias("o3"), *[F.col(c).alias(f"kept_{c}") for c in keep])
    held = held.where(F.col("grp").isNotNull() & F.col("o1").isNotNull() & ~F.isnan("o1") & F.col("o3").isNotNull())
    rank = F.row_number().over(W.partitionBy("grp").orderBy(*ORDER))
    return survivors(held, n).withColumn("rank", rank).where(F.col("rank") <= n).select("grp", "rank", *[F.col(f"kept_{c}").alias(c) for c in keep])
