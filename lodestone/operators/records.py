"""Deliveries: which of a record's rows counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.scratch import materialise, remembered, spread, state_of

#: Share of records delivered once that are taken for records delivered again; they are looked at, not lost.
FALSE_ALARMS = 0.03


def latest(df: DataFrame, key: str, loaded: str, *columns: str, costly: bool = False) -> DataFrame:
    """One row per ``key``, the one with the latest ``loaded``, with ``columns`` only. ``df`` is best a scan; if ``costly`` work
    in Python follows, one of few partitions is dealt out to all cores.

    A later row counts even if it is emptier. A null ``loaded`` is earlier than any other. Rows
    of one instant that differ are ordered by ``columns``, so that every run picks the same one.
    Rows whose key is null name no record and are left out.

    Few records are delivered again, so the table is not shuffled for them: the keys alone are counted, those that come more than
    once make up a Bloom filter (8 MB at most, whatever the table), rows that it passes over are a record each, and only
    the others are grouped. A filter that is too small for its keys sends more rows there, never fewer.
    """
    rest = [c for c in columns if c not in (key, loaded)]
    rows = df.where(F.col(key).isNotNull()).select(*dict.fromkeys([key, loaded, *rest]))
    again = _delivered_again(rows.select(key))
    once = rows.select(*columns) if again is None else rows.where(~again).select(*columns)
    once = spread(once) if costly else once
    if again is None:
        return once
    picked = rows.where(again).groupBy(F.col(key)).agg(F.max(F.struct(F.col(loaded), *[F.col(c) for c in rest])).alias("row"))
    picked = picked.select(key, *[F.col("row")[c].alias(c) for c in columns if c != key]).select(*columns)
    return once.unionByName(picked)


def _delivered_again(keys: DataFrame) -> Column | None:
    """Whether a row's key may occur more than once; None if none does."""
    name = keys.columns[0]
    return _may_hold(keys, name, remembered(state_of(keys), "delivered again", lambda: _filter(keys, name)))


def _filter(keys: DataFrame, name: str) -> bytes | None:
    found = materialise(keys.groupBy(name).agg(F.count("*").alias("n")).where("n > 1").select(F.xxhash64(name).alias("h")), "again")
    n = found.count()
    if not n:
        return None
    stream = keys.sparkSession._jvm.java.io.ByteArrayOutputStream()
    found._jdf.stat().bloomFilter("h", max(n, 1000), FALSE_ALARMS).writeTo(stream)
    return bytes(stream.toByteArray())


def _may_hold(keys: DataFrame, name: str, raw: bytes | None) -> Column | None:
    """The filter as an expression, which Spark has for its own joins but not among its functions."""
    if raw is None:
        return None
    from pyspark.sql.classic.column import Column as JvmColumn

    sql = keys.sparkSession._jvm.org.apache.spark.sql
    tree = lambda c: sql.classic.ExpressionUtils.expression(c._jc)
    test = sql.catalyst.expressions.BloomFilterMightContain(tree(F.lit(bytearray(raw))), tree(F.xxhash64(name)))
    return F.coalesce(JvmColumn(sql.classic.ExpressionUtils.column(test)), F.lit(True))

