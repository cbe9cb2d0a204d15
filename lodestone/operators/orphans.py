"""References to records that do not exist (problem 2).

Keyed state, kept incrementally as logs in the shared folder; a step appends to them and rewrites nothing:

* ``refs``: the references seen, for parents that turn out later to have ended earlier,
* ``found``: verdicts, a reference that found no parent at its time, or that has one after all; the
  latest verdict of a reference counts,
* ``events``: the beginnings and ends of parents' periods.

:func:`advance` takes the state a step further. New references probe the parents of their own key and time, so it does not
matter if they load late. Events that lie before references of earlier steps reopen the cases of their keys: a parent that
arrives late resolves waiting orphans, an end that arrives late makes orphans of references that had a
parent. Which orphans still wait at the end of what was seen is ``is_open``: an arriving parent resolves them, the end of the last
live period reopens them.

Each event falls into a period (a month, say). Within a key the periods are chained by their opening balances, and
a reference is joined to those by key *and* period, so a key that holds a third of all rows is spread over as many tasks as
it has periods, and adaptive execution splits what is still skewed. Only counts per key and period are chained by a
window.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.scratch import discard, materialise

REF = ("ref_table", "ref_id", "key", "at")
REFS = "ref_table string, ref_id long, key string, at timestamp"
EVENTS = "key string, at timestamp, step int, other timestamp"
FOUND = REFS + ", orphan boolean, version int"


def parent_events(parents: DataFrame, key: Column, starts: Column, ends: Column) -> DataFrame:
    """``(key, at, step, other)``: +1 where a parent's period begins, -1 where it ends, with the period's other end.

    Repeated rows count once. A period without a beginning, or that ends when or before it
    begins, never holds and gives no event.
    """
    held = parents.select(key.alias("key"), starts.alias("starts"), ends.alias("ends")).distinct()
    held = held.where(F.col("key").isNotNull() & F.col("starts").isNotNull() & (F.col("ends").isNull() | (F.col("ends") > F.col("starts"))))
    begin = F.struct(F.col("starts").alias("at"), F.lit(1).alias("step"), F.col("ends").alias("other"))
    end = F.struct(F.col("ends").alias("at"), F.lit(-1).alias("step"), F.col("starts").alias("other"))
    return held.select("key", F.explode(F.array(begin, end)).alias("e")).where("e.at is not null").select("key", "e.at", "e.step", "e.other")


@dataclass
class OrphanState:
    """What is known after the steps made so far; the tables of the logs are in the shared folder."""

    spark: SparkSession
    refs: list[DataFrame] = field(default_factory=list)
    found: list[DataFrame] = field(default_factory=list)
    events: list[DataFrame] = field(default_factory=list)
    last: datetime | None = None  # time of the latest reference
    version: int = 0

    @classmethod
    def empty(cls, spark: SparkSession) -> OrphanState:
        return cls(spark)

    def _log(self, tables: list[DataFrame], schema: str) -> DataFrame:
        return reduce(DataFrame.unionByName, tables) if tables else self.spark.createDataFrame([], schema)

    @property
    def all_events(self) -> DataFrame:
        """Every event once, however often it was delivered."""
        return self._log(self.events, EVENTS).distinct()

    @property
    def live(self) -> DataFrame:
        """``(key, n_live)``: periods of parents that are open at the end."""
        return self.all_events.groupBy("key").agg(F.sum("step").alias("n_live")).where("n_live > 0")

    @property
    def verdicts(self) -> DataFrame:
        """``(ref_table, ref_id, key, at)`` of the orphans."""
        log = self._log(self.found, FOUND)
        return log.groupBy(*REF).agg(F.max_by("orphan", "version").alias("orphan")).where("orphan").select(*REF)

    @property
    def orphans(self) -> DataFrame:
        """``(ref_table, ref_id, key, at, is_open)`` of the orphans."""
        has = self.live.select("key", F.lit(True).alias("has"))
        return self.verdicts.join(has, "key", "left").select(*REF, F.col("has").isNull().alias("is_open"))


def _snapshots(asked: DataFrame, events: DataFrame, period: str) -> DataFrame:
    """``(key, period, opening, changes)`` of each ``asked(key, period)``."""
    # Events of one instant are one change, so that copies of a parent do not lengthen the list.
    moved = events.groupBy("key", F.date_trunc(period, "at").alias("period"), "at").agg(F.sum("step").alias("step"))
    moved = moved.groupBy("key", "period").agg(F.sum("step").alias("net"), F.collect_list(F.struct("at", "step")).alias("changes"))
    # References count once per key and period here, whatever their number.
    rows = moved.unionByName(asked.distinct().withColumn("net", F.lit(0).cast("long")), True)
    rows = rows.groupBy("key", "period").agg(F.sum("net").alias("net"), F.max("changes").alias("changes"))
    before = W.partitionBy("key").orderBy("period").rowsBetween(W.unboundedPreceding, -1)
    return rows.select("key", "period", "changes", F.coalesce(F.sum("net").over(before), F.lit(0)).alias("opening"))


def without_parent(refs: DataFrame, events: DataFrame, period: str) -> DataFrame:
    """The references whose key has no live parent at their time.

    A parent that begins at the very instant counts, one that ends then does not.
    """
    placed = refs.withColumn("period", F.date_trunc(period, "at"))
    found = placed.join(_snapshots(placed.select("key", "period"), events, period), ["key", "period"], "left")
    passed = F.filter("changes", lambda c: c["at"] <= F.col("at"))
    balance = F.coalesce("opening", F.lit(0)) + F.coalesce(F.aggregate(passed, F.lit(0).cast("long"), lambda s, c: s + c["step"]), F.lit(0))
    return found.where(balance <= 0).select(*refs.columns)


def advance(state: OrphanState, refs: DataFrame, events: DataFrame, period: str = "month", stored: bool = False) -> OrphanState:
    """The state after ``refs(ref_table, ref_id, key, at)`` and the ``events`` of :func:`parent_events`; runs jobs.

    Either may come in any order of their times, and again: any number of steps over split input gives the state of one
    step over all. Repeated references count once; those without key or time take no part. Only keys of the step's input are
    looked at. ``stored`` says that ``refs`` is a table that stays, so that it is not written once more.
    """
    version = state.version + 1
    refs = refs.select(*REF).where(F.col("key").isNotNull() & F.col("at").isNotNull())
    refs = refs if stored else materialise(refs.distinct(), "refs")
    events = materialise(events.select("key", "at", "step", "other").distinct(), "events")
    known = state._log([*state.events, events], EVENTS).distinct() if state.events else events
    verdict = lambda rows, orphan: rows.select(*REF, F.lit(orphan).alias("orphan"), F.lit(version).alias("version"))
    found = [verdict(without_parent(refs, known, period), True)]
    first = events.agg(F.min("at")).first()[0]
    if first is not None and state.last is not None and first <= state.last:
        since = events.groupBy("key").agg(F.min("at").alias("since"))
        again = lambda rows: rows.join(since, "key").where(F.col("at") >= F.col("since")).select(*REF)
        wrong = materialise(without_parent(again(state._log(state.refs, REFS).where(F.col("at") >= F.lit(first))), known, period), "again")
        found += [verdict(wrong, True), verdict(again(state.verdicts).join(wrong, list(REF), "left_anti"), False)]
    log = materialise(reduce(DataFrame.unionByName, found), "found")
    if len(found) > 1:
        discard(wrong)
    last = max((t for t in (state.last, refs.agg(F.max("at")).first()[0]) if t is not None), default=None)
    return OrphanState(state.spark, [*state.refs, refs], [*state.found, log], [*state.events, events], last, version)


def compacted(state: OrphanState) -> OrphanState:
    """The same state with one table for each log; the tables it replaces are deleted."""
    new = OrphanState(
        state.spark,
        [materialise(state._log(state.refs, REFS).select(*REF).distinct(), "refs")],
        [materialise(state.verdicts.select("*", F.lit(True).alias("orphan"), F.lit(state.version).alias("version")), "found")],
        [materialise(state.all_events, "events")],
        state.last,
        state.version,
    )
    for table in (*state.refs, *state.found, *state.events):
        discard(table)
    return new


def orphan_counts(orphans: DataFrame, live: DataFrame, events: DataFrame, period: str = "month") -> DataFrame:
    """``(ref_table, period, n_orphans, n_open)``: new orphans, and those of all periods so far still without a parent at the period's end.

    Only counts per table, key and period are ordered; ``live`` is the state before the events.
    Periods in which nothing changed have no row.
    """
    when = F.date_trunc(period, "at")
    new = orphans.groupBy("ref_table", "key", when.alias("period")).agg(F.count("*").alias("n"))
    net = events.groupBy("key", when.alias("period")).agg(F.sum("step").alias("net")).unionByName(live.select("key", F.lit(None).cast("timestamp").alias("period"), F.col("n_live").alias("net")))
    rows = new.unionByName(new.select("ref_table", "key").distinct().join(net, "key"), True)
    rows = rows.groupBy("ref_table", "key", "period").agg(F.sum("n").alias("n"), F.sum("net").alias("net"))
    w = W.partitionBy("ref_table", "key").orderBy(F.col("period").asc_nulls_first())
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("open", F.when(F.coalesce(F.sum("net").over(so_far), F.lit(0)) == 0, F.coalesce(F.sum("n").over(so_far), F.lit(0))).otherwise(0))
    rows = rows.withColumn("change", F.col("open") - F.coalesce(F.lag("open").over(w), F.lit(0)))
    by = rows.where("period is not null").groupBy("ref_table", "period").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_orphans"), F.sum("change").alias("change"))
    total = F.sum("change").over(W.partitionBy("ref_table").orderBy("period").rowsBetween(W.unboundedPreceding, 0))
    return by.select("ref_table", "period", "n_orphans", total.alias("n_open"))
