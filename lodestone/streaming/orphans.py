"""Orphan references of streams: the keyed state of ``operators.orphans``, carried from batch to batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.orphans import OrphanState, advance, compacted

#: Steps after which the logs of the state are put together.
COMPACT = 8


class OrphanTracker:
    """Holds the state and takes it further with each step, whose references and events may come late or again.

    Every ``compact`` steps the tables of the state are put together and the old ones deleted. ``counts`` gives the snapshot after a step.
    """

    def __init__(self, state: OrphanState, period: str = "month", compact: int = COMPACT):
        self.state, self.period, self.compact = state, period, compact

    def step(self, refs: DataFrame, events: DataFrame) -> OrphanState:
        self.state = advance(self.state, refs, events, self.period)
        if self.state.version % self.compact == 0:
            self.state = compacted(self.state)
        return self.state

    def counts(self) -> DataFrame:
        """``(ref_table, n_orphans, n_open)`` of all references so far."""
        return self.state.orphans.groupBy("ref_table").agg(F.count("*").alias("n_orphans"), F.count_if("is_open").alias("n_open"))
