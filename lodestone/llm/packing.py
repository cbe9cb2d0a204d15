"""Filling fixed-capacity containers with items (problem 6).

Linear grouping: the sizes above ``small`` of the capacity are cut into groups of equally many items and rounded
up to their group's largest. For so few sizes the best mixture of container fillings is found by column
generation (a linear program whose columns are knapsack fillings) and taken in whole numbers of
containers. The slots are then filled with actual sizes, so what rounding wasted is free again, and all that is
left over, the small sizes with it, goes, largest first, to the container where it fits best. At last containers with more
room than a few tokens are taken apart and their items placed so once more, if that saves containers.

Sizes are whole numbers up to the capacity, so the plan needs only the number of items of each size: the
driver handles at most ``capacity`` numbers whatever the input, and containers of equal content stay one row with a
multiplicity. The items find their container by their rank within their size; ranks are made within
hashed buckets of a size, so a size that a third of all items share is spread over many tasks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm import tokens
from lodestone.scratch import materialise, spread

GROUPS = 256
#: Shares of the capacity up to which a size counts as small; a plan is made with each, the better one counts.
SMALL = (0.25, 0.4)
#: Containers with more room than that are taken apart; each is tried, from the finished plan, and the best result kept.
ROOMS = (0, 1, 4, 16, 64, 256)
#: Items of one size in a bucket, about.
BUCKET = 50_000


@dataclass
class Plan:
    """Kinds of containers: how many of each, and how many items of each size one holds."""

    capacity: int
    kinds: list[tuple[int, dict[int, int]]] = field(default_factory=list)

    @property
    def containers(self) -> int:
        return sum(n for n, _ in self.kinds)

    @property
    def unused(self) -> float:
        """The share of the containers' room that stays empty."""
        filled = sum(n * sum(s * m for s, m in kind.items()) for n, kind in self.kinds)
        return 1 - filled / (self.containers * self.capacity) if self.kinds else 0.0


def linear_groups(large: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """Runs ``(size, n)``, sizes falling, cut into at most ``groups`` lists of equally many items; few sizes are groups of their own."""
    if len(large) <= groups:
        return [[run] for run in large]
    share = max(1, -(-sum(n for _, n in large) // groups))
    out: list[list[tuple[int, int]]] = []
    room = 0
    for size, n in large:
        while n:
            if not room:
                out.append([])
                room = share
            took = min(n, room)
            out[-1].append((size, took))
            n, room = n - took, room - took
    return out


def best_filling(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The filling of one container with the greatest worth, sizes may repeat."""
    value = np.zeros(capacity + 1)
    steps: list[np.ndarray] = []
    for _ in range(capacity // int(sizes.min())):
        grown = np.tile(value, (len(sizes), 1))
        for g, s in enumerate(sizes):
            grown[g, s:] = value[:-s] + worth[g]
        took = grown.argmax(0)
        new = grown[took, np.arange(capacity + 1)]
        better = new > value + 1e-12
        if not better.any():
            break
        steps.append(np.where(better, took, -1))
        value = np.where(better, new, value)
    counts, room = np.zeros(len(sizes), int), capacity
    for step in reversed(steps):
        g = step[room]
        if g >= 0:
            counts[g] += 1
            room -= sizes[g]
    return float(value[capacity]), counts


def few_size_mixture(sizes: np.ndarray, demand: np.ndarray, capacity: int, most: int = 400) -> list[tuple[float, np.ndarray]]:
    """``(amount, filling)``: a mixture of fillings with the least amount in all that meets the demand, by the revised simplex."""
    basis = np.diag(capacity // sizes).astype(float)
    amount = demand / np.diag(basis)
    for _ in range(most):
        duals = np.linalg.solve(basis.T, np.ones(len(sizes)))
        value, column = best_filling(sizes, np.maximum(duals, 0), capacity)
        if value <= 1 + 1e-7:
            break
        along = np.linalg.solve(basis, column.astype(float))
        ratio = np.where(along > 1e-9, amount / np.where(along > 1e-9, along, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        amount = np.maximum(amount - step * along, 0)
        amount[out] = step
        basis[:, out] = column
    return [(a, basis[:, k].round().astype(int)) for k, a in enumerate(amount)]


def plan_containers(counts: dict[int, int], capacity: int, groups: int = GROUPS, small: tuple[float, ...] = SMALL) -> Plan:
    """Containers for ``counts[size]`` items of each size from 1 to the capacity."""
    if any(not 0 < s <= capacity for s in counts):
        raise ValueError("sizes must lie between 1 and the capacity")
    plans = [_plan({s: n for s, n in counts.items() if n}, capacity, groups, share) for share in small]
    return min([p for plan in plans for p in (plan, *(_again(plan, room) for room in ROOMS))], key=lambda p: p.containers)


def _plan(counts: dict[int, int], capacity: int, groups: int, small: float) -> Plan:
    left = defaultdict(int, counts)
    large = [(s, left[s]) for s in sorted(left, reverse=True) if s > capacity * small]
    kinds: list[tuple[int, dict[int, int]]] = []
    if large:
        runs = linear_groups(large, groups)
        sizes, demand = np.array([g[0][0] for g in runs]), np.array([sum(n for _, n in g) for g in runs])
        for amount, filling in few_size_mixture(sizes, demand, capacity):
            _substitute(int(amount + 1e-6), filling, runs, left, kinds)
    return Plan(capacity, _best_fit(kinds, left, capacity))


def _again(plan: Plan, most_room: int) -> Plan:
    """The plan with the items of containers with more than ``most_room`` placed once more by best fit."""
    kept: list[tuple[int, dict[int, int]]] = []
    loose: dict[int, int] = defaultdict(int)
    for n, kind in plan.kinds:
        if plan.capacity - sum(s * m for s, m in kind.items()) <= most_room:
            kept.append((n, kind))
        else:
            for s, m in kind.items():
                loose[s] += n * m
    return Plan(plan.capacity, _best_fit(kept, loose, plan.capacity))


def _substitute(wanted: int, filling: np.ndarray, runs: list[list[tuple[int, int]]], left: dict[int, int], kinds: list) -> None:
    """Fill the slots of ``wanted`` containers with actual sizes of their groups, the largest first."""
    slots = [(runs[g], int(m)) for g, m in enumerate(filling) if m]
    while wanted:
        whole = [run[-1][1] // m if run else wanted for run, m in slots]
        n = min(wanted, *whole) if whole else 0
        kind: dict[int, int] = defaultdict(int)
        for run, m in slots:
            for _ in range(m if not n else 1):
                if not run:
                    continue
                size, have = run[-1]
                take = m * n if n else 1
                kind[size] += m if n else 1
                left[size] -= take
                run.pop()
                if have > take:
                    run.append((size, have - take))
        if not kind:
            return
        kinds.append((n or 1, dict(kind)))
        wanted -= n or 1


def _best_fit(kinds: list[tuple[int, dict[int, int]]], left: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    by_room: list[list[tuple[int, dict[int, int]]]] = [[] for _ in range(capacity + 1)]
    for n, kind in kinds:
        by_room[capacity - sum(s * m for s, m in kind.items())].append((n, kind))
    for size in sorted((s for s, n in left.items() if n > 0), reverse=True):
        n, room = left[size], size
        while n:
            while room <= capacity and not by_room[room]:
                room += 1
            if room > capacity:
                each = capacity // size
                if n >= each:
                    by_room[capacity - each * size].append((n // each, {size: each}))
                if n % each:
                    by_room[capacity - n % each * size].append((1, {size: n % each}))
                break
            many, kind = by_room[room].pop()
            took = min(n, many)
            if many > took:
                by_room[room].append((many - took, kind))
            by_room[room - size].append((took, kind | {size: kind.get(size, 0) + 1}))
            n -= took
            room = size if room - size >= size else room
    return [k for kinds_of_room in by_room for k in kinds_of_room]


class Placement:
    """Finds the container of the item of a size with a rank among the items of that size, from 0."""

    def __init__(self, plan: Plan):
        rows, used, first = [], defaultdict(int), 0
        for n, kind in plan.kinds:
            for size, m in kind.items():
                rows.append((size, used[size], first, m))
                used[size] += n * m
            first += n
        table = np.array(sorted(rows), np.int64).reshape(-1, 4)
        self.key, self.rank, self.first, self.each = (table[:, 0] << 44) + table[:, 1], table[:, 1], table[:, 2], table[:, 3]

    def __call__(self, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.key, (size.astype(np.int64) << 44) + rank, "right") - 1
        return self.first[at] + (rank - self.rank[at]) // self.each[at]


def token_counts(rows: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [tokens.count(t, vocabulary) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(n, pa.int64())], ["key", "n_tokens"])

    wide = rows.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key is not null and text is not null")
    return spread(wide).mapInArrow(run, f"key {dict(rows.dtypes)[key]}, n_tokens long")


def pack(rows: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 2048, vocabulary: str | None = None, groups: int = GROUPS, small: tuple[float, ...] = SMALL) -> DataFrame:
    """``(key, piece, n_tokens, container_id)``: the container of every text, sizes in tokens of ``vocabulary``. ``rows`` is a scan.

    A text above the capacity is cut into pieces of ``capacity`` tokens and a rest, numbered from 0; others
    are piece 0. Containers are numbered from 0, and none holds more than ``capacity`` tokens. Texts without a token take no
    room and are spread over all containers (all in 0 if nothing else exists). Null texts and rows without
    key are left out; a key given twice is two items.
    """
    vocabulary = vocabulary or tokens.default_vocabulary()
    sized = materialise(token_counts(rows, key, text, vocabulary), "tokens")
    pieces = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_tokens") / capacity) - 1, F.lit(0)).cast("int"))
    items = sized.select("key", "n_tokens", F.explode(pieces).alias("piece"))
    items = items.select("key", "piece", F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - F.col("piece") * capacity).alias("size"))
    counts = {r["size"]: r["n"] for r in items.where("size > 0").groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    plan = plan_containers(counts, capacity, groups, small)
    placed = rows.sparkSession.sparkContext.broadcast(Placement(plan))

    buckets = max(16, sum(counts.values()) // BUCKET)
    items = items.withColumn("bucket", F.when(F.col("size") > 0, F.pmod(F.xxhash64("key", "piece"), F.lit(buckets))))
    offset = items.where("size > 0").groupBy("size", "bucket").agg(F.count("*").alias("n"))
    before = W.partitionBy("size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offset = offset.select("size", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = items.where("size > 0").withColumn("place", F.row_number().over(W.partitionBy("size", "bucket").orderBy("key", "piece")))
    ranked = ranked.join(offset, ["size", "bucket"]).select("key", "piece", "size", (F.col("before") + F.col("place") - 1).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = placed.value(batch["size"].to_numpy(), batch["rank"].to_numpy()) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch["key"], batch["piece"], batch["size"], pa.array(where)], ["key", "piece", "n_tokens", "container_id"])

    full = ranked.mapInArrow(run, f"key {dict(items.dtypes)['key']}, piece int, n_tokens long, container_id long")
    void = items.where("size = 0").select("key", "piece", F.col("size").alias("n_tokens"), F.pmod(F.xxhash64("key"), F.lit(max(1, plan.containers))).alias("container_id"))
    return full.unionByName(void).withColumnRenamed("key", key)
