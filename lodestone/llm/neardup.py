"""Near-duplicate records with small edits (problem 4).

Each text is the set of its word shingles. A sketch of MinHash symbols turns Jaccard similarity into
Hamming distance: at similarity s a symbol agrees with probability s. The bits of one symbol
agree or differ together, so a symbol is never cut: ``parts`` partitions of four symbols each make up
the sketch. The generalised pigeonhole gives every record a threshold for each partition:

* loose - the first three symbols must agree, the fourth may differ,
* strict - all four must agree,
* none - the partition is not probed.

Each choice has a price, the number of rows that would be met (counted over all records in hashed
slots, less what unrelated rows put into a slot on average), and a worth, the logarithm of the chance to miss a pair that is just similar enough.
Dynamic programming takes the cheapest choices whose joint chance to miss stays below ``miss``, so
a record full of common phrases spends its thresholds on its rarer partitions. What the probes find
is tested on 128 sketch bits inside the task and then on the exact shingle sets.

Records with equal sets form a class, of which only one record is searched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.buckets import offsets, pair_rows, popcount, run_ends, split_hot
from lodestone.llm.shingles import mix, overlaps, shingle_sets
from lodestone.scratch import discard, materialise

SEED = 20240811
SYMBOLS = 4
#: Least and most slots in which rows are counted, a power of two. The counts only steer the thresholds, so collisions cost time, not pairs.
LEAST_SLOTS, MOST_SLOTS = 1 << 16, 1 << 21
BLOCKS = 64
BITS = 128
SIGMAS = 4.0
#: Classes up to this size are written out as pairs of their members.
WRITE_OUT = 64
#: Records of a class that one key of a join over its members holds.
SPREAD = 1024
NONE, STRICT, LOOSE = 0, 1, 2
_COUNTS = (2 ** (np.arange(256) / 8)).astype(np.float32)


def sketch(code: np.ndarray, bounds: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and fourth symbols ``(n, parts)``, and ``(n, 2)`` words of sketch bits, of non-empty sets."""
    rng = np.random.default_rng(SEED)
    k = max(parts * SYMBOLS, BITS)
    a = rng.integers(0, 1 << 32, k, dtype=np.uint32) | np.uint32(1)
    b = rng.integers(0, 1 << 32, k, dtype=np.uint32)
    x = (code >> np.uint64(32)).astype(np.uint32)
    starts = bounds[:-1]
    symbols = np.empty((k, len(starts)), np.uint64)
    v = np.empty_like(x)
    for i in range(k):
        np.multiply(x, a[i], out=v)
        np.add(v, b[i], out=v)
        symbols[i] = np.minimum.reduceat(v, starts)
    keys = np.empty((len(starts), parts), np.uint64)
    for p in range(parts):
        three = symbols[p * SYMBOLS : p * SYMBOLS + 3]
        keys[:, p] = mix(mix(mix(three[0] + np.uint64(p + 1)) + three[1]) + three[2])
    fourth = (symbols[SYMBOLS - 1 : parts * SYMBOLS : SYMBOLS].T >> np.uint64(1)).astype(np.int32)
    ones = (mix(symbols[:BITS] + np.uint64(1)) & np.uint64(1)).astype(np.uint8)
    bits = np.ascontiguousarray(np.packbits(ones.T, axis=1, bitorder="little")).view(np.int64)
    return keys, fourth, bits


def allocate(loose: np.ndarray, strict: np.ndarray, similarity: float, miss: float) -> np.ndarray:
    """The thresholds ``(n, parts)`` of least cost; ``loose`` and ``strict`` are the costs of either choice."""
    n, parts = loose.shape
    worth_loose, worth_strict = -math.log(1 - similarity**3), -math.log(1 - similarity**4)
    unit = worth_loose / 7
    give = {LOOSE: 0, STRICT: 7 - int(worth_strict / unit), NONE: 7}
    slack = max(0, 7 * parts - math.ceil(-math.log(miss) / unit))
    best = np.zeros((n, slack + 1), np.float32)
    choice = np.empty((parts, n, slack + 1), np.int8)
    for p in range(parts):
        new, took = best + loose[:, p, None], np.full((n, slack + 1), LOOSE, np.int8)
        for what, cost in ((STRICT, strict[:, p, None]), (NONE, None)):
            g = give[what]
            if g > slack:
                continue
            other = best[:, : slack + 1 - g] + (0 if cost is None else cost)
            better = other < new[:, g:]
            new[:, g:][better] = other[better]
            took[:, g:][better] = what
        best, choice[p] = new, took
    out = np.empty((n, parts), np.int8)
    left, row = np.full(n, slack), np.arange(n)
    gives = np.array([give[NONE], give[STRICT], give[LOOSE]])
    for p in range(parts - 1, -1, -1):
        out[:, p] = choice[p, row, left]
        left = left - gives[out[:, p]]
    return out


def _sketches(rows: DataFrame, size: int, parts: int, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                code, bounds = shingle_sets(part["text"].to_pylist(), size)
                n = np.diff(bounds)
                full = n > 0
                if not full.any():
                    continue
                part, bounds, n = part.filter(pa.array(full)), np.r_[bounds[:-1][full], bounds[-1]], n[full]
                keys, fourth, bits = sketch(code, bounds, parts)
                cls = mix(np.add.reduceat(mix(code), bounds[:-1]) + n.astype(np.uint64))
                steps = np.arange(0, keys.size + 1, parts, dtype=np.int32)
                longs = pa.ListArray.from_arrays(steps, pa.array(keys.ravel().view(np.int64)))
                ints = pa.ListArray.from_arrays(steps, pa.array(fourth.ravel()))
                columns = [part["id"], part["owner"], part["text"], part["rid"], pa.array(cls.view(np.int64)), pa.array(n.astype(np.int32)), longs, ints, pa.array(bits[:, 0]), pa.array(bits[:, 1])]
                yield pa.RecordBatch.from_arrays(columns, ["id", "owner", "text", "rid", "class", "n", "keys", "fourth", "b0", "b1"])

    return rows.mapInArrow(run, f"id {kind}, owner string, text string, rid long, class long, n int, keys array<long>, fourth array<int>, b0 long, b1 long")


def _matrix(column: pa.Array, parts: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, parts)


def slots_for(n: int) -> int:
    """Slots for ``n`` counted rows: one for some twelve, up to a size that can be broadcast."""
    return min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (n // 16).bit_length()))


def _slot(keys: np.ndarray, fourth: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(slots - 1)
    keys = keys.view(np.uint64)
    return (keys & mask).astype(np.int64), (mix(keys + fourth.astype(np.uint64)) & mask).astype(np.int64)


def _counts(base: DataFrame, parts: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows met by each slot, for loose and for strict thresholds, less the mean of all slots: 2 * ``slots`` bytes.

    Every task counts all its rows and passes its counts on in ``BLOCKS`` dense arrays, which are summed by block. Where
    slots are shared by many rows, most counts lie about the mean, and what stands out are frequent keys.
    """
    width = 2 * slots // BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * slots, np.int64)
        for batch in batches:
            if batch.num_rows:
                loose, strict = _slot(_matrix(batch["keys"], parts), _matrix(batch["fourth"], parts), slots)
                which, n = np.unique(np.concatenate([loose.ravel(), strict.ravel() + slots]), return_counts=True)
                total[which] += n
        yield _blocks({b: part for b, part in enumerate(total.reshape(BLOCKS, width)) if part.any()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, raw in zip(batch["block"].to_pylist(), batch["counts"].to_pylist()):
                part = np.frombuffer(raw, np.uint32).astype(np.int64)
                total[b] = total[b] + part if b in total else part
        yield _blocks(total)

    schema = "block int, counts binary"
    summed = base.select("keys", "fourth").mapInArrow(count, schema).repartition("block").mapInArrow(add, schema)
    total = np.zeros((BLOCKS, width), np.int32)
    for row in summed.collect():  # BLOCKS rows of fixed size
        total[row["block"]] = np.minimum(np.frombuffer(row["counts"], np.uint32), 1 << 30)
    return tuple(_steps(np.maximum(c - int(c.mean()), 1)) for c in (total.ravel()[:slots], total.ravel()[slots:]))


def _steps(counts: np.ndarray) -> np.ndarray:
    """Counts in a byte, as steps of an eighth of a power of two; see ``_COUNTS`` for what a step stands for."""
    return np.rint(8 * np.log2(counts)).astype(np.uint8)


def _blocks(parts: dict[int, np.ndarray]) -> pa.RecordBatch:
    raw = [np.minimum(v, (1 << 32) - 1).astype(np.uint32).tobytes() for v in parts.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array(raw, pa.binary())], ["block", "counts"])


def _probes(base: DataFrame, n: int, parts: int, similarity: float, miss: float) -> DataFrame:
    """A row for each of the ``n`` records and each partition; ``size`` holds the set's size and the threshold."""
    slots = slots_for(n * parts)
    counts = base.sparkSession.sparkContext.broadcast(_counts(base, parts, slots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loose_n, strict_n = counts.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                keys, fourth = _matrix(part["keys"], parts), _matrix(part["fourth"], parts)
                loose, strict = _slot(keys, fourth, slots)
                how = allocate(_COUNTS[loose_n[loose]] - 1, _COUNTS[strict_n[strict]] - 1, similarity, miss)
                wide = lambda c: np.repeat(part[c].to_numpy(), parts)
                size = (wide("n").astype(np.int32) << 2) | how.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(wide("rid")), pa.array(wide("b0")), pa.array(wide("b1")), pa.array(fourth.ravel()), pa.array(size.astype(np.int32))], ["key", "rid", "b0", "b1", "fourth", "size"])

    return base.select("rid", "n", "keys", "fourth", "b0", "b1").mapInArrow(run, "key long, rid long, b0 long, b1 long, fourth int, size int")


def _met(similarity: float):
    p = (1 - similarity) / 2
    most = math.ceil(BITS * p + SIGMAS * math.sqrt(BITS * p * (1 - p)))

    def match(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        key, fourth, b0, b1 = (table[c].to_numpy() for c in ("key", "fourth", "b0", "b1"))
        n, how = table["size"].to_numpy() >> 2, table["size"].to_numpy() & 3

        def kept(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            good = (popcount(b0[i] ^ b0[j]) + popcount(b1[i] ^ b1[j]) <= most) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9)
            return i[good], j[good]

        for order, same, probing in (
            (np.lexsort((-how, key)), key, LOOSE),
            (np.lexsort((-how, fourth, key))[how[np.lexsort((-how, fourth, key))] != LOOSE], mix(key.view(np.uint64) ^ mix(fourth.astype(np.uint64))), STRICT),
        ):
            if len(order):
                for i, j in offsets(run_ends(same[order]), how[order] == probing):
                    yield kept(order[i], order[j])

    return match


def _verified(pairs: DataFrame, size: int, similarity: float, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            score = np.zeros(batch.num_rows)
            (xa, ba), (xb, bb) = (shingle_sets(batch[c].to_pylist(), size) for c in ("text_a", "text_b"))
            for r in range(batch.num_rows):
                a, b = xa[ba[r] : ba[r + 1]], xb[bb[r] : bb[r + 1]]
                common = overlaps(a, b)
                score[r] = common / (len(a) + len(b) - common)
            good = pa.array(score >= similarity)
            yield pa.RecordBatch.from_arrays([*(batch[c].filter(good) for c in ("id_a", "id_b", "owner_a", "owner_b")), pa.array(score).filter(good)], ["id_a", "id_b", "owner_a", "owner_b", "score"])

    return pairs.mapInArrow(run, f"id_a {kind}, id_b {kind}, owner_a string, owner_b string, score double")


def similar_classes(rows: DataFrame, size: int = 5, similarity: float = 0.8, parts: int = 36, miss: float = 0.0005, id_col: str = "id", text_col: str = "text", owner_col: str | None = None, list_records: bool = True) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """``(pairs, members, records)`` of the texts whose sets of ``size``-word shingles share ``similarity`` of their union.

    ``pairs(id_a, id_b, owner_a, owner_b, score)`` joins class representatives; ``members(rep, id, owner, many)``
    lists every record of the classes above one record, the representative among them;
    ``records(id)`` has all records that have a shingle, if they are to be listed. Null texts, texts below ``size`` words and
    rows without id have none and are in no pair. ``miss`` bounds the chance to lose a pair just at
    ``similarity``; more similar ones are lost far more rarely. Whatever is found is verified exactly.
    """
    kind = dict(rows.dtypes)[id_col]
    owner = F.col(owner_col).cast("string") if owner_col else F.lit(None).cast("string")
    source = rows.select(F.col(id_col).alias("id"), owner.alias("owner"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    base = materialise(_sketches(source.withColumn("rid", F.xxhash64("id")), size, parts, kind), "shingles")
    copies = base.groupBy("class").agg(F.count("*").alias("many"), F.min("id").alias("rep")).where("many > 1")
    members = materialise(base.select("id", "owner", "class").join(copies, "class").select("rep", "id", "owner", "many"), "members")
    stand_ins = base.join(members.where("id != rep").select("id"), "id", "left_anti")
    n = base.count()
    met = pair_rows(split_hot(_probes(stand_ins, n, parts, similarity, miss), n * parts), [], _met(similarity))
    side = lambda s: stand_ins.select(F.col("rid").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("id", "owner", "text")])
    joined = met.join(side("a"), "a").join(side("b"), "b").where("id_a != id_b").drop("a", "b")
    pairs = materialise(_verified(joined, size, similarity, kind), "verified")
    records = materialise(base.select("id"), "records") if list_records else None
    discard(base)
    return pairs, members, records


def _blocked(members: DataFrame) -> DataFrame:
    """``members`` with ``blocks``, into which their class is cut, and ``block``, the one a member lies in."""
    blocks = F.ceil(F.col("many") / SPREAD).cast("int")
    return members.select("rep", "id", "owner", blocks.alias("blocks"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"))


def _expanded(links: DataFrame, blocked: DataFrame) -> DataFrame:
    """``(x, y, ox, oy)``: the pairs of records that ``links(id_a, id_b, owner_a, owner_b)`` between texts stand for.

    A class enters a join by blocks of about ``SPREAD`` records, so a task never meets all pairs of two large classes.
    """
    sizes = blocked.where("id = rep")
    for s, x, o in (("a", "x", "ox"), ("b", "y", "oy")):
        size = sizes.select(F.col("rep").alias(f"id_{s}"), F.col("blocks"))
        member = blocked.select(F.col("rep").alias(f"id_{s}"), "block", F.col("id").alias(x), F.col("owner").alias(o))
        links = links.join(size, f"id_{s}", "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
        links = links.join(member, [f"id_{s}", "block"], "left").drop("block")
        links = links.withColumn(o, F.when(F.col(x).isNull(), F.col(f"owner_{s}")).otherwise(F.col(o))).withColumn(x, F.coalesce(x, f"id_{s}"))
    return links.select("x", "y", "ox", "oy")


def _starred(members: DataFrame, owners: bool) -> DataFrame:
    """``(x, y, ox, oy)``: each record of a class with the smallest id of the class or, where that is of the same owner, with the smallest id of another owner."""
    if not owners:
        return members.select(F.col("id").alias("x"), F.col("rep").alias("y"), F.col("owner").alias("ox"), F.lit(None).cast("string").alias("oy"))
    first = members.where("id = rep").select("rep", F.col("owner").alias("first_owner"))
    sided = members.join(first, "rep").withColumn("same", F.expr("owner <=> first_owner"))
    second = sided.where("not same").groupBy("rep").agg(F.min_by(F.struct("id", "owner"), "id").alias("second"))
    partner = F.when(F.col("same"), F.col("second")).otherwise(F.struct(F.col("rep").alias("id"), F.col("first_owner").alias("owner")))
    starred = sided.join(second, "rep", "left").withColumn("partner", partner).where("partner is not null")
    return starred.select(F.col("id").alias("x"), F.col("partner.id").alias("y"), F.col("owner").alias("ox"), F.col("partner.owner").alias("oy"))


def near_duplicates(rows: DataFrame, write_out: int | None = WRITE_OUT, **options) -> DataFrame:
    """``(id_a, id_b)``, id_a < id_b: similar records of different owners (of any, without ``owner_col``).

    Links between different sets are written out for all their records. So are the pairs of a class of equal sets up to
    ``write_out`` records, or of every class if that is None; in larger ones each record is linked to the class's smallest
    id only, or to the smallest of another owner if that id is of the record's own. Options as in :func:`similar_classes`.
    """
    pairs, members, _ = similar_classes(rows, list_records=False, **options)
    whole = members if write_out is None else members.where(F.col("many") <= write_out)
    itself = whole.where("id = rep").select(F.col("rep").alias("id_a"), F.col("rep").alias("id_b"), F.col("owner").alias("owner_a"), F.col("owner").alias("owner_b"))
    blocked = _blocked(members)
    both = _expanded(pairs.drop("score"), blocked).unionByName(_expanded(itself, blocked).where("x < y"))
    if write_out is not None:
        both = both.unionByName(_starred(members.where(F.col("many") > write_out), bool(options.get("owner_col"))))
    both = both.where("x != y")
    if options.get("owner_col"):
        both = both.where("not (ox <=> oy)")
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(id, root)``: the smallest id that each id of ``edges(a, b)`` is connected to.

    Large-star and small-star rounds on the edge table alone, until nothing moves: every node links its larger, then its
    smaller neighbours to the least one known, which halves distances; each round is written out and the one before deleted.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    while True:
        sides = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = sides.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        down = large.join(root, "a")
        small = down.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(root.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        new = materialise(small, "edges")
        moved = new.join(now, ["a", "b"], "left_anti").limit(1).count() or now.join(new, ["a", "b"], "left_anti").limit(1).count()
        discard(now)
        now = new
        if not moved:
            break
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def near_duplicate_groups(rows: DataFrame, **options) -> DataFrame:
    """``(id, group_id, n_links)`` for every record with a shingle: its group's smallest id, and how many similar
    records of other sets it has, copies of one text each counted. Records of equal sets are in one group, but are no links. Options as in :func:`similar_classes`."""
    pairs, members, records = similar_classes(rows, **options)
    sides = pairs.select(F.col("id_a").alias("rep"), F.col("id_b").alias("other")).unionByName(pairs.select(F.col("id_b").alias("rep"), F.col("id_a").alias("other")))
    sizes = members.where("id = rep").select(F.col("rep").alias("other"), "many")
    links = sides.join(sizes, "other", "left").groupBy("rep").agg(F.sum(F.coalesce("many", F.lit(1))).alias("n_links"))
    roots = components(pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))).select(F.col("id").alias("rep"), "root")
    named = records.join(members.select("id", "rep"), "id", "left").withColumn("rep", F.coalesce("rep", "id"))
    out = named.join(roots, "rep", "left").join(links, "rep", "left")
    # A class's representative is its smallest id, so the root is the smallest id of the group.
    return out.select("id", F.coalesce("root", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
