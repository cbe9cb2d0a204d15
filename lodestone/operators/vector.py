"""Exact vector search: the chunks most similar to one or several query vectors."""

from __future__ import annotations

import logging
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The most results, and the thresholds by which a query is named for a result.
MOST = 100
ABSOLUTE, RELATIVE, BELOW_BEST = 0.70, 0.85, 0.05


def cosine(vector: Column, query: Sequence[float]) -> Column:
    """Similarity to a given vector, 1 for the same direction; null for null, zero and vectors of another length."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    dot = total(F.zip_with(vector, F.lit([float(x) for x in query]), lambda p, q: p.cast("double") * q))
    square = total(F.transform(vector, lambda p: p.cast("double") * p.cast("double")))
    length = sum(float(q) ** 2 for q in query) ** 0.5
    return F.when(F.size(vector) == len(query), F.try_divide(dot, F.sqrt(square) * length))


def clamp(limit: int, exact: bool = False) -> int:
    """A limit that can be met: at least 1, and, but for ``exact`` searches, at most ``MOST``, of which is warned."""
    if limit > MOST and not exact:
        logging.getLogger("lodestone").warning("limit %d is above %d, results are cut; an exact search has no such limit", limit, MOST)
        return MOST
    return max(1, limit)


def fetch_size(limit: int, per_note: int) -> int:
    return min(max(3 * limit, limit * per_note), MOST)


def _best() -> list[Column]:
    return [F.col("score").desc(), F.col("note_slug"), F.col("chunk_index"), F.col("id")]


def cap_per_note(ranked: DataFrame, per_note: int, limit: int | None, order: list[Column]) -> DataFrame:
    """At most ``per_note`` rows of a note (3 if not positive), then ``limit`` rows, best first."""
    most = per_note if per_note > 0 else 3
    kept = ranked.withColumn("_of_note", F.row_number().over(W.partitionBy("note_slug").orderBy(*order))).where(F.col("_of_note") <= most).drop("_of_note").orderBy(*order)
    return kept.limit(limit) if limit else kept


def semantic_search(chunks: DataFrame, query: Sequence[float], limit: int = 10, per_note: int = 3, where: Column | None = None, exact: bool = False) -> DataFrame:
    """The chunks nearest to ``query``, with ``score``, at most ``per_note`` of a note.

    As an index does, only the nearest ``fetch_size`` chunks are looked at before the cap, so fewer than
    ``limit`` may come; ``exact`` caps over all chunks. The limit is 1 to 100, unless ``exact``. Ties rank by note and position.
    """
    limit, per_note = clamp(limit, exact), max(per_note, 1)
    scored = (chunks.where(where) if where is not None else chunks).withColumn("score", cosine(F.col("embedding"), query))
    # Null scores sort last and go after the limit; a filter before it would compute every score twice.
    near = scored if exact else scored.orderBy(*_best()).limit(fetch_size(limit, per_note))
    return cap_per_note(near.where("score is not null"), per_note, limit, _best())


def _scored(rows: DataFrame, queries: Sequence[Sequence[float]], names: Sequence[str], most: int | None) -> DataFrame:
    """``(id, note_slug, chunk_index, k, query, score)`` of at least the ``most`` best rows of each query, or of all.

    One matrix product per batch scores all queries; a batch passes on only what may be among the best of all rows.
    """
    dim = max(map(len, queries))
    matrix = np.zeros((len(queries), dim))
    for k, q in enumerate(queries):
        matrix[k, : len(q)] = q
    lengths = np.array([len(q) for q in queries])
    norms = np.linalg.norm(matrix, axis=1)
    labels = pa.array(list(names), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch["embedding"]).fill_null(-1).to_numpy()
            for size in np.unique(sizes[np.isin(sizes, lengths)]):
                part = batch.filter(pa.array(sizes == size))
                ks = np.flatnonzero((lengths == size) & (norms > 0))
                vec = part["embedding"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
                with np.errstate(all="ignore"):
                    score = (vec @ matrix[ks, :size].T) / (np.linalg.norm(vec, axis=1)[:, None] * norms[ks])
                score[~np.isfinite(score)] = -np.inf
                least = np.partition(score, -most, axis=0)[-most] if most and len(score) > most else np.full(len(ks), -np.inf)
                row, col = np.nonzero((score >= least) & (score > -np.inf))
                kept = pa.array(row)
                yield pa.RecordBatch.from_arrays([part[c].take(kept) for c in ("id", "note_slug", "chunk_index")] + [pa.array(ks[col].astype(np.int32)), labels.take(pa.array(ks[col])), pa.array(score[row, col])], ["id", "note_slug", "chunk_index", "k", "query", "score"])

    return rows.select("id", "note_slug", F.col("chunk_index").cast("int").alias("chunk_index"), "embedding").mapInArrow(run, "id string, note_slug string, chunk_index int, k int, query string, score double")


def multi_search(chunks: DataFrame, queries: Sequence[Sequence[float]], labels: Sequence[str], limit: int = 10, per_note: int = 3, where: Column | None = None, exact: bool = False) -> DataFrame:
    """Chunks near to any of several queries: notes that more queries meet come first, then better scores.

    One scan scores all queries. Each contributes its nearest chunks as a search of its own would, ``exact`` or not; scores of 0 or less do
    not count. ``matched_queries`` names the note's queries that pass :func:`attribution`. Blank labels are numbered, equal ones are one query.
    """
    if not len(queries):
        return chunks.limit(0).selectExpr("*", "0D AS score", "0L AS n_queries", "array('') AS matched_queries")
    limit, per_note = clamp(limit, exact), max(per_note, 1)
    names = [lab if lab.strip() else f"query_{k + 1}" for k, lab in enumerate(labels)]
    fetch, cap = max(2 * limit, 20), max(2 * per_note, 6)
    fetch = fetch if exact else min(fetch, MOST)
    window = None if exact else fetch_size(fetch, cap)
    rows = chunks.where(where) if where is not None else chunks
    scored = _scored(rows, queries, names, window)
    per_query = lambda *more: W.partitionBy("k", *more).orderBy(*_best())
    near = scored.withColumn("r", F.row_number().over(per_query())).where(F.col("r") <= window).drop("r") if window else scored
    near = near.withColumn("r", F.row_number().over(per_query("note_slug"))).where(F.col("r") <= cap).drop("r")
    near = near.withColumn("r", F.row_number().over(per_query())).where(F.col("r") <= fetch).drop("r").where("score > 0")
    of_note = near.groupBy("note_slug", "query").agg(F.max("score").alias("s")).groupBy("note_slug").agg(F.count("*").alias("n_queries"), F.collect_list(F.struct(F.col("s"), F.col("query").alias("q"))).alias("by_query"))
    of_chunk = near.groupBy("id", "note_slug", "chunk_index").agg(F.max("score").alias("score"))
    kept = cap_per_note(of_chunk.join(of_note, "note_slug"), per_note, limit, [F.col("n_queries").desc(), *_best()])
    named = kept.withColumn("matched_queries", attribution(F.col("by_query"), F.col("score"))).select("id", "score", "n_queries", "matched_queries")
    return chunks.join(named, "id")


def attribution(by_query: Column, best: Column) -> Column:
    """The queries of ``array<struct<s, q>>`` that count as matched for a row of score ``best``, best first.

    Near to the best from 0.70 up, within 0.05 of it below; if none, the best one. Compared as floats.
    """
    f = lambda c: c.cast("float")
    strong = lambda e: (f(e["s"]) >= f(F.lit(ABSOLUTE))) & (f(e["s"]) >= f(F.lit(RELATIVE)) * f(best))
    weak = lambda e: (f(best) < f(F.lit(ABSOLUTE))) & (f(e["s"]) >= f(best) - f(F.lit(BELOW_BEST)))
    order = lambda a: F.transform(F.array_sort(F.transform(a, lambda e: F.struct((-e["s"]).alias("o"), e["q"].alias("q")))), lambda e: e["q"])
    passing = order(F.filter(by_query, lambda e: strong(e) | weak(e)))
    return F.when(F.size(passing) > 0, passing).otherwise(F.slice(order(by_query), 1, 1))
