"""Keyword search over notes, the fallback of vector search."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(query: str) -> list[str]:
    """Distinct runs of a-z and 0-9, two characters or more, of the query in lower case."""
    return list(dict.fromkeys(t for t in re.split("[^a-z0-9]+", query.lower()) if len(t) >= 2))


def lexical_search(chunks: DataFrame, query: str, limit: int | None = None, where: Column | None = None) -> DataFrame:
    """Notes whose title (2), path, first text or tags (1 each) contain words of the query, with ``hits``.

    Most hits first, then slug. Rows have score 0, ``lexical`` true and no text. Null columns hit nothing.
    """
    words = tokens(query)
    heads = chunks.where(F.col("chunk_index") == 0)
    heads = heads.where(where) if where is not None else heads
    one = lambda c, w, n=1: F.when(F.contains(F.lower(c), F.lit(w)), n).otherwise(0)
    hits = F.lit(0)
    for w in words:
        in_tags = F.coalesce(F.size(F.filter("tags", lambda t: F.contains(F.lower(t), F.lit(w)))), F.lit(0))
        hits = hits + one(F.col("title"), w, 2) + one(F.col("file_path"), w) + one(F.col("text"), w) + F.when(in_tags > 0, in_tags).otherwise(0)
    found = heads.select("note_slug", "title", "file_path", "tags", "file_type", hits.cast("long").alias("hits")).where("hits > 0")
    ranked = found.select("*", F.lit(0.0).alias("score"), F.lit(True).alias("lexical")).orderBy(F.col("hits").desc(), "note_slug")
    return ranked.limit(limit) if limit and limit > 0 else ranked


def needs_fallback(results: DataFrame, min_score: float) -> bool:
    """Whether a search found nothing, or nothing of ``min_score``. Results are bounded by their limit."""
    best = results.agg(F.max("score")).first()[0]
    return best is None or best < min_score
