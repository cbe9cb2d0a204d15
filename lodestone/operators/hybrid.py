"""Searches that combine similarity with links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scalars import deep_label
from lodestone.operators.graph import linked_slugs
from lodestone.operators.vector import MOST, cap_per_note, clamp, cosine, multi_search, semantic_search


def hidden(chunks: DataFrame, links: DataFrame, aliases: DataFrame, query: Sequence[float], slug: str, limit: int = 10, include_linked: bool = False, exact: bool = False) -> DataFrame:
    """Notes similar to ``query`` that the note neither links to nor is linked from.

    The linked ones take places in the window of five times the limit, as they are dropped after ranking; not so if ``exact``.
    """
    limit = clamp(limit, exact)
    if exact:
        others = chunks if include_linked else chunks.join(linked_slugs(links, aliases, slug), "note_slug", "left_anti")
        return semantic_search(others.where(F.col("note_slug") != slug), query, limit, 1, exact=True)
    near = semantic_search(chunks, query, min(5 * limit, MOST), 1).where(F.col("note_slug") != slug)
    near = near if include_linked else near.join(linked_slugs(links, aliases, slug), "note_slug", "left_anti")
    return near.orderBy(F.col("score").desc(), "note_slug", "chunk_index").limit(limit)


def deep_queries(chunks: DataFrame, slug: str) -> tuple[list[list[float]], list[str]]:
    """The vectors of a note's chunks, in order, and their labels. One note's chunks go to the driver."""
    rows = chunks.where((F.col("note_slug") == slug) & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).select("chunk_index", "embedding", deep_label(F.col("heading_path"), F.col("title"), F.col("chunk_index")).alias("label")).orderBy("chunk_index").collect()
    if not rows:
        raise LookupError(f"no chunks of {slug}")
    return [list(r["embedding"]) for r in rows], [r["label"] for r in rows]


def hidden_deep(chunks: DataFrame, links: DataFrame, aliases: DataFrame, slug: str, limit: int = 10, per_note: int = 3, include_linked: bool = False, exact: bool = False) -> DataFrame:
    """Chunks similar to any chunk of the note, of notes without a link to it; linked notes are dropped before ranking."""
    limit, per_note = clamp(limit, exact), max(per_note, 1)
    vectors, labels = deep_queries(chunks, slug)
    others = chunks.where(F.col("note_slug") != slug) if not include_linked else chunks
    others = others if include_linked else others.join(linked_slugs(links, aliases, slug), "note_slug", "left_anti")
    room = max(2 * limit, limit * per_note, 15)
    found = multi_search(others, vectors, labels, room if exact else min(room, MOST), per_note, exact=exact).where(F.col("note_slug") != slug)
    return found.orderBy(F.col("n_queries").desc(), F.col("score").desc(), "note_slug", "chunk_index").limit(limit)


def boosted(chunks: DataFrame, links: DataFrame, aliases: DataFrame, query: Sequence[float], slug: str, boost: float = 1.5, limit: int = 10, where: Column | None = None, exact: bool = False) -> DataFrame:
    """Similar notes, the score of those linked with the note multiplied by ``boost`` (below 1 it demotes).

    The three times ``limit`` nearest notes are looked at; all, if ``exact``.
    """
    limit = clamp(limit, exact)
    if exact:
        scored = (chunks.where(where) if where is not None else chunks).withColumn("score", cosine(F.col("embedding"), query)).where("score is not null")
        near = cap_per_note(scored, 1, None, [F.col("score").desc(), F.col("note_slug"), F.col("chunk_index"), F.col("id")])
    else:
        near = semantic_search(chunks, query, min(3 * limit, MOST), 1, where)
    linked = linked_slugs(links, aliases, slug).withColumn("_linked", F.lit(True))
    out = near.join(linked, "note_slug", "left")
    out = out.withColumn("extra", F.when(F.col("_linked"), "graph-boosted")).withColumn("score", F.when(F.col("_linked"), F.col("score") * boost).otherwise(F.col("score"))).drop("_linked")
    return out.orderBy(F.col("score").desc(), "note_slug", "chunk_index").limit(limit)
