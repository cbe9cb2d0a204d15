"""Searches by tag, shared tags, and tag statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.scalars import normal_tag
from lodestone.operators.filters import tagged


def _first_per_note(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy("note_slug").orderBy("chunk_index", "id"))).where("_n = 1").drop("_n")


def tag_search(chunks: DataFrame, tag: str, limit: int | None = 50, children: bool = False, where: Column | None = None) -> DataFrame:
    """The first chunk of each note with the tag (``children``: or one below it), by title, score 1; ``limit`` None gives all."""
    rows = chunks.where(where) if where is not None else chunks
    wanted = normal_tag(tag)
    hit = F.exists("tags", lambda t: (F.lower(t) == wanted) | F.startswith(F.lower(t), F.lit(wanted + "/"))) if children else tagged(wanted)
    found = _first_per_note(rows.where(hit)).withColumn("score", F.lit(1.0)).orderBy("title", "note_slug")
    return found if limit is None else found.limit(limit)


def shared_tags(notes: DataFrame, slug: str, least: int = 1) -> DataFrame:
    """Other notes by the number of tags they share with the note, with the tags in its order. ``notes`` are first chunks."""
    seed = notes.where(F.col("note_slug") == slug).select(F.posexplode("tags").alias("pos", "tag")).groupBy("tag").agg(F.min("pos").alias("pos"))
    each = notes.where(F.col("note_slug") != slug).select("note_slug", "title", F.explode(F.array_distinct("tags")).alias("tag"))
    met = each.join(seed, "tag").groupBy("note_slug", "title").agg(F.count("*").alias("score"), F.array_sort(F.collect_list(F.struct("pos", "tag"))).alias("t"))
    return met.where(F.col("score") >= least).select("note_slug", "title", "score", F.transform("t", lambda x: x["tag"]).alias("tags")).orderBy(F.col("score").desc(), "title", "note_slug")


def list_tags(notes: DataFrame, limit: int | None = None) -> DataFrame:
    """Each tag with the number of notes that have it, the most frequent first; empty tags do not count."""
    counted = notes.select("note_slug", F.explode(F.array_distinct("tags")).alias("tag")).where("tag <> ''").groupBy("tag").agg(F.count("*").alias("count")).orderBy(F.col("count").desc(), "tag")
    return counted.limit(limit) if limit and limit > 0 else counted


def suggest_tags(notes: DataFrame, tag: str, limit: int = 3) -> DataFrame:
    """Existing tags nearest in spelling to one that was not found, the tag itself left out."""
    wanted = tag.strip().lower()
    near = list_tags(notes).where(F.lower("tag") != wanted).withColumn("distance", F.levenshtein(F.lower("tag"), F.lit(wanted)).cast("long"))
    return near.orderBy("distance", F.col("count").desc(), "tag").limit(limit)
