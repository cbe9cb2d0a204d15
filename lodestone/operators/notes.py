"""Notes as wholes: text, context, names, statistics, grouping of results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.scalars import slugify


def headers(chunks: DataFrame) -> DataFrame:
    """The notes: the first chunk of each."""
    return chunks.where(F.col("chunk_index") == 0)


#: Chunks of a note that one task puts together.
PART = 1000


def slugs(heads: DataFrame) -> DataFrame:
    """``(note_slug)`` of all notes, in order."""
    return heads.select("note_slug").distinct().orderBy("note_slug")


def note_parts(chunks: DataFrame, size: int = PART) -> DataFrame:
    """``(note_slug, part, n_chunks, content)``: each note put together again in parts of ``size`` places, joined by a blank line.

    A heading is written where the path changes: of the parts that the chunk before does not share, the last with the chunk's
    level, the others with their depth. Null texts and headings are empty. The chunk before the first of a part
    is found among the last ones of the parts, so no task sees a whole note.
    """
    parts = F.filter(F.split(F.coalesce("heading_path", F.lit("")), " > "), lambda x: x != "")
    rows = chunks.select("note_slug", "chunk_index", F.floor(F.col("chunk_index") / size).cast("int").alias("part"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("heading_level", F.lit(0)).alias("level"), parts.alias("parts"))
    ends = rows.groupBy("note_slug", "part").agg(F.max_by("parts", "chunk_index").alias("end"))
    ends = ends.select("note_slug", "part", F.lag("end").over(W.partitionBy("note_slug").orderBy("part")).alias("end"))
    none = F.array().cast("array<string>")
    before = F.coalesce(F.lag("parts").over(W.partitionBy("note_slug", "part").orderBy("chunk_index")), "end", none)
    rows = rows.join(ends, ["note_slug", "part"]).withColumn("before", before)
    depth = F.sequence(F.lit(1), F.size("parts"))
    # The first part that differs; all before it are shared.
    differs = F.filter(depth, lambda k: ~F.get(F.col("parts"), k - 1).eqNullSafe(F.get(F.col("before"), k - 1)))
    fresh = F.when(F.size("parts") == 0, F.array().cast("array<int>")).otherwise(F.filter(depth, lambda k: k >= F.array_min(differs)))
    level = lambda k: F.when((k == F.size("parts")) & (F.col("level") > 0), F.col("level")).otherwise(k)
    lines = F.transform(fresh, lambda k: F.concat(F.repeat(F.lit("#"), level(k)), F.lit(" "), F.get(F.col("parts"), k - 1)))
    body = F.concat(lines, F.when(F.col("text") != "", F.array("text")).otherwise(none))
    ordered = rows.withColumn("body", body).groupBy("note_slug", "part").agg(F.count("*").alias("n_chunks"), F.array_sort(F.collect_list(F.struct("chunk_index", "body"))).alias("all"))
    return ordered.select("note_slug", "part", "n_chunks", F.array_join(F.flatten(F.transform("all", lambda x: x["body"])), "\n\n").alias("content"))


def note_texts(chunks: DataFrame) -> DataFrame:
    """``(note_slug, n_chunks, content)``: the parts of :func:`note_parts` in one row, which a note's text must fit."""
    each = F.array_sort(F.collect_list(F.struct("part", "content")))
    whole = note_parts(chunks).groupBy("note_slug").agg(F.sum("n_chunks").alias("n_chunks"), each.alias("all"))
    shown = F.filter(F.transform("all", lambda x: x["content"]), lambda c: c != "")
    return whole.select("note_slug", "n_chunks", F.array_join(shown, "\n\n").alias("content"))


def get_note(chunks: DataFrame, slug: str, head: int | None = None) -> DataFrame:
    """One note's text; with ``head`` of its first chunks only, while ``total`` counts all."""
    mine = chunks.where(F.col("note_slug") == slug)
    part = mine.where(F.col("chunk_index") < head) if head else mine
    total = mine.groupBy("note_slug").agg(F.count("*").alias("total"))
    about = headers(mine).select("note_slug", "title", "file_path", "tags")
    return note_texts(part).join(total, "note_slug").join(about, "note_slug", "left")


def note_meta(chunks: DataFrame) -> DataFrame:
    """``(note_slug, title, file_path, file_type, content_hash, n_chunks)`` of every note."""
    counted = chunks.groupBy("note_slug").agg(F.count("*").alias("n_chunks"), F.min(F.when(F.col("chunk_index") == 0, F.struct("id", "title", "file_path", "file_type", "content_hash"))).alias("h"))
    return counted.where("h is not null").select("note_slug", "h.title", "h.file_path", "h.file_type", "h.content_hash", "n_chunks")


def with_context(results: DataFrame, chunks: DataFrame, window: int) -> DataFrame:
    """``results`` with ``context``: the texts of the chunks at most ``window`` places away in the note, in order, without its own."""
    near = chunks.select("note_slug", F.col("chunk_index").alias("_i"), F.col("text").alias("_t"))
    # Each place asked for is a key, so chunks of a long note are not compared with one another.
    places = F.explode(F.filter(F.sequence(F.col("chunk_index") - window, F.col("chunk_index") + window), lambda i: i != F.col("chunk_index")))
    keys = results.select("note_slug", "chunk_index").distinct().select("note_slug", "chunk_index", places.alias("_i"))
    found = keys.join(near, ["note_slug", "_i"]).groupBy("note_slug", "chunk_index").agg(F.array_sort(F.collect_list(F.struct("_i", "_t"))).alias("c"))
    context = F.coalesce(F.transform("c", lambda x: x["_t"]), F.array().cast("array<string>"))
    return results.join(found, ["note_slug", "chunk_index"], "left").withColumn("context", context).drop("c")


CLASSES = ("path", "title", "suffix")


def classify(notes: DataFrame, inputs: DataFrame) -> DataFrame:
    """``(input, class, note_slug)`` for each of ``inputs(input)`` and note that it may mean, by the first class that fits: title, path, suffix.

    Titles and exact paths are joined by equality; a path or slug that ends in the input is found on keys made of the notes' own
    endings (paths at their slashes, slugs at their hyphens and before any character), so inputs and notes are never all compared.
    """
    asked = inputs.select("input").distinct().where("input <> ''").withColumn("slug", slugify(F.col("input")))
    tails = lambda path: F.transform(F.sequence(F.lit(1), F.size(F.split(path, "/"))), lambda k: F.array_join(F.slice(F.split(path, "/"), k, F.size(F.split(path, "/")) - k + 1), "/"))
    by_title = notes.select(F.lower("title").alias("k"), "note_slug").join(asked.withColumn("k", F.lower("input")), "k").select("input", "note_slug", F.lit("title").alias("class"))
    ends = notes.where("file_path <> ''").select("note_slug", F.explode(tails(F.col("file_path"))).alias("k"))
    wanted = asked.select("input", F.explode(F.array("input", F.concat("input", F.lit(".md")))).alias("k"))
    by_path = ends.join(wanted, "k").select("input", "note_slug", F.lit("path").alias("class"))
    endings = notes.select("note_slug", F.explode(F.transform(F.sequence(F.lit(1), F.length("note_slug")), lambda k: F.substring(F.col("note_slug"), k, F.length("note_slug")))).alias("k"))
    by_suffix = endings.join(asked.where("slug <> ''").select("input", F.col("slug").alias("k")), "k").select("input", "note_slug", F.lit("suffix").alias("class"))
    rank = F.when(F.col("class") == "title", 0).when(F.col("class") == "path", 1).otherwise(2)
    every = reduce(DataFrame.unionByName, [by_title, by_path, by_suffix]).groupBy("input", "note_slug").agg(F.min(rank).alias("r"))
    return every.select("input", "note_slug", F.element_at(F.array(F.lit("title"), F.lit("path"), F.lit("suffix")), F.col("r") + 1).alias("class"))


def resolve_names(notes: DataFrame, inputs: DataFrame) -> DataFrame:
    """``(input, note_slug, status, n_candidates)`` of each input: ``resolved``, ``ambiguous`` or ``missing``.

    A single path match wins, then a single title, then a single suffix; else all that match are candidates,
    which :func:`classify` lists.
    """
    met = classify(notes, inputs)
    of = lambda c: F.when(F.col("class") == c, F.col("note_slug"))
    by = met.groupBy("input").agg(*[f(of(c)).alias(f"{c}_{f.__name__}") for c in CLASSES for f in (F.count, F.min)], F.count("*").alias("n"), F.min("note_slug").alias("any"))
    single: Column = F.coalesce(*[F.when(F.col(f"{c}_count") == 1, F.col(f"{c}_min")) for c in CLASSES], F.when(F.col("n") == 1, F.col("any")))
    out = inputs.select("input").distinct().join(by.withColumn("note_slug", single), "input", "left")
    status = F.when(F.col("note_slug").isNotNull(), "resolved").when(F.col("n") > 1, "ambiguous").otherwise("missing")
    return out.select("input", "note_slug", status.alias("status"), F.coalesce("n", F.lit(0)).alias("n_candidates"))


#: Candidates that the message about an ambiguous name lists.
NAMED = 20


def candidates_of(notes: DataFrame, name: str) -> str:
    """The notes that an ambiguous name may mean, for a message."""
    inputs = notes.sparkSession.createDataFrame([(name,)], "input string")
    found = [r[0] for r in classify(notes, inputs).select("note_slug").orderBy("note_slug").limit(NAMED + 1).collect()]
    return ", ".join([*found[:NAMED], *(["and more"] if len(found) > NAMED else [])])


def resolve_name(notes: DataFrame, name: str) -> str:
    """The slug a name means; an exact slug or path wins. Raises LookupError if none or several fit."""
    wanted = name.strip()
    if not wanted:
        return ""
    exact = notes.where((F.col("note_slug") == wanted) | (F.col("file_path") == wanted)).select("note_slug").orderBy("note_slug").first()
    if exact:
        return exact[0]
    row = resolve_names(notes, notes.sparkSession.createDataFrame([(wanted,)], "input string")).first()
    if row["status"] == "resolved":
        return row["note_slug"]
    raise LookupError(f"{name!r} is ambiguous: {candidates_of(notes, wanted)}" if row["n_candidates"] else f"{name!r} names no note")


def stats(chunks: DataFrame, links: DataFrame) -> DataFrame:
    """``(notes, chunks, links)``: notes by their first chunks, or by all chunks if none is a first one."""
    c = chunks.agg(F.count_distinct(F.when(F.col("chunk_index") == 0, F.col("note_slug"))).alias("heads"), F.count_distinct("note_slug").alias("slugs"), F.count("*").alias("chunks"))
    return c.crossJoin(links.agg(F.count("*").alias("links"))).select(F.when(F.col("heads") > 0, F.col("heads")).otherwise(F.col("slugs")).alias("notes"), "chunks", "links")


def group_by_note(results: DataFrame, position: str = "position") -> DataFrame:
    """One row per note, its best-scored (the first of equals), in the order of first appearance; ``extra`` counts the others."""
    worst_last = F.struct(F.coalesce(-F.col("score"), F.lit(float("inf"))), F.col(position))
    by = results.groupBy("note_slug").agg(F.min_by(F.struct("*"), worst_last).alias("r"), F.count("*").alias("n"), F.min(position).alias("first"))
    old = F.col("r.extra") if "extra" in results.columns else F.lit(None).cast("string")
    extra = F.when(F.col("n") > 1, F.concat(F.col("n").cast("string"), F.lit(" matching chunks"))).otherwise(old)
    shown = [F.col("note_slug") if c == "note_slug" else F.col(f"r.{c}") for c in results.columns if c != "extra"]
    return by.select(*shown, extra.alias("extra"), "first").orderBy("first").drop("first")
