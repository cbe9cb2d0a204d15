"""Links between notes: names, resolution, backlinks and bounded traversal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scalars import basename, is_attachment, slugify, title_from_path, without_anchor
from lodestone.scratch import materialise


def alias_table(notes: DataFrame) -> DataFrame:
    """``(key, note_slug)``: every name a link may use for a note.

    Names are the slug, the title, the path, its last part and that without extension, the latter four also in lower case and
    as slugs. A note's own slug always means the note; of several notes with one name the smallest slug wins.
    """
    own = notes.select(F.col("note_slug").alias("key"), F.lit(0).alias("prio"), "note_slug")
    names = [F.col("title"), F.col("file_path"), basename(F.col("file_path")), title_from_path(F.col("file_path"))]
    forms = F.array(*[f(n) for n in names for f in (lambda c: c, F.lower, slugify)])
    other = notes.select(F.explode(F.array_distinct(forms)).alias("key"), F.lit(1).alias("prio"), "note_slug").where("key <> ''")
    best = own.unionByName(other).groupBy("key").agg(F.min(F.struct("prio", "note_slug")).alias("b"))
    return best.select("key", F.col("b.note_slug").alias("note_slug"))


def _alias(rows: DataFrame, aliases: DataFrame, key: Column, name: str) -> DataFrame:
    return rows.withColumn("_k", key).join(aliases.select(F.col("key").alias("_k"), F.col("note_slug").alias(name)), "_k", "left").drop("_k")


def resolve_links(raw: DataFrame, aliases: DataFrame, skip_attachments: bool = True) -> DataFrame:
    """``(source_slug, target_slug, target_path, display_text)`` of raw links ``(source_slug, raw)``, one per source and target.

    The target is what the link's name, then its lower case, then its slug is an alias of; else the slug itself, which no note
    has. Of several spellings of one target the first in order is kept. Null and blank links are left out.
    """
    rows = raw.where(F.col("raw").isNotNull()).withColumn("name", without_anchor(F.col("raw"))).where("name <> ''")
    rows = rows.where(~is_attachment(F.col("raw"))) if skip_attachments else rows
    rows = _alias(rows, aliases, F.col("name"), "t1")
    rows = _alias(rows, aliases, F.lower("name"), "t2")
    rows = _alias(rows, aliases, slugify(F.col("name")), "t3")
    rows = rows.withColumn("target_slug", F.coalesce("t1", "t2", "t3", slugify(F.col("name")))).where("target_slug <> ''")
    first = rows.groupBy("source_slug", "target_slug").agg(F.min("raw").alias("target_path"))
    return first.select("source_slug", "target_slug", "target_path", F.col("target_path").alias("display_text"))


def _kept(links: DataFrame, skip_attachments: bool) -> DataFrame:
    return links.where(~is_attachment(F.col("target_path"))) if skip_attachments else links


def candidates(aliases: DataFrame) -> DataFrame:
    """``(key, note_slug)``: the target names by which edges into each note are found; a slugified name may belong to another note too."""
    both = aliases.select("key", "note_slug").unionByName(aliases.select(slugify(F.col("key")).alias("key"), "note_slug"))
    return both.where("key <> ''").distinct()


def outgoing(links: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(a, b)``: the source of each link and what it leads to, a note if its target or else its text names one."""
    rows = _alias(links, aliases, F.col("target_slug"), "t1")
    rows = _alias(rows, aliases, F.col("target_path"), "t2")
    return rows.select(F.col("source_slug").alias("a"), F.coalesce("t1", "t2", "target_slug").alias("b"))


def incoming(links: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(a, b)``: each note or phantom that a link's target or text may mean, and the note that the link is in."""
    names = links.select(F.explode(F.array_distinct(F.array("target_slug", "target_path"))).alias("key"), "source_slug")
    met = names.join(candidates(aliases), "key", "left")
    each = met.select(F.explode(F.array_distinct(F.array_compact(F.array("key", "note_slug")))).alias("a"), "source_slug")
    return _alias(each, aliases, F.col("source_slug"), "s").select("a", F.coalesce("s", "source_slug").alias("b")).distinct()


def candidate_keys(aliases: DataFrame, slug: str) -> DataFrame:
    """``(key)``: the names by which edges into one note or phantom are found."""
    mine = candidates(aliases.where(F.col("note_slug") == slug)).select("key")
    return mine.unionByName(mine.sparkSession.range(1).select(F.lit(slug).alias("key"))).where("key <> ''").distinct()


def _links_into(links: DataFrame, aliases: DataFrame, slug: str) -> DataFrame:
    """The links whose target or text means a note. Two semi-joins, as a join on either of two columns would compare all with all."""
    keys = candidate_keys(aliases, slug)
    by_slug = links.join(keys.withColumnRenamed("key", "target_slug"), "target_slug", "left_semi")
    by_path = links.join(keys.withColumnRenamed("key", "target_path"), "target_path", "left_semi")
    return by_slug.unionByName(by_path.select(by_slug.columns))


def _headed(rows: DataFrame, notes: DataFrame) -> DataFrame:
    """Title, path and type of the notes; what is no note is a phantom titled by its name."""
    heads = notes.select("note_slug", "title", "file_path", "file_type", F.lit(True).alias("_found"))
    named = rows.join(heads, "note_slug", "left").withColumn("is_phantom", F.col("_found").isNull()).drop("_found")
    return named.withColumn("title", F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("note_slug")))


def backlinks(links: DataFrame, aliases: DataFrame, notes: DataFrame, slug: str, skip_attachments: bool = True) -> DataFrame:
    """The notes that link to a note, by title, with the first link's text; score 1."""
    met = _links_into(_kept(links, skip_attachments), aliases, slug)
    met = _alias(met, aliases, F.col("source_slug"), "s").groupBy(F.coalesce("s", "source_slug").alias("note_slug")).agg(F.min("display_text").alias("extra"))
    return _headed(met, notes).withColumn("score", F.lit(1.0)).orderBy("title", "note_slug")


def linked_slugs(links: DataFrame, aliases: DataFrame, slug: str) -> DataFrame:
    """``(note_slug)``: all notes and phantoms one link away, in either direction.

    A link leads to what its target means, or else to the target itself, and to what its text means, if that is a note.
    """
    rows = links.where(F.col("source_slug") == slug)
    rows = _alias(_alias(rows, aliases, F.col("target_slug"), "t1"), aliases, F.col("target_path"), "t2")
    out = rows.select(F.explode(F.array_compact(F.array(F.coalesce("t1", "target_slug"), "t2"))).alias("note_slug"))
    back = _alias(_links_into(links, aliases, slug), aliases, F.col("source_slug"), "s").select(F.coalesce("s", "source_slug").alias("note_slug"))
    return out.unionByName(back).distinct()


def connections(links: DataFrame, aliases: DataFrame, notes: DataFrame, slug: str, hops: int = 2, skip_attachments: bool = True) -> DataFrame:
    """Everything within ``hops`` links of a note, direction aside, phantoms among it; nearest first, then by title.

    Each hop is one join of the last hop's notes with the edges, written to the shared folder.
    """
    rows = _kept(links, skip_attachments)
    both = materialise(outgoing(rows, aliases).unionByName(incoming(rows, aliases)).distinct(), "edges")
    front = links.sparkSession.range(1).select(F.lit(slug).alias("note_slug"))
    seen = front.withColumn("score", F.lit(0))
    for hop in range(1, hops + 1):
        new = both.join(front.withColumnRenamed("note_slug", "a"), "a").select(F.col("b").alias("note_slug")).distinct().join(seen, "note_slug", "left_anti")
        front = materialise(new, "hop")
        seen = seen.unionByName(front.withColumn("score", F.lit(hop)))
        if hop < hops and front.isEmpty():
            break
    found = _headed(seen.where("score > 0"), notes)
    return found.withColumn("extra", F.concat(F.col("score").cast("string"), F.lit(" hop(s)"))).orderBy("score", "title", "note_slug")

