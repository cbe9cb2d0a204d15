"""The vault tables as the operators take them, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import graph
from lodestone.operators.records import latest
from lodestone.scratch import materialise, remembered, state_of


NAMES = ("id", "note_slug", "title", "file_path", "chunk_index", "heading_path", "heading_level", "has_task", "has_code", "file_type", "content_hash", "tags", "text", "embedding")


def chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The latest delivery of every chunk, of all or some columns; missing texts are empty, missing flags false, missing tags none."""
    names = [n for n in NAMES if n in (*columns, "id")] if columns else list(NAMES)
    rows = latest(spark.read.parquet(f"{d}/chunks.parquet"), "id", "ingested_at", *names)
    empty = {c: F.coalesce(F.col(c), F.lit("")) for c in ("title", "file_path", "heading_path", "file_type", "content_hash", "text")}
    flags = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("has_task", "has_code")}
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("chunk_index", "heading_level")}
    tags = {"tags": F.coalesce("tags", F.array().cast("array<string>"))}
    return rows.withColumns({c: f for c, f in (empty | flags | zero | tags).items() if c in names})


def heads(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The first chunk of every note."""
    return chunks(spark, d, *(columns or ("note_slug", "title", "file_path", "file_type", "content_hash", "tags")), "chunk_index").where("chunk_index = 0")


def raw_links(spark: SparkSession, d: str) -> DataFrame:
    """``(source_slug, raw)``: the links of the last run over each note."""
    rows = latest(spark.read.parquet(f"{d}/ingest_batches.parquet"), "batch_id", "loaded_at", "batch_id", "note_slug", "loaded_at", "run_at", "links")
    rows = rows.withColumn("at", F.struct(F.coalesce("run_at", "loaded_at").alias("at"), "batch_id"))
    last = rows.groupBy("note_slug").agg(F.max(F.struct("at", "links")).alias("r"))
    return last.select(F.col("note_slug").alias("source_slug"), F.explode("r.links").alias("raw"))


def _vault_state(spark: SparkSession, d: str) -> tuple | None:
    return state_of(spark.read.parquet(f"{d}/chunks.parquet"), spark.read.parquet(f"{d}/ingest_batches.parquet"))


def linked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links, aliases and note headers, as a store keeps them: written once while the vault's tables stay the same."""

    def make() -> tuple[DataFrame, DataFrame, DataFrame]:
        notes = materialise(heads(spark, d, "note_slug", "title", "file_path", "file_type").drop("id", "chunk_index"), "notes")
        aliases = materialise(graph.alias_table(notes), "aliases")
        return materialise(graph.resolve_links(raw_links(spark, d), aliases), "links"), aliases, notes

    return remembered(_vault_state(spark, d), "linked", make)


def seeds(spark: SparkSession, d: str, n: int) -> list[list[float]]:
    """The vectors of the first ``n`` chunks that have one, by id."""
    usable = chunks(spark, d, "embedding").where((F.size("embedding") == 64) & F.exists("embedding", lambda x: x != 0))
    return [list(r["embedding"]) for r in usable.select("id", "embedding").orderBy("id").limit(n).collect()]


def hub(spark: SparkSession, d: str) -> str:
    """The note with the most incoming links."""

    def make() -> str:
        links, _, notes = linked(spark, d)
        met = links.groupBy("target_slug").count().join(notes.select(F.col("note_slug").alias("target_slug")), "target_slug", "left_semi")
        row = met.orderBy(F.col("count").desc(), "target_slug").first()
        return row["target_slug"] if row else ""

    return remembered(_vault_state(spark, d), "hub", make)


def sql_slug(x: str) -> str:
    low = f"lower(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'))"
    cut = f"regexp_replace(regexp_replace({low}, '\\.md$', ''), '\\.pdf$', '-pdf')"
    kept = f"regexp_replace(replace({cut}, ' ', '-'), '[^\\p{{L}}\\p{{N}}\\-]+', '', 'g')"
    return f"regexp_replace(regexp_replace({kept}, '-+', '-', 'g'), '^-|-$', '', 'g')"


def sql_base(x: str) -> str:
    return f"regexp_replace({x}, '^.*/', '', 's')"


def sql_stem(x: str) -> str:
    return f"regexp_replace({sql_base(x)}, '\\.(md|pdf)$', '', 'i')"


_NAME = "trim(regexp_replace(raw, '[#|].*$', '', 's'))"
# Written by hand, so that they check the module's list.
SQL_IMAGES = "'png', 'jpg', 'jpeg', 'gif', 'svg', 'webp', 'avif', 'bmp', 'tiff', 'ico', 'heic'"
SQL_OTHERS = "'mp4', 'webm', 'mov', 'mkv', 'avi', 'mp3', 'wav', 'ogg', 'flac', 'm4a', 'aac', 'canvas', 'excalidraw', 'zip', 'gz', 'tar', '7z', 'rar', 'docx', 'pptx', 'xlsx', 'epub'"
_FILES = f"{SQL_IMAGES}, {SQL_OTHERS}"
C = f"""c AS (SELECT id, note_slug, coalesce(title, '') AS title, coalesce(file_path, '') AS file_path, coalesce(chunk_index, 0) AS chunk_index, coalesce(heading_path, '') AS heading_path, coalesce(heading_level, 0) AS heading_level,
  coalesce(has_task, false) AS has_task, coalesce(has_code, false) AS has_code, coalesce(file_type, '') AS file_type, coalesce(content_hash, '') AS content_hash, coalesce(tags, []) AS tags, coalesce(text, '') AS text, embedding
  FROM chunks WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST) = 1),
h AS (SELECT * FROM c WHERE chunk_index = 0),
v AS (SELECT *, embedding::DOUBLE[] AS e FROM c WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"""
_FORMS = ", ".join(f"{x}, lower({x}), {sql_slug(x)}" for x in ("title", "file_path", sql_base("file_path"), sql_stem("file_path")))
L = f"""{C},
al AS (SELECT key, arg_min(note_slug, (prio, note_slug)) AS note_slug FROM (SELECT note_slug AS key, 0 AS prio, note_slug FROM h UNION ALL SELECT unnest([{_FORMS}]), 1, note_slug FROM h) WHERE key <> '' GROUP BY key),
ib AS (SELECT * FROM ingest_batches WHERE batch_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY loaded_at DESC NULLS LAST, note_slug DESC NULLS LAST) = 1),
lb AS (SELECT * FROM ib QUALIFY row_number() OVER (PARTITION BY note_slug ORDER BY coalesce(run_at, loaded_at) DESC NULLS LAST, batch_id DESC) = 1),
rl AS (SELECT note_slug AS source_slug, unnest(links) AS raw FROM lb),
nl AS (SELECT source_slug, raw, {_NAME} AS name FROM rl WHERE raw IS NOT NULL AND {_NAME} <> '' AND lower(regexp_extract({_NAME}, '\\.([A-Za-z0-9]+)$', 1)) NOT IN ({_FILES})),
ls AS (SELECT source_slug, coalesce(t1.note_slug, t2.note_slug, t3.note_slug, {sql_slug("name")}) AS target_slug, min(raw) AS target_path FROM nl LEFT JOIN al t1 ON t1.key = name LEFT JOIN al t2 ON t2.key = lower(name) LEFT JOIN al t3 ON t3.key = {sql_slug("name")} GROUP BY 1, 2),
l AS (SELECT * FROM ls WHERE target_slug <> ''),
cd AS (SELECT key, note_slug FROM al UNION SELECT {sql_slug("key")}, note_slug FROM al WHERE {sql_slug("key")} <> ''),
outt AS (SELECT source_slug AS a, coalesce(a.note_slug, b.note_slug, target_slug) AS b FROM l LEFT JOIN al a ON a.key = target_slug LEFT JOIN al b ON b.key = target_path),
inn AS (SELECT DISTINCT a, coalesce(s.note_slug, source_slug) AS b FROM (SELECT target_slug AS a, source_slug FROM l UNION SELECT target_path, source_slug FROM l
  UNION SELECT cd.note_slug, source_slug FROM l JOIN cd ON cd.key = target_slug UNION SELECT cd.note_slug, source_slug FROM l JOIN cd ON cd.key = target_path) LEFT JOIN al s ON s.key = source_slug),
hub AS (SELECT target_slug AS slug FROM l WHERE target_slug IN (SELECT note_slug FROM h) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"""
