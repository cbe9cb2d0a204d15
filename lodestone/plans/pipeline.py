"""Queries of the ingest, output and scalar operators, and their SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import scalars as S
from lodestone.operators import filters, ingest, output
from lodestone.operators.records import latest
from lodestone.plans.vault import C, L, chunks, heads, raw_links, sql_slug
from lodestone.scratch import remembered, shared_dir, spread, state_of
from lodestone.sources import vault
from lodestone.sources.store import Store

SETTINGS = ingest.Settings()


def _registry(spark: SparkSession, d: str) -> DataFrame:
    """The notes that are indexed now, the last period of each."""
    rows = spark.read.parquet(f"{d}/notes.parquet").where("deleted_at is null")
    return latest(rows, "note_slug", "indexed_at", "note_slug", "indexed_at", "content_hash", "file_type", "file_path")


def change_detect(spark: SparkSession, d: str) -> DataFrame:
    """Registered notes whose content is not the one that was cut into chunks."""
    return ingest.changed(_registry(spark, d), heads(spark, d)).select("note_slug")


def stale_detect(spark: SparkSession, d: str) -> DataFrame:
    """Notes with chunks that are not registered any more; PDFs stay."""
    return ingest.stale(heads(spark, d), _registry(spark, d))


def _replaced(spark: SparkSession, d: str) -> Store:
    """A store of all chunks and links after the notes of the folder ``Daily`` were replaced by their first chunks, without links, and
    the stale ones deleted."""

    def make() -> Store:
        store = Store(spark, f"{shared_dir(spark)}/lodestone/store-{uuid.uuid4().hex}", buckets=16)
        every = chunks(spark, d)
        store.replace(every, raw_links(spark, d))
        new = every.where("file_path like 'Daily/%' and chunk_index = 0").withColumn("title", F.upper("title"))
        gone = ingest.stale(store.chunks.where("chunk_index = 0"), _registry(spark, d))
        store.replace(new, spark.createDataFrame([], "source_slug string, raw string"), gone)
        return store

    def kept() -> tuple[Store, DataFrame]:
        store = make()
        return store, store.chunks  # which shows whether its tables are still there

    return remembered(state_of(*[spark.read.parquet(f"{d}/{t}.parquet") for t in ("chunks", "ingest_batches", "notes")]), "replaced", kept)[0]


def replace_by_key(spark: SparkSession, d: str) -> DataFrame:
    return _replaced(spark, d).chunks.select("id", "note_slug", "title")


def store_links(spark: SparkSession, d: str) -> DataFrame:
    """The store's links after that, to the notes that are left."""
    return _replaced(spark, d).links.select("source_slug", "target_slug", "target_path")


def store_check(spark: SparkSession, d: str) -> DataFrame:
    """The faults of a reset store, and of the store above but for links of unknown notes, which raw links bring along."""
    store = _replaced(spark, d)
    empty = Store(spark, f"{store.path}-reset", buckets=4)
    empty.replace(store.chunks, store.raw_links)
    empty.reset()
    found = [("reset", k, v) for k, v in {**empty.check(), "chunks": empty.chunks.count()}.items()] + [("replaced", k, v) for k, v in store.check().items() if k in ("repeated ids", "notes without first chunk")]
    return spark.createDataFrame(found, "store string, fault string, n long")


#: Patterns of paths; the SQL has a condition for each.
GLOBS = ("Daily/**", "*.md", "**/*a*.md", "{Projects,Daily}/*")
EXCLUDES = ["Daily/", "**/*-1*", "Proj*"]


def glob_filter(spark: SparkSession, d: str) -> DataFrame:
    """The registered paths that each of some patterns lets pass."""
    paths = spark.read.parquet(f"{d}/notes.parquet").select("file_path").distinct()
    return reduce(DataFrame.unionByName, [vault.wanted_files(paths, g, True).select(F.lit(g).alias("glob"), "file_path") for g in GLOBS])


def exclude_filter(spark: SparkSession, d: str) -> DataFrame:
    """The registered paths of Markdown files that some excludes leave."""
    return vault.wanted_files(spark.read.parquet(f"{d}/notes.parquet").select("file_path").distinct(), excludes=EXCLUDES)


def results_shown(spark: SparkSession, d: str) -> DataFrame:
    """The recorded results from a score of 0.3 on as they are shown: without phantoms, tags and paths."""
    rows = latest(spark.read.parquet(f"{d}/search_results.parquet"), "result_id", "loaded_at", "result_id", "loaded_at", "score", "is_phantom", "tags", "file_path", "lexical")
    shown = filters.present(rows.where("not isnan(score)"), 0.3, mask=("tags", "file_path"))
    return shown.select("result_id", "score", F.size(F.coalesce("tags", F.array())).alias("n_tags"), F.coalesce("file_path", F.lit("-")).alias("file_path"), S.score_band(F.col("score")).alias("band"))


def heading_labels(spark: SparkSession, d: str) -> DataFrame:
    """How a deep search names each chunk, with its own title and one that its heading repeats."""
    rows = chunks(spark, d, "title", "heading_path", "chunk_index")
    first = F.element_at(F.split("heading_path", " > "), 1)
    longer = F.concat(first, F.lit(" and more"))
    label = lambda t: S.deep_label(F.col("heading_path"), t, F.col("chunk_index"))
    return rows.select("id", label(F.col("title")).alias("label"), label(longer).alias("of_longer_title"))


def embed_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Aliases of raw links, and the numbers of chunks and links, that are sizes of an embedded image."""
    alias = raw_links(spark, d).where("raw like '%|%'").select(F.substring_index("raw", "|", -1).alias("alias"))
    made = chunks(spark, d, "chunk_index").select(F.explode(F.array(F.col("chunk_index").cast("string"), F.concat(F.col("chunk_index").cast("string"), F.lit("x20")), F.concat(F.lit(" X"), F.col("chunk_index").cast("string")), F.concat(F.col("chunk_index").cast("string"), F.lit("px")))).alias("alias"))
    return alias.unionByName(made).distinct().select("alias", S.is_numeric_size(F.col("alias")).alias("is_size"))


def chunk_filter(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of ten words or more, numbered anew within their note."""
    rows = chunks(spark, d, "note_slug", "chunk_index", "file_path", "text").withColumn("plain", F.col("text")).withColumn("position", F.col("chunk_index")).withColumn("error", F.lit(None).cast("string"))
    return ingest.numbered(rows.withColumnRenamed("id", "old_id").drop("chunk_index"), SETTINGS).select("old_id", "id", "chunk_index")


def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return chunks(spark, d, "text", "tags", "file_path").select("id", S.estimated_tokens(text).alias("tokens"), S.word_count(text).cast("long").alias("words"), S.tag_chips(F.col("tags")).alias("chips"), S.open_uri("app", "my vault", F.col("file_path")).alias("uri"), S.basename(F.col("file_path")).alias("base"))


def tsv_rows(spark: SparkSession, d: str) -> DataFrame:
    """The recorded results as tab-separated lines."""
    rows = latest(spark.read.parquet(f"{d}/search_results.parquet"), "result_id", "loaded_at", "result_id", "loaded_at", "note_slug", "title", "file_path", "score", "tags", "extra", "heading_path", "text")
    return output.tsv_rows(rows.where("score is not null and not isnan(score)"))


def json_rows(spark: SparkSession, d: str) -> DataFrame:
    """The recorded results as JSON objects without empty fields."""
    rows = latest(spark.read.parquet(f"{d}/search_results.parquet"), "result_id", "loaded_at", "note_slug", "title", "score", "chunk_index", "tags", "extra", "heading_path", "lexical", "loaded_at", "result_id")
    return output.json_rows(rows.drop("result_id", "loaded_at"))


def markdown_parse(spark: SparkSession, d: str) -> DataFrame:
    """Every document parsed as a note and cut into chunks."""
    docs = spread(spark.read.parquet(f"{d}/documents.parquet").where("text is not null"))
    files = docs.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_path"), F.encode("text", "utf-8").alias("content"), F.lit(None).cast("string").alias("error"))
    rows = ingest.numbered(ingest.parsed(ingest.hashed(files, SETTINGS, "m"), SETTINGS), SETTINGS)
    return rows.select("id", "note_slug", "title", "heading_path", "heading_level", "has_task", "has_code", F.size("tags").alias("n_tags"), F.size("links").alias("n_links"), F.length("text").alias("n_chars"))


def feature_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk's text embedded by feature hashing; how many components are used."""
    made = ingest.embedded(chunks(spark, d, "text").select("id", "text"), "text", ingest.HashingEmbedder(64))
    return made.select("id", F.size(F.filter("embedding", lambda x: x != 0)).alias("n_used"))


_FIELD = lambda c, keep="true": f"CASE WHEN {c} IS NOT NULL AND {keep} THEN '\"{c}\":' || to_json({c}) END"
_OBJECT = ", ".join([_FIELD("note_slug"), _FIELD("title"), "CASE WHEN score IS NOT NULL THEN '\"score\":' || CASE WHEN isnan(score) THEN '\"NaN\"' ELSE to_json(score) END END", _FIELD("chunk_index", "chunk_index <> 0"), _FIELD("tags", "len(tags) > 0"), _FIELD("extra", "extra <> ''"), _FIELD("heading_path", "heading_path <> ''"), _FIELD("lexical", "lexical")])
_NOW = "nw AS (SELECT * FROM notes WHERE deleted_at IS NULL AND note_slug IS NOT NULL QUALIFY row_number() OVER (PARTITION BY note_slug ORDER BY indexed_at DESC NULLS LAST, content_hash DESC NULLS LAST, file_type DESC NULLS LAST, file_path DESC NULLS LAST) = 1)"
_GONE = "gone AS (SELECT note_slug FROM h WHERE file_type <> 'pdf' AND note_slug NOT IN (SELECT note_slug FROM nw))"
_WORDS = r"(CASE WHEN regexp_replace(text, '^\s+|\s+$', '', 'g') = '' THEN 0 ELSE len(string_split_regex(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')) END)"


def _escaped(c: str) -> str:
    return f"replace(replace(replace(replace(coalesce({c}::VARCHAR, ''), '\\', '\\\\'), chr(9), '\\t'), chr(10), '\\n'), chr(13), '\\r')"


SQL = {
    "change_detect": f"WITH {C}, {_NOW} SELECT nw.note_slug FROM nw LEFT JOIN h USING (note_slug) WHERE nw.content_hash IS DISTINCT FROM h.content_hash",
    "stale_detect": f"WITH {C}, {_NOW}, {_GONE} SELECT note_slug FROM gone",
    "replace_by_key": f"WITH {C}, {_NOW}, {_GONE}, nu AS (SELECT id, note_slug, upper(title) AS title FROM h WHERE file_path LIKE 'Daily/%') SELECT id, note_slug, title FROM c WHERE note_slug NOT IN (SELECT note_slug FROM nu) AND note_slug NOT IN (SELECT note_slug FROM gone) UNION ALL SELECT * FROM nu",
    "chunk_filter": f"WITH {C}, k AS (SELECT id AS old_id, note_slug, row_number() OVER (PARTITION BY note_slug ORDER BY file_path, chunk_index) - 1 AS chunk_index FROM c WHERE {_WORDS} >= 10) SELECT old_id, note_slug || ':' || chunk_index AS id, chunk_index FROM k",
    "scalar_functions": f"WITH {C} SELECT id, ceil(length(text) / 4.0)::BIGINT AS tokens, {_WORDS} AS words, array_to_string(list_transform(tags, lambda t: '#' || t), ' ') AS chips, 'app://open?vault=my%20vault&file=' || replace(url_encode(file_path), '%2A', '*') AS uri, regexp_replace(file_path, '^.*/', '', 's') AS base FROM c",
    "tsv_rows": f"WITH r AS (SELECT * FROM search_results WHERE result_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY loaded_at DESC NULLS LAST, note_slug DESC NULLS LAST, title DESC NULLS LAST, file_path DESC NULLS LAST, score DESC NULLS LAST, tags DESC NULLS LAST, extra DESC NULLS LAST, heading_path DESC NULLS LAST, text DESC NULLS LAST) = 1) SELECT concat_ws(chr(9), {_escaped('note_slug')}, {_escaped('title')}, {_escaped('file_path')}, printf('%f', score), coalesce(array_to_string(tags, ','), ''), {_escaped('extra')}, {_escaped('heading_path')}, {_escaped('text')}) AS line FROM r WHERE score IS NOT NULL AND NOT isnan(score)",
}
_PLAIN = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
_FORMS2 = ", ".join(f"{x}, lower({x}), {sql_slug(x)}" for x in ("title", "file_path", "regexp_replace(file_path, '^.*/', '', 's')", "regexp_replace(regexp_replace(file_path, '^.*/', '', 's'), '\\.(md|pdf)$', '', 'i')"))


def _label(title: str) -> str:
    first, a, b = "string_split(heading_path, ' > ')[1]", _PLAIN.format(title), _PLAIN.format("string_split(heading_path, ' > ')[1]")
    rest = "array_to_string(string_split(heading_path, ' > ')[2:], ' > ')"
    short = f"CASE WHEN {a} <> '' AND ({a} = {b} OR (least(length({a}), length({b})) >= 12 AND (starts_with({a}, {b}) OR starts_with({b}, {a})))) THEN {rest} ELSE heading_path END"
    return f"CASE WHEN trim(heading_path) <> '' THEN '§ ' || {short} WHEN chunk_index = 0 AND trim(coalesce({title}, '')) <> '' THEN '§ ' || trim({title}) WHEN chunk_index = 0 THEN '§ (intro)' ELSE 'chunk #' || (chunk_index + 1) END"


SQL |= {
    "store_links": f"""WITH {L}, {_NOW}, {_GONE},
h2 AS (SELECT note_slug, CASE WHEN file_path LIKE 'Daily/%' THEN upper(title) ELSE title END AS title, file_path FROM h WHERE file_path LIKE 'Daily/%' OR note_slug NOT IN (SELECT note_slug FROM gone)),
a2 AS (SELECT key, arg_min(note_slug, (prio, note_slug)) AS note_slug FROM (SELECT note_slug AS key, 0 AS prio, note_slug FROM h2 UNION ALL SELECT unnest([{_FORMS2}]), 1, note_slug FROM h2) WHERE key <> '' GROUP BY key),
n2 AS (SELECT * FROM nl WHERE source_slug IN (SELECT note_slug FROM c) AND source_slug NOT IN (SELECT note_slug FROM gone) AND source_slug NOT IN (SELECT note_slug FROM h WHERE file_path LIKE 'Daily/%')),
s2 AS (SELECT source_slug, coalesce(t1.note_slug, t2.note_slug, t3.note_slug, {sql_slug("name")}) AS target_slug, min(raw) AS target_path FROM n2 LEFT JOIN a2 t1 ON t1.key = name LEFT JOIN a2 t2 ON t2.key = lower(name) LEFT JOIN a2 t3 ON t3.key = {sql_slug("name")} GROUP BY 1, 2)
SELECT * FROM s2 WHERE target_slug <> ''""",
    "store_check": "SELECT * FROM (VALUES ('reset', 'repeated ids', 0::BIGINT), ('reset', 'notes without first chunk', 0), ('reset', 'links of unknown notes', 0), ('reset', 'slugs of several files', 0), ('reset', 'chunks', 0), ('replaced', 'repeated ids', 0), ('replaced', 'notes without first chunk', 0)) AS t(store, fault, n)",
    "glob_filter": """WITH p AS (SELECT DISTINCT file_path AS f FROM notes WHERE regexp_matches(file_path, '\\.(md|pdf)$', 'i') AND NOT regexp_matches(file_path, '(^|/)\\.'))
SELECT 'Daily/**' AS glob, f AS file_path FROM p WHERE f LIKE 'Daily/%' UNION ALL SELECT '*.md', f FROM p WHERE f LIKE '%.md' AND f NOT LIKE '%/%'
UNION ALL SELECT '**/*a*.md', f FROM p WHERE regexp_matches(f, '^(.*/)?[^/]*a[^/]*\\.md$') UNION ALL SELECT '{Projects,Daily}/*', f FROM p WHERE (f LIKE 'Projects/%' OR f LIKE 'Daily/%') AND len(string_split(f, '/')) = 2""",
    "exclude_filter": """SELECT DISTINCT file_path FROM notes WHERE regexp_matches(file_path, '\\.md$', 'i') AND NOT regexp_matches(file_path, '(^|/)\\.') AND NOT starts_with(file_path, 'Daily/')
AND len(list_filter(string_split(file_path, '/'), lambda x: regexp_matches(x, '^.*-1.*$') OR starts_with(x, 'Proj'))) = 0""",
    "results_shown": """WITH r AS (SELECT * FROM search_results WHERE result_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY loaded_at DESC NULLS LAST, score DESC NULLS LAST, is_phantom DESC NULLS LAST, tags DESC NULLS LAST, file_path DESC NULLS LAST, lexical DESC NULLS LAST) = 1)
SELECT result_id, round(score, 4) AS score, 0::INT AS n_tags, '-' AS file_path, CASE WHEN round(score, 4) >= 0.75 THEN 'high' WHEN round(score, 4) >= 0.5 THEN 'medium' ELSE 'low' END AS band FROM r WHERE NOT isnan(score) AND (score >= 0.3 OR coalesce(lexical, false)) AND NOT coalesce(is_phantom, false)""",
    "heading_labels": f"WITH {C}, x AS (SELECT *, string_split(heading_path, ' > ')[1] || ' and more' AS longer FROM c) SELECT id, {_label('title')} AS label, {_label('longer')} AS of_longer_title FROM x",
    "embed_sizes": f"""WITH {L}, x AS (SELECT DISTINCT alias FROM (SELECT string_split(raw, '|')[-1] AS alias FROM rl WHERE raw LIKE '%|%' UNION ALL SELECT unnest([chunk_index::VARCHAR, chunk_index || 'x20', ' X' || chunk_index, chunk_index || 'px']) FROM c))
SELECT alias, regexp_full_match(trim(alias), '[0-9xX]+') AND regexp_matches(alias, '[0-9]') AS is_size FROM x""",
}
SQL["json_rows"] = f"WITH r AS (SELECT * FROM search_results WHERE result_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY loaded_at DESC NULLS LAST, note_slug DESC NULLS LAST, title DESC NULLS LAST, score DESC NULLS LAST, chunk_index DESC NULLS LAST, tags DESC NULLS LAST, extra DESC NULLS LAST, heading_path DESC NULLS LAST, lexical DESC NULLS LAST) = 1) SELECT '{{' || array_to_string(list_filter([{_OBJECT}], lambda x: x IS NOT NULL), ',') || '}}' AS json FROM r"
QUERIES = {f.__name__: f for f in (change_detect, stale_detect, replace_by_key, store_links, store_check, glob_filter, exclude_filter, results_shown, heading_labels, embed_sizes, chunk_filter, scalar_functions, tsv_rows, json_rows, markdown_parse, feature_vectors)}
