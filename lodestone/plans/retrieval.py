"""Queries of the retrieval operators over the vault tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import scalars as S
from lodestone.operators import filters, graph, hybrid, lexical, notes, tags, vector
from lodestone.operators.index import VectorIndex
from lodestone.plans.vault import SQL_IMAGES, SQL_OTHERS, C, L, chunks, heads, hub, linked, raw_links, seeds, sql_slug, sql_stem
from lodestone.scratch import shared_dir

SHOWN = ("id", "note_slug", "round(score, 4) AS score")
# Columns that the searches need; the others are never read.
VECTORS = ("note_slug", "chunk_index", "embedding")
TEXTS = ("note_slug", "chunk_index", "heading_path", "heading_level", "text", "title", "file_path", "tags")
WORDS, TAG = "garden printer maintenance router budget", "project"


def _joined(c: str):
    return F.array_join(c, "|")


def semantic_topk(spark: SparkSession, d: str) -> DataFrame:
    return vector.semantic_search(chunks(spark, d, *VECTORS), seeds(spark, d, 1)[0]).selectExpr(*SHOWN)


def semantic_exact(spark: SparkSession, d: str) -> DataFrame:
    return vector.semantic_search(chunks(spark, d, *VECTORS), seeds(spark, d, 1)[0], 50, 2, exact=True).selectExpr(*SHOWN)


def semantic_filtered(spark: SparkSession, d: str) -> DataFrame:
    where = filters.SearchFilter(has_task=True, exclude=("running-capture-log",)).column()
    return vector.semantic_search(chunks(spark, d, *VECTORS, "has_task", "file_type"), seeds(spark, d, 1)[0], 20, 1, where).selectExpr(*SHOWN)


def _index(spark: SparkSession, d: str) -> VectorIndex:
    path = f"{shared_dir(spark)}/lodestone/index-{uuid.uuid4().hex}"
    return VectorIndex.build(chunks(spark, d, *VECTORS), path, 64)


def index_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether the index finds nine in ten of the ten nearest rows, for every twentieth row (by the hash of its id) against all."""
    index = _index(spark, d)
    asked = index.rows.where(F.pmod(F.xxhash64("id"), F.lit(20)) == 0).select(F.col("id").alias("query"), "embedding")
    found = index.nearest(asked, 10)
    every = index.nearest(asked, 10, len(index.centres))
    met = every.join(found.select("query", "id", F.lit(1).alias("hit")), ["query", "id"], "left")
    return met.agg((F.sum(F.coalesce("hit", F.lit(0))) >= 0.9 * F.count("*")).alias("enough"))


def index_exact(spark: SparkSession, d: str) -> DataFrame:
    """The nearest chunks from all cells of the index."""
    index = _index(spark, d)
    return index.search(seeds(spark, d, 1)[0], reads=len(index.centres)).selectExpr(*SHOWN)


def multi_query_rank(spark: SparkSession, d: str) -> DataFrame:
    return vector.multi_search(chunks(spark, d, *VECTORS), seeds(spark, d, 3), ["", "", ""]).select("id", "n_queries", F.round("score", 4).alias("score"))


def multi_query_attribution(spark: SparkSession, d: str) -> DataFrame:
    return vector.multi_search(chunks(spark, d, *VECTORS), seeds(spark, d, 3), ["", "", ""], 20).select("id", _joined("matched_queries").alias("matched"))


def min_score_round(spark: SparkSession, d: str) -> DataFrame:
    found = vector.semantic_search(chunks(spark, d, *VECTORS), seeds(spark, d, 1)[0], 100, 100)
    return filters.present(found, 0.3).select("id", "score")


def group_by_note(spark: SparkSession, d: str) -> DataFrame:
    """The recorded results of every note in one row, in the order of their ids."""
    rows = spark.read.parquet(f"{d}/search_results.parquet").where("note_slug is not null and score is not null and not isnan(score)").groupBy("result_id").agg(F.max(F.struct("loaded_at", "note_slug", "score")).alias("r"))
    rows = rows.select(F.col("result_id").alias("position"), "r.note_slug", "r.score")
    return notes.group_by_note(rows).select("note_slug", "position", "score", "extra")


def lexical_search(spark: SparkSession, d: str) -> DataFrame:
    return lexical.lexical_search(chunks(spark, d, *TEXTS, "file_type"), WORDS).select("note_slug", "hits")


def tag_exact(spark: SparkSession, d: str) -> DataFrame:
    return tags.tag_search(chunks(spark, d, "note_slug", "chunk_index", "title", "tags"), "#Meeting").select("note_slug", "title", "id")


def tag_children(spark: SparkSession, d: str) -> DataFrame:
    return tags.tag_search(chunks(spark, d, "note_slug", "chunk_index", "title", "tags"), TAG, None, True).select("note_slug", "title", "id")


def tag_list(spark: SparkSession, d: str) -> DataFrame:
    return tags.list_tags(heads(spark, d))


def tag_suggest(spark: SparkSession, d: str) -> DataFrame:
    return tags.suggest_tags(heads(spark, d), "meting", 5)


def shared_tags(spark: SparkSession, d: str) -> DataFrame:
    return tags.shared_tags(heads(spark, d), hub(spark, d)).select("note_slug", "score", _joined("tags").alias("tags"))


def alias_table(spark: SparkSession, d: str) -> DataFrame:
    return linked(spark, d)[1]


def link_resolve(spark: SparkSession, d: str) -> DataFrame:
    return linked(spark, d)[0]


def backlinks(spark: SparkSession, d: str) -> DataFrame:
    links, aliases, heads_ = linked(spark, d)
    return graph.backlinks(links, aliases, heads_, hub(spark, d)).select("note_slug", "title", "extra", "is_phantom")


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    links, aliases, _ = linked(spark, d)
    return graph.linked_slugs(links, aliases, hub(spark, d))


def _connected(spark: SparkSession, d: str, hops: int) -> DataFrame:
    links, aliases, heads_ = linked(spark, d)
    return graph.connections(links, aliases, heads_, hub(spark, d), hops)


def connections_1hop(spark: SparkSession, d: str) -> DataFrame:
    return _connected(spark, d, 1).select("note_slug", "title", "score", "extra", "is_phantom")


def connections_2hop(spark: SparkSession, d: str) -> DataFrame:
    return _connected(spark, d, 2).select("note_slug", "title", "score", "extra", "is_phantom")


def phantom_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _connected(spark, d, 2).where("is_phantom").select("note_slug", "score")


def hidden_unlinked(spark: SparkSession, d: str) -> DataFrame:
    links, aliases, _ = linked(spark, d)
    return hybrid.hidden(chunks(spark, d, *VECTORS), links, aliases, seeds(spark, d, 1)[0], hub(spark, d)).selectExpr(*SHOWN)


def hidden_include_linked(spark: SparkSession, d: str) -> DataFrame:
    links, aliases, _ = linked(spark, d)
    return hybrid.hidden(chunks(spark, d, *VECTORS), links, aliases, seeds(spark, d, 1)[0], hub(spark, d), include_linked=True).selectExpr(*SHOWN)


def hidden_deep(spark: SparkSession, d: str) -> DataFrame:
    links, aliases, _ = linked(spark, d)
    return hybrid.hidden_deep(chunks(spark, d, *VECTORS, "heading_path", "title"), links, aliases, hub(spark, d)).select("id", "n_queries", F.round("score", 4).alias("score"))


def graph_boosted(spark: SparkSession, d: str) -> DataFrame:
    links, aliases, _ = linked(spark, d)
    return hybrid.boosted(chunks(spark, d, *VECTORS), links, aliases, seeds(spark, d, 1)[0], hub(spark, d)).selectExpr(*SHOWN, "extra")


def note_reconstruct(spark: SparkSession, d: str) -> DataFrame:
    """Every note as one text, by its hash."""
    return notes.note_texts(chunks(spark, d, *TEXTS)).select("note_slug", "n_chunks", F.md5("content").alias("content_md5"))


def note_head(spark: SparkSession, d: str) -> DataFrame:
    return notes.get_note(chunks(spark, d, *TEXTS), hub(spark, d), 1).select("note_slug", "title", "total", "content")


def note_meta(spark: SparkSession, d: str) -> DataFrame:
    return notes.note_meta(chunks(spark, d, "note_slug", "chunk_index", "title", "file_path", "file_type", "content_hash"))


def context_window(spark: SparkSession, d: str) -> DataFrame:
    """One chunk of context on either side of every chunk."""
    every = chunks(spark, d, "note_slug", "chunk_index", "text")
    return notes.with_context(every.select("id", "note_slug", "chunk_index"), every, 1).select("id", F.md5(_joined("context")).alias("context_md5"), F.size("context").cast("long").alias("n"))


def resolve_name(spark: SparkSession, d: str) -> DataFrame:
    """Every recorded title as a name, and every slug's last word."""
    notes_ = heads(spark, d)
    asked = notes_.select(F.col("title").alias("input")).unionByName(notes_.select(F.element_at(F.split("note_slug", "-"), -1).alias("input"))).where("input <> ''")
    return notes.resolve_names(notes_, asked).select("input", "note_slug", "status", "n_candidates")


def name_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Slugs and paths of four notes, which name them whatever else they fit, and what names none."""
    notes_ = heads(spark, d)
    four = notes_.where("file_path <> ''").orderBy("note_slug").limit(4).collect()
    out = []
    for name in [*(r["note_slug"] for r in four), *(f" {r['file_path']} " for r in four), "no such note at all", " "]:
        try:
            out.append((name, notes.resolve_name(notes_, name)))
        except LookupError:
            out.append((name, "-"))
    return spark.createDataFrame(out, "name string, note_slug string")


def slug_list(spark: SparkSession, d: str) -> DataFrame:
    return notes.slugs(heads(spark, d))


def limit_clamped(spark: SparkSession, d: str) -> DataFrame:
    """A limit of 500, of which 100 are given."""
    return vector.semantic_search(chunks(spark, d, *VECTORS), seeds(spark, d, 1)[0], 500, 100).selectExpr(*SHOWN)


def fallback_search(spark: SparkSession, d: str) -> DataFrame:
    """Keyword hits, as no chunk is as similar as asked."""
    found = vector.semantic_search(chunks(spark, d, *VECTORS), seeds(spark, d, 1)[0])
    if not lexical.needs_fallback(found, 1.01) or lexical.needs_fallback(found, 0.5):
        return found.selectExpr("note_slug", "0L AS hits")
    return lexical.lexical_search(chunks(spark, d, *TEXTS, "file_type"), WORDS, 20).select("note_slug", "hits")


def stats(spark: SparkSession, d: str) -> DataFrame:
    return notes.stats(chunks(spark, d, "note_slug", "chunk_index"), linked(spark, d)[0])


def slugify(spark: SparkSession, d: str) -> DataFrame:
    raw = raw_links(spark, d).where("raw is not null")
    return raw.select("raw", S.slugify(F.col("raw")).alias("slug"), S.title_from_path(F.col("raw")).alias("title")).distinct()


ENDINGS = ".7z .rar .aac .epub .tif .csv .json .html .PNG .gz#x .mp3|y .md".split()


def attachment_flag(spark: SparkSession, d: str) -> DataFrame:
    """Raw links as they are, and with each of some endings."""
    raw = raw_links(spark, d).where("raw is not null")
    raw = raw.select(F.explode(F.array("raw", *[F.concat("raw", F.lit(e)) for e in ENDINGS])).alias("raw"))
    return raw.select("raw", S.attachment_kind(F.col("raw")).alias("kind")).distinct()


def content_hash(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").where("text is not null")
    return docs.select("doc_id", S.content_hash(F.col("text"), 800, 100, "m").alias("hash"))


def embed_text(spark: SparkSession, d: str) -> DataFrame:
    built = S.embed_text(F.col("title"), F.col("heading_path"), F.col("tags"), F.col("text"), 160)
    return chunks(spark, d, *TEXTS).select("id", F.md5(built).alias("embed_md5"))


_COS = "list_cosine_similarity(v.e, s.e)"
_S = "s AS (SELECT e FROM v ORDER BY id LIMIT 1)"


def _semantic(limit: int, per_note: int, where: str = "true", exact: bool = False, tail: str = "") -> str:
    fetch = "" if exact else f"QUALIFY row_number() OVER (ORDER BY score DESC, note_slug, chunk_index, id) <= {min(max(3 * limit, limit * per_note), 100)}"
    return f"""{_S}, q1 AS (SELECT v.*, {_COS} AS score FROM v, s WHERE {where} {fetch}),
q2 AS (SELECT * FROM q1 QUALIFY row_number() OVER (PARTITION BY note_slug ORDER BY score DESC, chunk_index, id) <= {per_note}),
q AS (SELECT * FROM q2 ORDER BY score DESC, note_slug, chunk_index, id LIMIT {limit}) {tail}"""


def _multi(queries: str, limit: int, per_note: int = 3, source: str = "v") -> str:
    fetch, cap = min(max(2 * limit, 20), 100), max(2 * per_note, 6)
    best = "ORDER BY score DESC, note_slug, chunk_index, id"
    return f"""qs AS ({queries}),
m1 AS (SELECT k, label, v.id, v.note_slug, v.chunk_index, list_cosine_similarity(v.e, qs.e) AS score FROM {source} v, qs QUALIFY row_number() OVER (PARTITION BY k {best}) <= {min(max(3 * fetch, fetch * cap), 100)}),
m2 AS (SELECT * FROM m1 QUALIFY row_number() OVER (PARTITION BY k, note_slug {best}) <= {cap}),
m3 AS (SELECT * FROM m2 QUALIFY row_number() OVER (PARTITION BY k {best}) <= {fetch}),
m AS (SELECT * FROM m3 WHERE score > 0),
per AS (SELECT note_slug, label, max(score) AS sc FROM m GROUP BY ALL),
nq AS (SELECT note_slug, count(*) AS n_queries FROM per GROUP BY 1),
mc AS (SELECT id, note_slug, chunk_index, max(score) AS score FROM m GROUP BY ALL),
mk AS (SELECT mc.*, n_queries FROM mc JOIN nq USING (note_slug) QUALIFY row_number() OVER (PARTITION BY note_slug ORDER BY score DESC, chunk_index, id) <= {per_note}),
mq AS (SELECT * FROM mk ORDER BY n_queries DESC, score DESC, note_slug, chunk_index, id LIMIT {limit})"""


_THREE = "SELECT row_number() OVER (ORDER BY id) AS k, 'query_' || row_number() OVER (ORDER BY id) AS label, e FROM (SELECT id, e FROM v ORDER BY id LIMIT 3)"
_SCORE = "id, note_slug, round(score, 4) AS score"
_NEAR = """nb AS (SELECT coalesce(a.note_slug, target_slug) AS note_slug FROM l JOIN hub ON source_slug = slug LEFT JOIN al a ON a.key = target_slug
  UNION SELECT b.note_slug FROM l JOIN hub ON source_slug = slug JOIN al b ON b.key = target_path UNION SELECT b FROM inn, hub WHERE a = slug)"""
_HIT = " + ".join(f"(CASE WHEN contains(lower(title), '{w}') THEN 2 ELSE 0 END) + (CASE WHEN contains(lower(file_path), '{w}') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END) + len(list_filter(tags, lambda t: contains(lower(t), '{w}')))" for w in WORDS.split())
_BFS = "both_ AS (SELECT a, b FROM outt UNION SELECT a, b FROM inn), h1 AS (SELECT DISTINCT b AS note_slug FROM both_, hub WHERE a = slug AND b <> slug), h2 AS (SELECT DISTINCT b AS note_slug FROM both_ WHERE a IN (SELECT note_slug FROM h1) AND b NOT IN (SELECT note_slug FROM h1) AND b <> (SELECT slug FROM hub))"
_HOPS = "SELECT x.note_slug, coalesce(nullif(h.title, ''), x.note_slug) AS title, x.score, x.score || ' hop(s)' AS extra, h.note_slug IS NULL AS is_phantom FROM ({}) x LEFT JOIN h USING (note_slug)"
_FIRST = "SELECT note_slug, title, id FROM (SELECT * FROM c WHERE {} QUALIFY row_number() OVER (PARTITION BY note_slug ORDER BY chunk_index, id) = 1) ORDER BY title, note_slug LIMIT {}"
_BODY = """p AS (SELECT note_slug, chunk_index, text, heading_level AS lv, CASE WHEN heading_path = '' THEN [] ELSE list_filter(string_split(heading_path, ' > '), lambda x: x <> '') END AS parts FROM c),
pb AS (SELECT *, coalesce(lag(parts) OVER (PARTITION BY note_slug ORDER BY chunk_index), []) AS before FROM p),
ps AS (SELECT *, coalesce(list_min(list_filter(range(1, len(parts) + 1), lambda k: parts[k] IS DISTINCT FROM before[k])), len(parts) + 1) AS first FROM pb),
pl AS (SELECT note_slug, chunk_index, list_concat(list_transform(range(first, len(parts) + 1), lambda k: repeat('#', CASE WHEN k = len(parts) AND lv > 0 THEN lv ELSE k END::INT) || ' ' || parts[k]), CASE WHEN text <> '' THEN [text] ELSE [] END) AS body FROM ps)"""
_IDX = "SELECT title AS input FROM h UNION SELECT string_split(note_slug, '-')[-1] FROM h"
_ROOM = "160 - ceil(length(text) / 4.0) - 2"
_SEC = "(CASE WHEN heading_path = '' THEN title ELSE title || ' > ' || heading_path END)"
_TAGGED = f"(CASE WHEN len(tags) > 0 THEN {_SEC} || chr(10) || '[tags: ' || array_to_string(tags, ', ') || ']' ELSE {_SEC} END)"
_FIT = f"(CASE WHEN ceil(length({_TAGGED}) / 4.0) <= {_ROOM} THEN {_TAGGED} WHEN ceil(length({_SEC}) / 4.0) <= {_ROOM} THEN {_SEC} WHEN ceil(length(title) / 4.0) <= {_ROOM} THEN title END)"

SQL = {
    "semantic_topk": f"WITH {C}, {_semantic(10, 3)} SELECT {_SCORE} FROM q",
    "semantic_exact": f"WITH {C}, {_semantic(50, 2, exact=True)} SELECT {_SCORE} FROM q",
    "index_recall": "SELECT true AS enough",
    "index_exact": f"WITH {C}, {_semantic(10, 3)} SELECT {_SCORE} FROM q",
    "semantic_filtered": f"WITH {C}, {_semantic(20, 1, "has_task AND file_type = 'md' AND note_slug <> 'running-capture-log'")} SELECT {_SCORE} FROM q",
    "multi_query_rank": f"WITH {C}, {_multi(_THREE, 10)} SELECT id, n_queries, round(score, 4) AS score FROM mq",
    "multi_query_attribution": f"""WITH {C}, {_multi(_THREE, 20)},
a AS (SELECT mq.id, label, sc, mq.score FROM mq JOIN per USING (note_slug)),
ok AS (SELECT *, (sc::FLOAT >= 0.7::FLOAT AND sc::FLOAT >= 0.85::FLOAT * score::FLOAT) OR (score::FLOAT < 0.7::FLOAT AND sc::FLOAT >= score::FLOAT - 0.05::FLOAT) AS fits FROM a)
SELECT id, coalesce(string_agg(label, '|' ORDER BY sc DESC, label) FILTER (fits), arg_min(label, (-sc, label))) AS matched FROM ok GROUP BY id""",
    "min_score_round": f"WITH {C}, {_semantic(100, 100)} SELECT id, round(score, 4) AS score FROM q WHERE score >= 0.3",
    "group_by_note": """WITH r AS (SELECT * FROM search_results WHERE note_slug IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY loaded_at DESC NULLS LAST, note_slug DESC, score DESC) = 1)
SELECT note_slug, arg_min(result_id, (-score, result_id)) AS position, max(score) AS score, CASE WHEN count(*) > 1 THEN count(*) || ' matching chunks' END AS extra FROM r GROUP BY note_slug""",
    "lexical_search": f"WITH {C}, x AS (SELECT note_slug, ({_HIT})::BIGINT AS hits FROM h) SELECT * FROM x WHERE hits > 0",
    "tag_exact": f"WITH {C} {_FIRST.format("list_contains(tags, 'meeting')", 50)}",
    "tag_children": f"WITH {C} {_FIRST.format(f"len(list_filter(tags, lambda t: lower(t) = '{TAG}' OR starts_with(lower(t), '{TAG}/'))) > 0", 10_000)}",
    "tag_list": f"WITH {C}, t AS (SELECT note_slug, unnest(list_distinct(tags)) AS tag FROM h) SELECT tag, count(*) AS count FROM t WHERE tag <> '' GROUP BY tag",
    "tag_suggest": f"WITH {C}, t AS (SELECT note_slug, unnest(list_distinct(tags)) AS tag FROM h) SELECT tag, count(*) AS count, levenshtein(lower(tag), 'meting') AS distance FROM t WHERE tag <> '' AND lower(tag) <> 'meting' GROUP BY tag ORDER BY distance, count DESC, tag LIMIT 5",
    "shared_tags": f"WITH {L}, sd AS (SELECT unnest(tags) AS tag, unnest(range(1, len(tags) + 1)) AS pos FROM h, hub WHERE note_slug = slug), s1 AS (SELECT tag, min(pos) AS pos FROM sd GROUP BY tag), ot AS (SELECT note_slug, unnest(list_distinct(tags)) AS tag FROM h WHERE note_slug <> (SELECT slug FROM hub)) SELECT note_slug, count(*) AS score, string_agg(tag, '|' ORDER BY pos) AS tags FROM ot JOIN s1 USING (tag) GROUP BY note_slug",
    "alias_table": f"WITH {L} SELECT key, note_slug FROM al",
    "link_resolve": f"WITH {L} SELECT source_slug, target_slug, target_path, target_path AS display_text FROM l",
    "backlinks": f"""WITH {L}, ck AS (SELECT key FROM al, hub WHERE note_slug = slug UNION SELECT {sql_slug("key")} FROM al, hub WHERE note_slug = slug UNION SELECT slug FROM hub),
bl AS (SELECT coalesce(al.note_slug, source_slug) AS note_slug, min(target_path) AS extra FROM l LEFT JOIN al ON al.key = source_slug WHERE target_slug IN (SELECT key FROM ck WHERE key <> '') OR target_path IN (SELECT key FROM ck WHERE key <> '') GROUP BY 1)
SELECT bl.note_slug, coalesce(nullif(h.title, ''), bl.note_slug) AS title, extra, h.note_slug IS NULL AS is_phantom FROM bl LEFT JOIN h USING (note_slug)""",
    "neighbours": f"WITH {L}, {_NEAR} SELECT note_slug FROM nb",
    "connections_1hop": f"WITH {L}, {_BFS} {_HOPS.format('SELECT note_slug, 1 AS score FROM h1')}",
    "connections_2hop": f"WITH {L}, {_BFS} {_HOPS.format('SELECT note_slug, 1 AS score FROM h1 UNION ALL SELECT note_slug, 2 FROM h2')}",
    "phantom_nodes": f"WITH {L}, {_BFS} SELECT note_slug, score FROM (SELECT note_slug, 1 AS score FROM h1 UNION ALL SELECT note_slug, 2 FROM h2) WHERE note_slug NOT IN (SELECT note_slug FROM h)",
    "hidden_unlinked": f"WITH {L}, {_NEAR}, {_semantic(50, 1)} SELECT {_SCORE} FROM q WHERE note_slug <> (SELECT slug FROM hub) AND note_slug NOT IN (SELECT note_slug FROM nb) ORDER BY q.score DESC, note_slug, chunk_index LIMIT 10",
    "hidden_include_linked": f"WITH {L}, {_semantic(50, 1)} SELECT {_SCORE} FROM q WHERE note_slug <> (SELECT slug FROM hub) ORDER BY q.score DESC, note_slug, chunk_index LIMIT 10",
    "hidden_deep": f"""WITH {L}, {_NEAR}, ov AS (SELECT * FROM v WHERE note_slug <> (SELECT slug FROM hub) AND note_slug NOT IN (SELECT note_slug FROM nb)),
{_multi("SELECT chunk_index AS k, CASE WHEN heading_path <> '' THEN 'h' || heading_path WHEN chunk_index = 0 THEN '0' ELSE 'c' || chunk_index END AS label, e FROM v WHERE note_slug = (SELECT slug FROM hub)", 30, source="ov")}
SELECT id, n_queries, round(score, 4) AS score FROM mq ORDER BY n_queries DESC, mq.score DESC, note_slug, chunk_index LIMIT 10""",
    "graph_boosted": f"WITH {L}, {_NEAR}, {_semantic(30, 1, "true")}, bo AS (SELECT id, note_slug, chunk_index, CASE WHEN note_slug IN (SELECT note_slug FROM nb) THEN score * 1.5 ELSE score END AS score, CASE WHEN note_slug IN (SELECT note_slug FROM nb) THEN 'graph-boosted' END AS extra FROM q) SELECT {_SCORE}, extra FROM bo ORDER BY bo.score DESC, note_slug, chunk_index LIMIT 10",
    "note_reconstruct": f"WITH {C}, {_BODY} SELECT note_slug, count(*) AS n_chunks, md5(array_to_string(flatten(list(body ORDER BY chunk_index)), chr(10) || chr(10))) AS content_md5 FROM pl GROUP BY note_slug",
    "note_head": f"WITH {L}, {_BODY} SELECT h.note_slug, h.title, (SELECT count(*) FROM c WHERE c.note_slug = h.note_slug) AS total, array_to_string(body, chr(10) || chr(10)) AS content FROM h JOIN hub ON slug = h.note_slug JOIN pl ON pl.note_slug = slug AND pl.chunk_index = 0",
    "note_meta": f"WITH {C} SELECT h.note_slug, h.title, h.file_path, h.file_type, h.content_hash, n AS n_chunks FROM h JOIN (SELECT note_slug, count(*) AS n FROM c GROUP BY 1) USING (note_slug)",
    "context_window": f"WITH {C} SELECT t.id, md5(coalesce(string_agg(o.text, '|' ORDER BY o.chunk_index), '')) AS context_md5, count(o.id) AS n FROM c t LEFT JOIN c o ON o.note_slug = t.note_slug AND o.chunk_index BETWEEN t.chunk_index - 1 AND t.chunk_index + 1 AND o.chunk_index <> t.chunk_index GROUP BY t.id",
    "resolve_name": f"""WITH {C}, i AS (SELECT input, {sql_slug("input")} AS slug FROM ({_IDX}) WHERE input <> ''),
k AS (SELECT input, note_slug, CASE WHEN lower(title) = lower(input) THEN 'title' WHEN file_path IN (input, input || '.md') OR ends_with(file_path, '/' || input) OR ends_with(file_path, '/' || input || '.md') THEN 'path' WHEN slug <> '' AND ends_with(note_slug, slug) THEN 'suffix' END AS class FROM i, h),
g AS (SELECT input, [list(note_slug) FILTER (class = 'path'), list(note_slug) FILTER (class = 'title'), list(note_slug) FILTER (class = 'suffix'), list(note_slug) FILTER (class IS NOT NULL)] AS ls, count(class) AS n FROM k GROUP BY input),
o AS (SELECT input, list_filter(ls, lambda x: len(x) = 1)[1][1] AS note_slug, n FROM g)
SELECT input, note_slug, CASE WHEN note_slug IS NOT NULL THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS status, n AS n_candidates FROM o""",
    "name_lookup": f"WITH {C}, f AS (SELECT note_slug, file_path FROM h WHERE file_path <> '' ORDER BY note_slug LIMIT 4) SELECT note_slug AS name, note_slug FROM f UNION ALL SELECT ' ' || file_path || ' ', note_slug FROM f UNION ALL SELECT 'no such note at all', '-' UNION ALL SELECT ' ', ''",
    "slug_list": f"WITH {C} SELECT DISTINCT note_slug FROM h",
    "limit_clamped": f"WITH {C}, {_semantic(100, 100)} SELECT {_SCORE} FROM q",
    "fallback_search": f"WITH {C}, x AS (SELECT note_slug, ({_HIT})::BIGINT AS hits FROM h) SELECT * FROM x WHERE hits > 0 ORDER BY hits DESC, note_slug LIMIT 20",
    "stats": f"WITH {L} SELECT (SELECT count(DISTINCT note_slug) FROM h) AS notes, (SELECT count(*) FROM c) AS chunks, (SELECT count(*) FROM l) AS links",
    "slugify": f"WITH {L} SELECT DISTINCT raw, {sql_slug('raw')} AS slug, {sql_stem('raw')} AS title FROM rl WHERE raw IS NOT NULL",
    "attachment_flag": f"WITH {L}, e AS (SELECT unnest(string_split(' {" ".join(ENDINGS)}', ' ')) AS e), x AS (SELECT DISTINCT raw || e AS raw, lower(regexp_extract(trim(regexp_replace(raw || e, '[#|].*$', '', 's')), '\\.([A-Za-z0-9]+)$', 1)) AS ext FROM rl, e WHERE raw IS NOT NULL) SELECT raw, CASE WHEN ext IN ({SQL_IMAGES}) THEN 'image' WHEN ext IN ({SQL_OTHERS}) THEN 'attachment' END AS kind FROM x",
    "content_hash": "SELECT doc_id, sha256(text || chr(0) || 'schema=5' || chr(0) || 'size=800' || chr(0) || 'overlap=100' || chr(0) || 'model=m' || chr(0)) AS hash FROM documents WHERE text IS NOT NULL",
    "embed_text": f"WITH {C} SELECT id, md5(CASE WHEN coalesce({_FIT}, '') = '' THEN text ELSE {_FIT} || chr(10) || chr(10) || text END) AS embed_md5 FROM c",
}
_FUNCTIONS = (
    semantic_topk, semantic_exact, semantic_filtered, index_recall, index_exact, multi_query_rank, multi_query_attribution, min_score_round, group_by_note, lexical_search, tag_exact, tag_children, tag_list, tag_suggest, shared_tags, alias_table, link_resolve, backlinks,
    neighbours, connections_1hop, connections_2hop, phantom_nodes, hidden_unlinked, hidden_include_linked, hidden_deep, graph_boosted, note_reconstruct, note_head, note_meta, context_window, resolve_name, name_lookup, slug_list, limit_clamped, fallback_search, stats, slugify, attachment_flag, content_hash, embed_text,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}
