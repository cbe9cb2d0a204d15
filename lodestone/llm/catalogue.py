"""The queries of the problems solved in this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.names import ATTACHMENTS, note_name
from lodestone.llm import contamination, levels, neardup, packing, splitting, topn, vectors
from lodestone.operators.records import latest
from lodestone.scratch import materialise


def _chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return latest(spark.read.parquet(f"{d}/chunks.parquet"), "id", "ingested_at", "id", *columns, costly=True)


def p1_similar(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar chunks of every chunk."""
    found = vectors.most_similar(_chunks(spark, d, "embedding"), 5)
    return found.select("id", "similar_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return vectors.unordered(vectors.similar_vectors(_chunks(spark, d, "embedding"), 5, 0.9))


def p3_top(spark: SparkSession, d: str) -> DataFrame:
    """The three best recorded results of every note."""
    rows = latest(spark.read.parquet(f"{d}/search_results.parquet"), "result_id", "loaded_at", "result_id", "loaded_at", "note_slug", "score", "chunk_index", "lexical")
    rows = rows.where(~F.coalesce("lexical", F.lit(False)))
    best = topn.top_n(rows, note_name(F.col("note_slug")), 3, F.col("score"), F.col("chunk_index"), F.col("result_id"), "result_id", "score", "chunk_index")
    return best.select(F.col("grp").alias("note_slug"), F.col("rank").cast("long").alias("rank"), "result_id", "score", F.coalesce("chunk_index", F.lit(0)).alias("chunk_index"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_top(spark, d).select("note_slug", "result_id")


#: Problem 4 in this data: runs of three words, at least 0.6 of their union in common.
EDITED = {"size": 3, "similarity": 0.6, "owner_col": "note_slug"}


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every pair, copies included, as a pair of ids is what is asked for."""
    return neardup.near_duplicates(_chunks(spark, d, "note_slug", "text"), write_out=None, **EDITED)


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of chunks that still share most of their content."""
    return neardup.near_duplicate_groups(_chunks(spark, d, "note_slug", "text"), **EDITED)


def _sections(spark: SparkSession, d: str) -> DataFrame:
    """The sections with the size and overlap that hold for them."""
    rows = latest(spark.read.parquet(f"{d}/sections.parquet"), "section_id", "loaded_at", "section_id", "note_slug", "heading_path", "pipeline_name", "text", costly=True)
    pipes = spark.read.parquet(f"{d}/pipelines.parquet").select("pipeline_name", "chunk_size", "chunk_overlap")
    usual = pipes.where("pipeline_name = 'default'").select(F.max("chunk_size").alias("usual_size"), F.max("chunk_overlap").alias("usual_overlap"))
    # One row, as it is an aggregate without groups.
    pipes = pipes.crossJoin(usual).select("pipeline_name", F.coalesce("chunk_size", "usual_size").alias("size"), F.coalesce("chunk_overlap", "usual_overlap").alias("overlap"))
    return rows.withColumn("pipeline_name", F.coalesce("pipeline_name", F.lit("default"))).join(pipes, "pipeline_name")


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every section above the chunk size that holds for it."""
    return splitting.split_oversized(_sections(spark, d), "section_id", F.col("text"), F.col("size"), F.col("overlap"), "note_slug", "heading_path")


def p5_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """The split sections put together again from what is new in each piece, by their hash, and how many pieces are too long,
    out of order, share more than the overlap, or are not the text between their ends."""
    whole = _sections(spark, d).select("section_id", F.btrim("text", F.lit(splitting.BLANK)).alias("whole"), "size", "overlap")
    met = p5_pieces(spark, d).join(whole, "section_id")
    wrong = (F.length("text") > F.col("size")) | (F.col("fresh") - F.col("start") > F.col("overlap")) | (F.substring("whole", F.col("start") + 1, F.col("end") - F.col("start")) != F.col("text"))
    new = F.struct("piece", "fresh", "end", F.substring("text", F.col("fresh") - F.col("start") + 1, F.col("end") - F.col("fresh")).alias("new"))
    by = met.groupBy("section_id").agg(F.array_sort(F.collect_list(new)).alias("p"), F.count_if(wrong).alias("n_wrong"))
    gaps = F.size(F.filter(F.transform("p", lambda x, k: x["piece"] != k), lambda x: x)) + F.when(F.element_at("p", 1)["fresh"] != 0, 1).otherwise(0)
    return by.select("section_id", F.md5(F.array_join(F.transform("p", lambda x: x["new"]), "")).alias("text_md5"), (F.col("n_wrong") + gaps).alias("n_wrong"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_pieces(spark, d).where("piece = 0").select("section_id")


def p6_packing(spark: SparkSession, d: str) -> DataFrame:
    """Every text, or piece of 2,048 tokens of a longer one, with its container."""
    return packing.pack(spark.read.parquet(f"{d}/documents.parquet"))


def p6_checked(spark: SparkSession, d: str) -> DataFrame:
    """``(what, n)`` of a packing: its texts, those within the capacity that are cut, those with a piece too few or too many, containers
    above the capacity, and whether less than 99 % of the containers' room is used."""
    placed = materialise(p6_packing(spark, d), "packing")
    texts = placed.groupBy("doc_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"), F.max("piece").alias("last"))
    boxes = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("t"))
    kinds = lambda rows, **what: rows.agg(*[c.cast("long").alias(k) for k, c in what.items()]).select(F.explode(F.array(*[F.struct(F.lit(k).alias("what"), F.col(k).alias("n")) for k in what])).alias("x")).select("x.what", "x.n")
    of_texts = kinds(texts, texts=F.count("*"), cut=F.count_if((F.col("t") <= 2048) & (F.col("n") > 1)), lost=F.count_if((F.col("n") != F.col("last") + 1) | (F.col("n") != F.greatest(F.ceil(F.col("t") / 2048), F.lit(1)))))
    return of_texts.unionByName(kinds(boxes, over=F.count_if(F.col("t") > 2048), empty=(F.sum("t") < 0.99 * 2048 * F.count("*")).cast("int")))


def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    """The spans of 12 words or more that a document shares with a test item."""
    return contamination.leaked_spans(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/eval_items.parquet"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_spans(spark, d).select("doc_id", "item_id").distinct()


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    """The documents that hold leaked passages, without these."""
    return contamination.without_leaks(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/eval_items.parquet"))


BANDS = ("primary", "secondary", "tertiary", "specialist")


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    """Band and position of every document with enough English prose."""
    model = levels.learn(spark.read.parquet(f"{d}/level_samples.parquet"), BANDS)
    return levels.reading_levels(spark.read.parquet(f"{d}/documents.parquet"), model)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_levels(spark, d).select("doc_id", "band")


_ALL = (p1_found, p1_similar, p3_found, p3_top, p4_found, p4_groups, p5_found, p5_pieces, p5_rejoined, p6_packing, p6_checked, p7_found, p7_spans, p7_clean, p8_found, p8_levels)
QUERIES = {f.__name__: f for f in _ALL}

_CHUNKS = "c AS (SELECT * FROM chunks WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST, embedding DESC NULLS LAST) = 1)"
_NEAR = f"""{_CHUNKS},
v AS (SELECT id, embedding::DOUBLE[] AS e FROM c WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.id, b.id AS similar_id, list_cosine_similarity(a.e, b.e) AS score FROM v a JOIN v b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, similar_id) AS rank FROM p QUALIFY rank <= 5)"""
_ENDS = " OR ".join(f"ends_with(bare, '{e}')" for e in ATTACHMENTS)
_TOP = f"""l AS (SELECT * FROM search_results WHERE result_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY loaded_at DESC NULLS LAST, note_slug DESC NULLS LAST) = 1),
b AS (SELECT *, lower(trim(regexp_replace(regexp_replace(note_slug, '[#|].*$', '', 's'), '^.*/', '', 's'))) AS bare FROM l WHERE score IS NOT NULL AND NOT isnan(score) AND NOT coalesce(lexical, false)),
n AS (SELECT result_id, score, coalesce(chunk_index, 0) AS chunk_index, regexp_replace(CASE WHEN ends_with(bare, '.md') THEN bare[:-4] WHEN ends_with(bare, '.pdf') THEN bare[:-5] || '-pdf' ELSE bare END, ' +', '-', 'g') AS note_slug FROM b WHERE NOT ({_ENDS})),
t AS (SELECT note_slug, row_number() OVER (PARTITION BY note_slug ORDER BY score DESC, chunk_index, result_id) AS rank, result_id, score, chunk_index FROM n WHERE note_slug <> '' QUALIFY rank <= 3)"""
_EDITED = f"""{_CHUNKS},
w AS (SELECT id, note_slug, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM c),
g AS (SELECT DISTINCT id, note_slug, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 3),
s AS (SELECT id, count(*) AS n FROM g GROUP BY id),
o AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS common FROM g a JOIN g b USING (g) WHERE a.id < b.id AND a.note_slug IS DISTINCT FROM b.note_slug GROUP BY ALL)"""
_BARE = "regexp_replace(text, '[\\x{00AD}\\x{200B}\\x{200C}\\x{200D}\\x{FEFF}]', '', 'g')"
# Windows of 12 words by their place; those of one document and item that begin at most 12 words apart make up a span.
_LEAKS = f"""dw AS (SELECT doc_id, {_BARE} AS bare, regexp_extract_all(lower({_BARE}), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, regexp_extract_all(lower({_BARE}), '[a-z0-9]+') AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT doc_id, unnest(range(0, len(w) - 11)) AS pos, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM dw WHERE len(w) >= 12),
ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM iw WHERE len(w) >= 12),
m AS (SELECT DISTINCT doc_id, item_id, pos FROM dg JOIN ig USING (g)),
mb AS (SELECT *, CASE WHEN pos > lag(pos) OVER (PARTITION BY doc_id, item_id ORDER BY pos) + 12 THEN 1 ELSE 0 END AS new FROM m),
ms AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, item_id ORDER BY pos) AS span FROM mb),
sp AS (SELECT doc_id, item_id, min(pos)::INT AS first_word, (max(pos) + 11)::INT AS last_word FROM ms GROUP BY doc_id, item_id, span)"""
_SPLIT = """s AS (SELECT *, trim(text, chr(32) || chr(9) || chr(13) || chr(10)) AS bare FROM sections WHERE section_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY loaded_at DESC NULLS LAST) = 1),
u AS (SELECT chunk_size FROM pipelines WHERE pipeline_name = 'default'),
o AS (SELECT section_id, bare FROM s JOIN pipelines p ON p.pipeline_name = coalesce(s.pipeline_name, 'default') WHERE length(bare) > coalesce(p.chunk_size, (SELECT chunk_size FROM u)))"""
_GROUPS = f"""{_EDITED},
q AS (SELECT id, md5(string_agg(g, '|' ORDER BY g)) AS q FROM g GROUP BY id),
b AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS common FROM g a JOIN g b USING (g) WHERE a.id < b.id GROUP BY ALL),
e AS (SELECT id_a, id_b FROM b JOIN s x ON x.id = id_a JOIN s y ON y.id = id_b WHERE common >= 0.6 * (x.n + y.n - common)),
z AS (SELECT id_a AS id, id_b AS other FROM e UNION ALL SELECT id_b, id_a FROM e),
r(id, root) AS (SELECT id, id FROM s UNION SELECT z.other, r.root FROM r JOIN z USING (id)),
l AS (SELECT z.id, count(*) AS n FROM z JOIN q x ON x.id = z.id JOIN q y ON y.id = z.other WHERE x.q <> y.q GROUP BY 1)
SELECT r.id, min(root) AS group_id, coalesce(any_value(l.n), 0) AS n_links FROM r LEFT JOIN l USING (id) GROUP BY r.id"""
# A pair is found if either side ranks the other, and cosines are cheap to compare where all are, so
# the SQL joins everything; the driver's data for it are small.
SQL = {
    "p3_found": f"WITH {_TOP} SELECT note_slug, result_id FROM t",
    "p3_top": f"WITH {_TOP} SELECT note_slug, rank, result_id, score, chunk_index FROM t",
    "p7_found": f"WITH {_LEAKS} SELECT DISTINCT doc_id, item_id FROM m",
    "p6_checked": "SELECT 'texts' AS what, count(text) AS n FROM documents UNION ALL SELECT * FROM (VALUES ('cut', 0::BIGINT), ('lost', 0), ('over', 0), ('empty', 0)) AS t(what, n)",
    "p7_spans": f"WITH {_LEAKS} SELECT doc_id, item_id, first_word, last_word FROM sp",
    "p7_clean": f"""WITH {_LEAKS},
gone AS (SELECT DISTINCT doc_id, unnest(range(first_word + 1, last_word + 2)) AS w FROM sp),
inner_ AS (SELECT DISTINCT doc_id, unnest(range(first_word + 2, last_word + 2)) AS w FROM sp),
per AS (SELECT doc_id, list(w) AS gone FROM gone GROUP BY 1),
seps AS (SELECT doc_id, list(w) AS inside FROM inner_ GROUP BY 1),
t AS (SELECT d.doc_id, d.w, gone, inside, regexp_extract_all(d.bare, '[A-Za-z0-9]+') AS raw, string_split_regex(d.bare, '[A-Za-z0-9]+') AS sep FROM dw d JOIN per USING (doc_id) JOIN seps USING (doc_id)),
parts AS (SELECT doc_id, len(w) AS n_words, len(gone) AS n_leaked, sep[1] || array_to_string(list_transform(range(1, len(w) + 1), lambda i: (CASE WHEN list_contains(gone, i) THEN '' ELSE raw[i] END) || (CASE WHEN list_contains(inside, i + 1) THEN '' ELSE sep[i + 1] END)), '') AS text FROM t)
SELECT doc_id, n_words::INT AS n_words, n_leaked::INT AS n_leaked, CASE WHEN n_leaked <= 0.5 * n_words THEN text END AS text FROM parts""",
    "p5_found": f"WITH {_SPLIT} SELECT section_id FROM o",
    "p5_rejoined": f"WITH {_SPLIT} SELECT section_id, md5(bare) AS text_md5, 0::BIGINT AS n_wrong FROM o",
    "p4_found": f"WITH {_EDITED} SELECT id_a, id_b FROM o JOIN s x ON x.id = id_a JOIN s y ON y.id = id_b WHERE common >= 0.6 * (x.n + y.n - common)",
    "p4_groups": f"WITH RECURSIVE {_GROUPS}",
    "p1_found": f"WITH {_NEAR} SELECT DISTINCT least(id, similar_id) AS id_a, greatest(id, similar_id) AS id_b FROM r WHERE score >= 0.9",
    "p1_similar": f"WITH {_NEAR} SELECT id, similar_id, round(score, 4) AS score, rank FROM r",
}
