"""Queries of problem 2 over the vault tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.names import ATTACHMENTS, note_names
from lodestone.operators.orphans import OrphanState, advance, orphan_counts, parent_events
from lodestone.operators.records import latest
from lodestone.scratch import materialise


def references(spark: SparkSession, d: str) -> DataFrame:
    """``(ref_table, ref_id, key, at)`` of every link and every recorded slug."""
    batches = latest(spark.read.parquet(f"{d}/ingest_batches.parquet"), "batch_id", "loaded_at", "batch_id", "loaded_at", "run_at", "links")
    results = latest(spark.read.parquet(f"{d}/search_results.parquet"), "result_id", "loaded_at", "result_id", "loaded_at", "run_at", "note_slug")
    at = F.coalesce("run_at", "loaded_at").alias("at")
    named = lambda rows, table, ref, raws: rows.select(F.lit(table).alias("ref_table"), F.col(ref).alias("ref_id"), F.explode(F.array_distinct(note_names(raws))).alias("key"), at)
    return named(batches, "ingest_batches", "batch_id", F.col("links")).unionByName(named(results, "search_results", "result_id", F.array("note_slug")))


def note_events(spark: SparkSession, d: str) -> DataFrame:
    notes = spark.read.parquet(f"{d}/notes.parquet")
    return parent_events(notes, F.col("note_slug"), F.col("indexed_at"), F.col("deleted_at"))


def _tracked(spark: SparkSession, d: str) -> OrphanState:
    """The state after a step for each year of references, to which the notes' events of that time belong; the first and last
    step take the events before and after."""
    refs = references(spark, d).where("key is not null and at is not null").withColumn("year", F.year("at"))
    refs = materialise(refs, "refs", "year")
    events = note_events(spark, d)
    years = sorted(r[0] for r in refs.select("year").distinct().collect())
    state = OrphanState.empty(spark)
    if not years:
        return advance(state, refs, events, stored=True)
    for k, year in enumerate(years):
        inside = F.lit(True)
        inside = inside & (F.year("at") >= year) if k else inside
        inside = inside & (F.year("at") < years[k + 1]) if k + 1 < len(years) else inside
        state = advance(state, refs.where(F.col("year") == year), events.where(inside), stored=True)
    return state


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _tracked(spark, d).verdicts.select("ref_table", "ref_id", F.col("key").alias("target_slug"))


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    """New orphan references per table and month, and how many of all so far wait at its end."""
    state = _tracked(spark, d)
    counts = orphan_counts(state.verdicts, OrphanState.empty(spark).live, state.all_events)
    return counts.select("ref_table", F.date_format("period", "yyyy-MM").alias("month"), "n_orphans", "n_open")


_ENDS = " OR ".join(f"ends_with(bare, '{e}')" for e in ATTACHMENTS)
_REFS = f"""
b AS (SELECT * FROM ingest_batches WHERE batch_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY loaded_at DESC NULLS LAST, run_at DESC NULLS LAST, links DESC NULLS LAST) = 1),
s AS (SELECT * FROM search_results WHERE result_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY loaded_at DESC NULLS LAST, run_at DESC NULLS LAST, note_slug DESC NULLS LAST) = 1),
raw AS (SELECT 'ingest_batches' AS ref_table, batch_id AS ref_id, coalesce(run_at, loaded_at) AS ts, unnest(links) AS raw FROM b
  UNION ALL SELECT 'search_results', result_id, coalesce(run_at, loaded_at), note_slug FROM s),
bare AS (SELECT ref_table, ref_id, ts, lower(trim(regexp_replace(regexp_replace(raw, '[#|].*$', '', 's'), '^.*/', '', 's'))) AS bare FROM raw),
named AS (SELECT DISTINCT ref_table, ref_id, ts, regexp_replace(CASE WHEN ends_with(bare, '.md') THEN bare[:-4] WHEN ends_with(bare, '.pdf') THEN bare[:-5] || '-pdf' ELSE bare END, ' +', '-', 'g') AS slug FROM bare WHERE NOT ({_ENDS})),
orphan AS (SELECT ref_table, ref_id, slug, ts FROM named r WHERE slug <> '' AND ts IS NOT NULL AND NOT EXISTS (SELECT 1 FROM notes n WHERE n.note_slug = r.slug AND n.indexed_at <= r.ts AND (n.deleted_at IS NULL OR n.deleted_at > r.ts)))
"""
# DuckDB slices end inclusively, so [:-4] drops the last three characters.
SQL = {
    "p2_found": f"WITH {_REFS} SELECT DISTINCT ref_table, ref_id, slug AS target_slug FROM orphan",
    "p2_counts": f"""WITH {_REFS},
valid AS (SELECT DISTINCT note_slug, indexed_at, deleted_at FROM notes WHERE indexed_at IS NOT NULL AND (deleted_at IS NULL OR deleted_at > indexed_at)),
moments AS (SELECT date_trunc('month', ts) AS m FROM orphan UNION SELECT date_trunc('month', indexed_at) FROM valid UNION SELECT date_trunc('month', deleted_at) FROM valid WHERE deleted_at IS NOT NULL),
new AS (SELECT ref_table, date_trunc('month', ts) AS m, count(*) AS n FROM orphan GROUP BY ALL),
open AS (SELECT o.ref_table, m.m, count(*) AS n FROM orphan o JOIN moments m ON o.ts < m.m + INTERVAL 1 MONTH
  WHERE NOT EXISTS (SELECT 1 FROM valid v WHERE v.note_slug = o.slug AND v.indexed_at < m.m + INTERVAL 1 MONTH AND (v.deleted_at IS NULL OR v.deleted_at >= m.m + INTERVAL 1 MONTH)) GROUP BY ALL),
keys AS (SELECT ref_table, m FROM new UNION SELECT DISTINCT o.ref_table, date_trunc('month', e.ts) FROM orphan o JOIN (SELECT note_slug, indexed_at AS ts FROM valid UNION ALL SELECT note_slug, deleted_at FROM valid WHERE deleted_at IS NOT NULL) e ON e.note_slug = o.slug)
SELECT k.ref_table, strftime(k.m, '%Y-%m') AS month, coalesce(new.n, 0)::BIGINT AS n_orphans, coalesce(open.n, 0)::BIGINT AS n_open
FROM keys k LEFT JOIN new USING (ref_table, m) LEFT JOIN open USING (ref_table, m)""",
}
QUERIES = {"p2_found": p2_found, "p2_counts": p2_counts}
