"""Continuous ingest: a stream of files, each batch brought into the store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.ingest import Ingest


def file_stream(spark: SparkSession, root: str) -> DataFrame:
    """New and rewritten Markdown files below a folder as ``(file_path, content, error)``. Names that begin with ``_`` or ``.`` are skipped."""
    rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(root)
    inside: Column = F.regexp_replace(F.regexp_replace(F.url_decode("path"), "^[a-z0-9+.-]+:/*", "/"), f"^{root.rstrip('/')}/", "")
    return rows.select(inside.alias("file_path"), "content", F.lit(None).cast("string").alias("error"))


def watch(ingest: Ingest, root: str, checkpoint: str, after: Callable[[int], None] | None = None, **trigger) -> StreamingQuery:
    """Ingest every batch of files; unchanged contents are skipped by their hash, so a repeated batch changes nothing."""

    def one(batch: DataFrame, number: int) -> None:
        ingest.apply(batch)
        if after:
            after(number)

    stream = file_stream(ingest.spark, root)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
