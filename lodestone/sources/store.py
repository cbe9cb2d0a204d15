"""A store of chunks and links in buckets of notes, replaced bucket by bucket.

``chunks``, ``raw`` (links as written) and ``links`` (with their targets) lie in buckets by the hash of their note. A write makes new folders for
the buckets it touches, then a manifest that names the folder of each bucket, and moves one small pointer file last: readers see the
old or the new state, and a failed write leaves nothing behind but unnamed folders. Folders that neither the new nor the
previous manifest names are deleted.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.scalars import slugify, without_anchor
from lodestone.operators.graph import alias_table, resolve_links
from lodestone.scratch import discard, materialise

CHUNKS = "id string, note_slug string, title string, file_path string, chunk_index int, heading_path string, heading_level int, has_task boolean, has_code boolean, file_type string, content_hash string, tags array<string>, text string, embedding array<float>"
RAW = "source_slug string, raw string"
LINKS = "source_slug string, target_slug string, target_path string, display_text string"
ALIASES = "key string, note_slug string"
TABLES = {"chunks": (CHUNKS, "note_slug"), "raw": (RAW, "source_slug"), "links": (LINKS, "source_slug"), "aliases": (ALIASES, "key")}
BUCKETS = 64
#: Places of a note that one task writes.
PART = 1000


def names_of(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


class Store:
    """A store in a folder that all executors share. An index lies beside the tables and goes with the state it was made of. The number of buckets is that with which it was made."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self._buckets = spark, path.rstrip("/"), buckets
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{path}")

    def _load(self, path: str) -> str | None:
        at = self._hadoop(path)
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _save(self, path: str, text: str) -> None:
        out = self._fs.create(self._hadoop(path), True)
        out.write(bytearray(text.encode()))
        out.close()

    @property
    def snapshot(self) -> str | None:
        """The name of the current manifest."""
        return self._load("CURRENT")

    @property
    def index_path(self) -> str:
        """The folder of an index of the current state."""
        return f"{self.path}/index-{self.snapshot}"

    def has_index(self) -> bool:
        return bool(self._fs.exists(self._hadoop(f"index-{self.snapshot}/rows/_SUCCESS")))

    def manifest(self) -> dict[str, Any]:
        """``folders[table][bucket]``, the number of ``buckets``, and the manifest ``before``."""
        name = self.snapshot
        return json.loads(self._load(name) or "") if name else {"buckets": self._buckets, "folders": {t: {} for t in TABLES}, "before": None}

    def _table(self, name: str, manifest: dict[str, Any], only: list[int] | None = None) -> DataFrame:
        schema = TABLES[name][0]
        folders = [f"{self.path}/{name}/{folder}/bucket={b}" for b, folder in manifest["folders"][name].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    @property
    def chunks(self) -> DataFrame:
        return self._table("chunks", self.manifest())

    @property
    def raw_links(self) -> DataFrame:
        return self._table("raw", self.manifest())

    @property
    def links(self) -> DataFrame:
        return self._table("links", self.manifest())

    @property
    def aliases(self) -> DataFrame:
        return self._table("aliases", self.manifest())

    def _bucket(self, key: str, manifest: dict[str, Any]) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(manifest["buckets"])).cast("int")

    def _touched(self, keys: DataFrame, key: str, manifest: dict[str, Any]) -> list[int]:
        return sorted(r[0] for r in keys.select(self._bucket(key, manifest)).distinct().collect())  # at most the number of buckets

    def _put(self, name: str, rows: DataFrame, touched: list[int], manifest: dict[str, Any]) -> None:
        """Write ``rows``, all that belong to the ``touched`` buckets, and name the folders in the manifest."""
        if not touched:
            return
        schema, key = TABLES[name]
        folder = uuid.uuid4().hex
        spot = [F.floor(F.col("chunk_index") / PART)] if name == "chunks" else [F.pmod(F.xxhash64(*names_of(schema)), F.lit(8))]
        placed = rows.select(*names_of(schema), self._bucket(key, manifest).alias("bucket")).repartition("bucket", key if name == "chunks" else "bucket", *spot)
        order = ["bucket", key, *(["chunk_index"] if name == "chunks" else [])]
        placed.sortWithinPartitions(*order).write.partitionBy("bucket").parquet(f"{self.path}/{name}/{folder}")
        for b in touched:
            manifest["folders"][name].pop(str(b), None)
            if self._fs.exists(self._hadoop(f"{name}/{folder}/bucket={b}")):
                manifest["folders"][name][str(b)] = folder

    def _commit(self, manifest: dict[str, Any]) -> None:
        last = self.snapshot
        name = f"manifest-{uuid.uuid4().hex}.json"
        self._save(name, json.dumps(manifest | {"before": last}))
        self._save(f"{name}.pointer", name)
        # One rename that overwrites, so there is a pointer at every moment.
        jvm = self.spark._jvm
        how = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(how, 1)
        options[0] = how.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(self._fs.makeQualified(self._hadoop(f"{name}.pointer")), self._fs.makeQualified(self._hadoop("CURRENT")), options)
        self._clean(name, last)

    def _clean(self, *names: str | None) -> None:
        """Delete what the named manifests do not name."""
        held = [json.loads(self._load(n) or "") for n in names if n]
        for table in TABLES:
            used = {f for m in held for f in m["folders"][table].values()}
            if self._fs.exists(self._hadoop(table)):
                for at in self._fs.listStatus(self._hadoop(table)):
                    if at.getPath().getName() not in used:
                        self._fs.delete(at.getPath(), True)
        for at in self._fs.listStatus(self._hadoop("")):
            name = at.getPath().getName()
            if name.startswith(("manifest-", "index-")) and name.removeprefix("index-") not in names:
                self._fs.delete(at.getPath(), True)

    def replace(self, chunks: DataFrame, raw: DataFrame, stale: DataFrame | None = None) -> None:
        """Replace the notes of ``chunks`` and drop the ``stale(note_slug)`` ones, chunks and outgoing links alike.

        Links into a dropped note stay and lead to a phantom; one may become real again. Only links of the buckets
        touched, and of those with a link whose name means another note now, are resolved anew. A note
        without chunks in ``chunks`` keeps its old rows.
        """
        manifest = self.manifest()
        chunks = chunks.select(names_of(CHUNKS))
        new = chunks.select("note_slug").distinct()
        gone = materialise(new.unionByName(stale.select("note_slug")).distinct() if stale is not None else new, "gone")
        touched = self._touched(gone, "note_slug", manifest)
        kept = self._table("chunks", manifest, touched).join(gone, "note_slug", "left_anti")
        sources = gone.select(F.col("note_slug").alias("source_slug"))
        kept_raw = self._table("raw", manifest, touched).join(sources, "source_slug", "left_anti")
        new_raw = raw.select("source_slug", "raw").join(new.select(F.col("note_slug").alias("source_slug")), "source_slug", "left_semi")
        self._put("chunks", kept.select(names_of(CHUNKS)).unionByName(chunks.dropDuplicates(["id"])), touched, manifest)
        self._put("raw", kept_raw.select("source_slug", "raw").unionByName(new_raw), touched, manifest)
        self._link(touched, manifest)
        self._commit(manifest)
        discard(gone)

    def _link(self, touched: list[int], manifest: dict[str, Any]) -> None:
        old = self._table("aliases", manifest)
        now = materialise(alias_table(self._table("chunks", manifest).where("chunk_index = 0")), "aliases")
        both = now.select("key", F.col("note_slug").alias("n")).join(old.select("key", F.col("note_slug").alias("o")), "key", "full_outer")
        changed = materialise(both.where("not (n <=> o)").select("key"), "changed")
        renamed = self._touched(changed, "key", manifest)
        if renamed:
            self._put("aliases", now.where(self._bucket("key", manifest).isin(*renamed)), renamed, manifest)
        name = without_anchor(F.col("raw"))
        met = self._table("raw", manifest).select("source_slug", F.explode(F.array(name, F.lower(name), slugify(name))).alias("key")).join(changed, "key", "left_semi")
        again = sorted({*touched, *self._touched(met, "source_slug", manifest)})
        self._put("links", resolve_links(self._table("raw", manifest, again), self._table("aliases", manifest)), again, manifest)
        discard(now)
        discard(changed)

    def reset(self) -> None:
        """Drop everything."""
        self._commit({"buckets": self._buckets, "folders": {t: {} for t in TABLES}})

    def meta(self) -> DataFrame:
        """``(note_slug, content_hash, file_type)`` of every note."""
        return self.chunks.where("chunk_index = 0").select("note_slug", "content_hash", "file_type")

    def check(self) -> dict[str, int]:
        """Faults: repeated ids, notes without a first chunk, links of unknown notes, slugs of several files."""
        c = self.chunks
        slugs = c.select("note_slug").distinct()
        return {
            "repeated ids": c.groupBy("id").count().where("count > 1").count(),
            "notes without first chunk": slugs.join(c.where("chunk_index = 0"), "note_slug", "left_anti").count(),
            "links of unknown notes": self.links.join(slugs.withColumnRenamed("note_slug", "source_slug"), "source_slug", "left_anti").count(),
            "slugs of several files": c.groupBy("note_slug").agg(F.count_distinct("file_path").alias("n")).where("n > 1").count(),
        }
