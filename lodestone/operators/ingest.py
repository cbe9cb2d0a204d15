"""From files to chunks: change detection, parsing, embedding, incremental replacement."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.scalars import embed_text, is_code_only, slugify, title_from_path, word_count
from lodestone.functions.scalars import SCHEMA_VERSION
from lodestone.scratch import discard, materialise
from lodestone.sources import markdown, vault
from lodestone.sources.store import CHUNKS, Store

#: ``<!-- page -->`` breaks are written between the pages of one chunk.
PAGE_BREAK = "\n\n---\n\n"
# Tokens of a converter's window if none are given, and those reserved for its task and answer.
WINDOW, RESERVED = 128000, 8192
#: Files whose chunks are passed on together.
FILES = 64
#: Places of a file whose chunks are numbered by one task.
BLOCK = 1000


class Embedder(Protocol):
    """Turns texts into vectors; made once per task, so it must be picklable or build its model lazily."""

    name: str

    def embed(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


@dataclass
class HashingEmbedder:
    """Feature hashing of words and word pairs: no model, the same vector everywhere; for tests and as a baseline."""

    dim: int = 64
    name: str = "hashing"

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim), np.float32)
        for r, text in enumerate(texts):
            words = re.findall(r"\w+", (text or " ").lower())
            for w in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]:
                h = zlib.crc32(w.encode())
                out[r, h % self.dim] += 1 if h >> 31 else -1
            norm = float(np.linalg.norm(out[r]))
            out[r] = out[r] / norm if norm else out[r]
        return out.tolist()


@dataclass
class Settings:
    """How notes are cut and embedded; everything but ``min_words`` and ``max_tokens`` is part of the content hash."""

    size: int = 800
    overlap: int = 100
    min_words: int = 10
    max_tokens: int = 256
    skip_attachments: bool = True
    #: Whether what the vault's own settings exclude is left out.
    respect_excludes: bool = False


def hashed(files: DataFrame, settings: Settings, model: str) -> DataFrame:
    """``files`` with slug, title, type and content hash."""
    suffix = f"\0schema={SCHEMA_VERSION}\0size={settings.size}\0overlap={settings.overlap}\0model={model}\0"
    path = F.col("file_path")
    kind = F.when(F.lower(path).endswith(".pdf"), "pdf").otherwise("md")
    return files.withColumns({"note_slug": slugify(path), "file_title": title_from_path(path), "file_type": kind, "content_hash": F.sha2(F.concat("content", F.encode(F.lit(suffix), "utf-8")), 256)})


def changed(files: DataFrame, known: DataFrame) -> DataFrame:
    """The files whose note is new or has another hash than in ``known(note_slug, content_hash)``."""
    old = known.select("note_slug", F.col("content_hash").alias("_old"))
    return files.join(old, "note_slug", "left").where(~F.col("content_hash").eqNullSafe(F.col("_old"))).drop("_old")


def stale(known: DataFrame, files: DataFrame, keep_pdf: bool = True, scope: str | None = None) -> DataFrame:
    """``(note_slug)`` of the known notes that have no file any more.

    PDF notes are kept where the scan left PDFs out. ``scope``, a regular expression on paths of ``known(file_path)``, limits the
    deletion to the part of the vault that was scanned.
    """
    gone = known.join(files.select("note_slug"), "note_slug", "left_anti")
    gone = gone.where(F.coalesce("file_type", F.lit("")) != "pdf") if keep_pdf else gone
    return (gone.where(F.col("file_path").rlike(scope)) if scope else gone).select("note_slug")


def pack_pages(pages: Sequence[str], tokens: int) -> list[str]:
    """Pages joined while they fit into four characters a token; a longer page is cut at that length, and shares no part with others."""
    room = 4 * tokens
    out: list[str] = []
    open_part = False
    for page in pages:
        if len(page) > room:
            out += [page[k : k + room] for k in range(0, len(page), room)]
            open_part = False
        elif open_part and len(out[-1]) + len(PAGE_BREAK) + len(page) <= room:
            out[-1] += PAGE_BREAK + page
        elif page:
            out.append(page)
            open_part = True
    return out


PARSED = "file_path string, note_slug string, title string, file_type string, content_hash string, position int, heading_path string, heading_level int, has_task boolean, has_code boolean, tags array<string>, text string, plain string, links array<string>, error string"


def parsed(files: DataFrame, settings: Settings, pages: Callable[[bytes], list[str]] | None = None, convert: Callable[[str], str] | None = None, window: int = WINDOW) -> DataFrame:
    """One row per chunk. A file that cannot be read or parsed gives one row with the reason in ``error``.

    ``pages`` gives the text of each page of a PDF, ``convert`` turns such text into Markdown, as much at a time as fits ``window`` tokens
    less those reserved. A PDF of which nothing is left after that keeps its old rows.
    """
    names = [f.split(" ")[0] for f in PARSED.split(", ")]
    schema = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}[f.split(" ")[1]]) for n, f in zip(names, PARSED.split(", "))])

    def rows_of(f: dict) -> Iterator[dict]:
        base = {n: f.get(n) for n in ("file_path", "note_slug", "file_type", "content_hash")} | {"title": f["file_title"]}
        try:
            if f["error"]:
                raise ValueError(f["error"])
            if f["file_type"] == "pdf":
                if pages is None:
                    raise ValueError("no reader for PDF files")
                parts = pack_pages(pages(f["content"]), window - RESERVED)
                text = "\n\n".join(convert(p) if convert else p for p in parts)
            else:
                text = f["content"].decode("utf-8", "replace")
            note = markdown.parse(text, settings.size, settings.overlap, settings.skip_attachments)
        except Exception as e:  # noqa: BLE001 - any fault of a file is reported with it
            yield base | {"error": f"{type(e).__name__}: {e}"}
            return
        title = note.front.get("title")
        if f["file_type"] == "md" and isinstance(title, str) and title.strip():
            base["title"] = title.strip()
        for k, c in enumerate(note.chunks):
            yield base | {"position": k, "heading_path": c.heading_path, "heading_level": c.heading_level, "has_task": c.has_task, "has_code": c.has_code, "tags": note.tags, "text": c.rich, "plain": c.embed, "links": note.links}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, FILES):
                made = [r for f in batch.slice(at, FILES).to_pylist() for r in rows_of(f)]
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in made], schema.field(n).type) for n in names], schema=schema)

    return files.select("file_path", "content", "error", "note_slug", "file_title", "file_type", "content_hash").mapInArrow(run, PARSED)


def numbered(rows: DataFrame, settings: Settings) -> DataFrame:
    """Chunks of enough words, numbered anew within their note. One whose text is empty has its plain one, unless that is marks of code alone."""
    shown = F.when(F.col("text") != "", F.col("text")).when(~is_code_only(F.col("plain")), F.col("plain"))
    enough = rows.where(F.col("error").isNull()).withColumn("text", shown).where(F.col("text").isNotNull() & (word_count(F.col("text")) >= settings.min_words))
    # Chunks are counted by blocks of places of a file, and numbered within a block, so no task sees a whole note.
    block = ["note_slug", "file_path", "block"]
    enough = enough.withColumn("block", F.floor(F.col("position") / BLOCK))
    before = W.partitionBy("note_slug").orderBy("file_path", "block").rowsBetween(W.unboundedPreceding, -1)
    counts = enough.groupBy(*block).agg(F.count("*").alias("n")).select(*block, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    index = (F.col("before") + F.row_number().over(W.partitionBy(*block).orderBy("position")) - 1).cast("int")
    joined = enough.join(counts, block).withColumn("chunk_index", index).drop("block", "before")
    return joined.withColumn("id", F.concat_ws(":", "note_slug", F.col("chunk_index").cast("string")))


def embedded(rows: DataFrame, text: str, embedder: Embedder) -> DataFrame:
    """``rows`` with an ``embedding`` of ``text``; an empty text is embedded as one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = embedder.embed([t or " " for t in batch[text].to_pylist()])
                yield batch.append_column("embedding", pa.array([list(map(float, v)) for v in vectors], pa.list_(pa.float32())))

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", embedding array<float>"
    return rows.mapInArrow(run, schema)


@dataclass
class Report:
    """What an ingest did. ``failures`` is a table ``(file_path, reason)`` of all files that failed, ``failed`` shows the first 20."""

    scanned: int
    written: int
    deleted: int
    n_failed: int
    failed: list[tuple[str, str]]
    failures: DataFrame | None = None


class Ingest:
    """Brings a store up to date with a vault."""

    def __init__(self, spark: SparkSession, store: Store, embedder: Embedder, settings: Settings | None = None, pages: Callable[[bytes], list[str]] | None = None, convert: Callable[[str], str] | None = None, window: int = WINDOW):
        self.spark, self.store, self.embedder, self.settings = spark, store, embedder, settings or Settings()
        self.pages, self.convert, self.window = pages, convert, window
        if self.settings.overlap * 2 >= self.settings.size:
            raise ValueError("the overlap must be less than half the size")

    def files(self, root: str, pattern: str | None = None) -> DataFrame:
        excludes = vault.load_excludes(root) if self.settings.respect_excludes else None
        listed = materialise(vault.list_files(self.spark, root, pattern, self.pages is not None, excludes), "listed")
        return vault.read_files(listed, root)

    def run(self, root: str, pattern: str | None = None) -> Report:
        """One pass: only changed notes are parsed; notes without a file any more go, unless nothing was found at all.

        A note none of whose chunks has enough words keeps its old rows. With a ``pattern`` only notes whose path fits may go.
        """
        found = materialise(hashed(self.files(root, pattern), self.settings, self.embedder.name), "files")
        scanned = found.count()
        if not scanned:
            return Report(0, 0, 0, 0, [])
        known = self.store.chunks.where("chunk_index = 0").select("note_slug", "content_hash", "file_type", "file_path")
        scope = vault.glob_regex(pattern).pattern.replace(r"\Z", r"\z") if pattern else None
        gone = materialise(stale(known, found, self.pages is None, f"^(?s){scope}" if scope else None), "stale")
        rows = materialise(parsed(changed(found, known), self.settings, self.pages, self.convert, self.window), "parsed")
        discard(found)
        report = self._write(scanned, rows, gone)
        discard(gone)
        return report

    def apply(self, files: DataFrame) -> Report:
        """Add or replace the notes of some files, deleting none; what a stream calls for each batch."""
        found = hashed(files, self.settings, self.embedder.name)
        rows = materialise(parsed(changed(found, self.store.meta()), self.settings, self.pages, self.convert, self.window), "parsed")
        return self._write(files.count(), rows, None)

    def _write(self, scanned: int, rows: DataFrame, gone: DataFrame | None) -> Report:
        ready = numbered(rows, self.settings).withColumn("embed", embed_text(F.col("title"), F.col("heading_path"), F.col("tags"), F.when(is_code_only(F.col("plain")), F.col("text")).otherwise(F.col("plain")), self.settings.max_tokens))
        new = materialise(embedded(ready.drop("error"), "embed", self.embedder), "chunks")
        links = new.where("chunk_index = 0").select(F.col("note_slug").alias("source_slug"), F.explode("links").alias("raw"))
        written = new.select("note_slug").distinct().count()
        deleted = gone.distinct().count() if gone is not None else 0
        if written or deleted:
            self.store.replace(new.select([c.split()[0] for c in CHUNKS.split(", ")]), links, gone)
        discard(new)
        faults = vault.failed(rows)
        return Report(scanned, written, deleted, faults.count(), [tuple(r) for r in faults.orderBy("file_path").limit(20).collect()], faults)


def retry_delays(status: int | None, retry_after: float | None, tries: int = 3, first: float = 2.0, most: float = 60.0) -> list[float]:
    """Seconds to wait before each further try of a converter's request: doubling, or what the server asks for, up to a minute.

    None for a status that a repetition does not mend.
    """
    if status is not None and status != 429 and status < 500:
        return []
    if retry_after is not None and math.isfinite(retry_after):
        return [min(max(retry_after, 0.0), most)] * tries
    return [min(first * 2**k, most) for k in range(tries)]
