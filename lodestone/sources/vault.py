"""Files of a vault: listing, patterns, excludes and contents as DataFrames."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "file_path string, content binary, error string"
#: Files, and bytes of files, that are passed on together, and files of a task, about.
FILES_AT_ONCE, BYTES, PER_TASK = 64, 1 << 24, 256


def glob_regex(pattern: str, segments: bool = True) -> re.Pattern[str]:
    """A path pattern as a regular expression: ``*`` and ``?`` stay within a folder, ``**`` crosses folders, ``[..]`` and ``{a,b}`` as in shells.

    An unfinished bracket or brace is an error.
    """
    out, k, depth = "", 0, 0
    one = "[^/]" if segments else "."
    while k < len(pattern):
        c = pattern[k]
        if segments and pattern.startswith("**/", k) and (k == 0 or pattern[k - 1] == "/"):
            out, k = out + "(?:[^/]+/)*", k + 3
            continue
        if segments and pattern.startswith("**", k):
            out, k = out + ".*", k + 2
            continue
        if c == "*":
            out += one + "*"
        elif c == "?":
            out += one
        elif c == "[":
            end = pattern.find("]", k + 2)
            if end < 0:
                raise ValueError(f"bad pattern {pattern!r}")
            inner = pattern[k + 1 : end].replace("\\", "\\\\")
            out, k = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        k += 1
    if depth:
        raise ValueError(f"bad pattern {pattern!r}")
    return re.compile(out + r"\Z", re.S)


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, local or of an address such as ``hdfs://``, and the folder's path in it."""
    if "://" in root:
        return fs.FileSystem.from_uri(root.rstrip("/"))
    return fs.LocalFileSystem(), root.rstrip("/")


def load_excludes(vault: str) -> list[str]:
    """Excluded paths of the vault's own settings; none if it has none or they cannot be read."""
    try:
        system, base = opened(vault)
        with system.open_input_stream(f"{base}/.obsidian/app.json") as f:
            settings = json.loads(f.read())
    except (OSError, ValueError, pa.ArrowException):
        return []
    if not isinstance(settings, dict):
        return []
    filters = [x for x in settings.get("userIgnoreFilters") or [] if isinstance(x, str) and x.strip()]
    folder = settings.get("attachmentFolderPath")
    if isinstance(folder, str) and folder.strip(" ./"):
        filters.append(folder.strip().removeprefix("./").rstrip("/") + "/")
    return filters


def is_excluded(path: str, filters: list[str]) -> bool:
    """Whether a filter fits: a plain one as a beginning of the path, one with wildcards on the path or any part of it."""
    for f in filters:
        f = f.strip().removeprefix("**/")
        if not f:
            continue
        if not re.search(r"[*?\[]", f):
            if path.startswith(f):
                return True
            continue
        try:
            wanted = glob_regex(f)
        except ValueError:
            continue
        if wanted.match(path) or any(wanted.match(part) for part in path.split("/")):
            return True
    return False


def note_test(pattern: str | None = None, pdf: bool = False, excludes: list[str] | None = None) -> Callable[[str], bool]:
    """Whether a path within the vault is one of a note that is wanted."""
    wanted = glob_regex(pattern) if pattern else None

    def fits(path: str) -> bool:
        note = path.lower().endswith(".md") or (pdf and path.lower().endswith(".pdf"))
        return note and not any(p.startswith(".") for p in path.split("/")) and (not wanted or bool(wanted.match(path))) and not (excludes and is_excluded(path, excludes))

    return fits


def wanted_files(paths: DataFrame, pattern: str | None = None, pdf: bool = False, excludes: list[str] | None = None) -> DataFrame:
    """The rows of ``paths(file_path)`` that :func:`note_test` lets pass."""
    fits = note_test(pattern, pdf, excludes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([p is not None and fits(p) for p in batch["file_path"].to_pylist()], pa.bool_()))

    return paths.select("file_path").mapInArrow(run, "file_path string")


def list_files(spark: SparkSession, vault: str, pattern: str | None = None, pdf: bool = False, excludes: list[str] | None = None) -> DataFrame:
    """``(file_path)``: the notes' paths within the vault. Hidden names are skipped, hidden folders with all they hold.

    The vault's own entries are listed here, what lies below its folders in the tasks.
    """
    fits = note_test(pattern, pdf, excludes)

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(vault)
        for batch in batches:
            for path, folder in zip(batch["path"].to_pylist(), batch["folder"].to_pylist()):
                found = [x.path[len(base) + 1 :] for x in system.get_file_info(fs.FileSelector(f"{base}/{path}", recursive=True)) if x.type == fs.FileType.File] if folder else [path]
                yield pa.RecordBatch.from_arrays([pa.array([p for p in found if fits(p)], pa.string())], ["file_path"])

    system, base = opened(vault)
    top = [(x.base_name, x.type == fs.FileType.Directory) for x in system.get_file_info(fs.FileSelector(base)) if not x.base_name.startswith(".")]
    entries = spark.createDataFrame(top, "path string, folder boolean")
    return entries.repartition(max(1, min(len(top), 1000))).mapInArrow(below, "file_path string")


def read_files(listed: DataFrame, vault: str) -> DataFrame:
    """``(file_path, content, error)``: the files, read in the tasks. ``listed`` is a table that was written.

    What cannot be read has a null content and the reason. Spark's own file source skips names that begin with an
    underscore, which notes may have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(vault)
        rows: list[tuple[str, bytes | None, str | None]] = []
        size = 0
        for batch in batches:
            for path in batch["file_path"].to_pylist():
                try:
                    with system.open_input_stream(f"{base}/{path}") as f:
                        rows.append((path, f.read(), None))
                except (OSError, pa.ArrowException) as e:
                    rows.append((path, None, str(e)))
                size += len(rows[-1][1] or b"")
                if size > BYTES or len(rows) == FILES_AT_ONCE:
                    yield _files(rows)
                    rows, size = [], 0
        if rows:
            yield _files(rows)

    return listed.repartition(max(1, listed.count() // PER_TASK)).mapInArrow(run, FILES)


def _files(rows: list[tuple[str, bytes | None, str | None]]) -> pa.RecordBatch:
    path, content, error = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(content, pa.binary()), pa.array(error, pa.string())], ["file_path", "content", "error"])


def failed(files: DataFrame) -> DataFrame:
    """``(file_path, reason)`` of the files that could not be read or parsed."""
    return files.where(F.col("error").isNotNull()).select("file_path", F.col("error").alias("reason"))
