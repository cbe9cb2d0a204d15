"""``python -m lodestone COMMAND``: ingest a vault and ask questions. Exit codes: 0 done, 1 failed, 2 wrong use."""

from __future__ import annotations

import argparse
import importlib
import json
import os
import shutil
import sys
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import __version__
from lodestone.engine import Engine, distinct_queries
from lodestone.operators import filters, ingest, output
from lodestone.operators.notes import group_by_note
from lodestone.operators.tags import suggest_tags
from lodestone.sources import convert
from lodestone.sources.config import Settings
from lodestone.sources.store import Store

#: Rows of a list without a limit of its own that are shown; more are counted.
MOST_SHOWN = 10_000


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("lodestone")
    p.add_argument("--store", default=None, help="folder of the store")
    p.add_argument("--config", default="lodestone.toml")
    p.add_argument("--embedder", help="module:factory of the vectors to use; feature hashing if not given")
    p.add_argument("--format", choices=("text", "json", "tsv"), default="text")
    p.add_argument("--json-path", help="part of the JSON to print")
    p.add_argument("--min-score", type=float, default=None)
    p.add_argument("--show-phantoms", action="store_true")
    p.add_argument("--show-tags", action=argparse.BooleanOptionalAction, default=None)
    p.add_argument("--show-file-path", action=argparse.BooleanOptionalAction, default=None)
    p.add_argument("--include-text", action="store_true", help="show the matched text")
    p.add_argument("--group-by-note", action="store_true")
    p.add_argument("--exact", action="store_true", help="rank all chunks, without the limit of 100 rows")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args: tuple, limit: int | None = None) -> None:
        c = sub.add_parser(name)
        for flag, options in args:
            c.add_argument(*flag.split(), **options)
        if limit is not None:
            c.add_argument("--limit", type=int, default=limit)

    yes, number = {"action": "store_true"}, {"type": int}
    command(
        "ingest", ("vault", {}), ("glob", {"nargs": "?"}), ("--chunk-size", number), ("--chunk-overlap", number), ("--min-chunk-words", number), ("--max-embed-tokens", number), ("--respect-exclude", yes),
        ("--enable-pdf", yes), ("--pdf-reader", {"help": "module:function from the bytes of a PDF to the texts of its pages"}), ("--llm-model", {}), ("--llm-context-window", number),
    )
    command("search", ("query", {"nargs": "*"}), ("--top-k", {"type": int, "default": 3}), ("--section", {}), ("--tag", {}), ("--has-tasks", yes), ("--has-code", yes), ("--with-pdf", yes), ("--exclude-note", {"action": "append", "default": []}), ("--context-window", {"type": int, "default": 0}), limit=10)
    command("tags", ("query", {"nargs": "?", "default": ""}), ("--list", yes), ("--shared --for-note", yes), ("--children", yes), ("--min-shared", {"type": int, "default": 1}), limit=0)
    command("backlinks", ("note", {}))
    command("connections", ("note", {}), ("--hops", {"type": int, "default": 2}))
    command("hidden", ("note", {}), ("--deep", yes), ("--include-linked", yes), ("--top-k --candidate-chunks", {"type": int, "default": 3}), limit=10)
    command("boosted", ("query", {}), ("--seed", {"required": True}), ("--boost", {"type": float, "default": 1.5}), limit=10)
    command("get", ("note", {}), ("--meta", yes), ("--head", {"type": int, "default": 0}))
    for name in ("stats", "doctor", "suggest-notes", "index", "reset"):
        command(name)
    return p


def named(spec: str) -> Callable[..., Any]:
    """What ``module:name`` names."""
    module, _, name = spec.partition(":")
    try:
        return getattr(importlib.import_module(module), name)
    except (ImportError, AttributeError, ValueError) as e:
        raise ValueError(f"{spec!r} names nothing: {e}") from e


def queries_of(a: argparse.Namespace) -> list[str]:
    given = a.query or ([] if sys.stdin is None or sys.stdin.isatty() else [sys.stdin.read()])
    return distinct_queries(given)


def answer(a: argparse.Namespace, engine: Engine) -> DataFrame:
    """The rows of a command that asks something."""
    if a.command == "search":
        tag = a.tag and a.tag.strip().removeprefix("#").lower()
        where = filters.SearchFilter(a.section, a.has_tasks, a.has_code, a.with_pdf, tag or None)
        a.query = queries_of(a)
        return engine.search(a.query, a.limit, a.top_k, where, a.min_score or 0.0, a.context_window, a.exclude_note)
    if a.command == "tags":
        if not a.query.strip() and not a.list:
            raise UsageError("a tag is needed, or --list")
        if a.list:
            return engine.list_tags(a.limit)
        if a.shared:
            return engine.shared_tags(a.query, a.min_shared).limit(a.limit or 50)
        return engine.tag_search(a.query, a.limit, a.children)
    return {
        "backlinks": lambda: engine.backlinks(a.note),
        "connections": lambda: engine.connections(a.note, a.hops),
        "hidden": lambda: engine.hidden(a.note, a.limit, a.include_linked, a.deep, a.top_k),
        "boosted": lambda: engine.boosted(a.query, a.seed, a.boost, a.limit),
        "suggest-notes": engine.slugs,
    }[a.command]()


class UsageError(ValueError):
    """A command that cannot be meant so."""


def _rows(rows: DataFrame) -> list[dict[str, Any]]:
    """Rows for printing, as many as a reader can take in; what is left out is said."""
    found = [r.asDict(recursive=True) for r in rows.limit(MOST_SHOWN + 1).collect()]
    if len(found) > MOST_SHOWN:
        print(f"only the first {MOST_SHOWN} rows are shown", file=sys.stderr)
    return found[:MOST_SHOWN]


def shown(a: argparse.Namespace, engine: Engine) -> list[str]:
    """The lines of a command's answer."""
    if a.command in ("get", "stats"):
        return _one(a, engine)
    rows = answer(a, engine)
    if a.command == "tags" and a.list:
        tags = _rows(rows)
        return output.printed({"command": "tags --list", "total": len(tags), "tags": tags}, a.json_path) if a.json_path else output.tag_lines(tags, a.format)
    if a.command == "suggest-notes":
        return [r["note_slug"] for r in _rows(rows)]
    if a.group_by_note:
        rows = group_by_note(rows.withColumn("position", F.monotonically_increasing_id()))
    mask = [c for c, show in (("tags", a.show_tags), ("file_path", a.show_file_path is not False), ("text", a.include_text)) if not show and c in rows.columns]
    rows = filters.present(rows, a.min_score if a.command in ("search", "hidden", "boosted") else None, a.show_phantoms, tuple(mask))
    query = " ".join(a.query) if a.command == "search" else getattr(a, "query", None) or getattr(a, "note", "") or ""
    asked = a.query if a.command == "search" and len(a.query) > 1 else None
    if a.json_path or a.format == "json":
        made = output.envelope(rows, a.command, query, asked)
        return output.printed(made, a.json_path) if a.json_path else [json.dumps(made, ensure_ascii=False, indent=2)]
    if a.format == "tsv":
        return ["\t".join(output.TSV), *(r["line"] for r in _rows(output.tsv_rows(rows)))]
    found = _rows(rows.select(*[c for c in output.FIELDS if c in rows.columns]))
    if not found:
        flags = {k: getattr(a, k, False) for k in ("include_linked", "shared", "children")}
        return [output.hint(a.command, **flags), *_meant(a, engine)]
    width = shutil.get_terminal_size((0, 0)).columns if sys.stdout.isatty() else 0
    return output.text_lines(found, width, len(asked or ()), a.command == "hidden" and a.deep)


def _meant(a: argparse.Namespace, engine: Engine) -> list[str]:
    """Tags that a tag without notes may have been meant for."""
    if a.command != "tags" or a.shared or a.children:
        return []
    near = [f"#{r['tag']}" for r in suggest_tags(engine.headers(), a.query.removeprefix("#"), 3).collect()]
    return [f"Did you mean: {', '.join(near)}?"] if near else []


def _one(a: argparse.Namespace, engine: Engine) -> list[str]:
    if a.command == "stats":
        stats = engine.stats().first().asDict()
        return output.printed(stats, a.json_path) if a.json_path else output.stats_lines(stats, a.format)
    row = engine.content(a.note, a.head or None, a.meta)
    return output.printed(row, a.json_path) if a.json_path else output.note_lines(row, a.format, a.note)


def ingested(a: argparse.Namespace, spark: SparkSession, store: Store, embedder: ingest.Embedder, settings: Settings) -> ingest.Report:
    number = lambda name, usual: int(getattr(a, name) if getattr(a, name) is not None else settings.get(name, usual))
    cut = ingest.Settings(number("chunk_size", 800), number("chunk_overlap", 100), number("min_chunk_words", 10), number("max_embed_tokens", 256), True, bool(a.respect_exclude or settings.get("respect_exclude", False)))
    pages = service = None
    window = number("llm_context_window", ingest.WINDOW)
    if a.enable_pdf or settings.get("enable_pdf", False):
        reader = a.pdf_reader or settings.get("pdf_reader")
        if not reader:
            raise UsageError("PDFs need --pdf-reader")
        pages = named(reader)
        service = convert.converter(a.llm_model or settings.get("llm_model", ""), window, os.environ)
    return ingest.Ingest(spark, store, embedder, cut, pages, service, window).run(a.vault, a.glob)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    settings = Settings.of_file(a.config)
    if spark is None:
        from lodestone.session import local_session

        spark = local_session()
        spark.sparkContext.setLogLevel("ERROR")
    store = Store(spark, a.store or settings.get("store", os.environ.get("LODESTONE_STORE", "lodestone-store")))
    for flag, usual in (("show_tags", False), ("show_file_path", True)):
        if getattr(a, flag) is None:
            setattr(a, flag, bool(settings.get(flag, usual)))
    try:
        spec = a.embedder or settings.get("embedder")
        embedder = named(spec)() if spec else ingest.HashingEmbedder(int(settings.get("dim", 384)))
        if a.command == "ingest":
            report = ingested(a, spark, store, embedder, settings)
            print(json.dumps({k: v for k, v in report.__dict__.items() if k != "failures"}, ensure_ascii=False))
            return int(report.n_failed > 0)
        if a.command == "doctor":
            faults = store.check()
            print(json.dumps(faults))
            return int(any(faults.values()))
        if a.command == "index":
            engine = Engine(store, embedder)
            reads = engine.build_index(len(engine.vectors(["x"])[0]))
            print(json.dumps({"cells": len(engine.index.centres), "read by a search": reads}))
            return 0
        if a.command == "reset":
            store.reset()
            return 0
        print("\n".join(shown(a, Engine(store, embedder, a.exact))))
        return 0
    except (LookupError, ValueError) as e:
        print(json.dumps({"error": str(e)}) if a.format == "json" else f"error: {e}", file=sys.stderr)
        return 2 if isinstance(e, UsageError) or (isinstance(e, LookupError) and "ambiguous" in str(e)) else 1


if __name__ == "__main__":
    sys.exit(main())
