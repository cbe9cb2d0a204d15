"""Results as JSON, tab-separated lines and text, and paths into the JSON."""

from __future__ import annotations

import json
import re
from collections import Counter
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scalars import LEAST_TITLE, tsv_escape

# The columns of results as tab-separated lines and as JSON, and their heads.
TSV = ("slug", "title", "file_path", "score", "tags", "extra", "heading_path", "text")
FIELDS = ("note_slug", "title", "file_path", "score", "is_phantom", "chunk_index", "tags", "extra", "heading_path", "text", "context", "matched_queries", "file_type", "lexical")
NOTE_TSV = ("note_slug", "title", "file_path", "tags", "chunks", "text")
#: Sections that a deep search names for a result; the others are counted.
SECTIONS = 3


def tsv_rows(results: DataFrame) -> DataFrame:
    """``(line)``: eight columns, escaped, the score with six decimals, tags with commas between them; columns that are missing are empty."""

    def shown(c: str) -> Column:
        c = "note_slug" if c == "slug" else c
        if c not in results.columns:
            return F.lit("")
        if c == "score":
            return F.format_string("%f", F.col(c).cast("double"))
        return tsv_escape(F.array_join(c, ",") if c == "tags" else F.col(c).cast("string"))

    return results.select(F.concat_ws("\t", *[shown(c) for c in TSV]).alias("line"))


def json_rows(results: DataFrame) -> DataFrame:
    """``(json)``: one object per row of the ``FIELDS`` that are there, without empty ones (null, false, zero, empty texts and lists)."""
    kept = []
    for f in results.select(*[c for c in FIELDS if c in results.columns]).schema.fields:
        c, kind = F.col(f.name), f.dataType.typeName()
        empty = c.isNull() | (F.size(c) == 0 if kind == "array" else c == "" if kind == "string" else ~c if kind == "boolean" else c == 0)
        always = f.name in ("note_slug", "title", "score")
        kept.append((c if always else F.when(~F.coalesce(empty, F.lit(True)), c)).alias(f.name))
    return results.select(F.to_json(F.struct(*kept)).alias("json"))


def envelope(results: DataFrame, command: str, query: str, queries: list[str] | None = None) -> dict[str, Any]:
    """The answer to one command. Results are collected, which their limit bounds."""
    rows = [json.loads(r["json"]) for r in json_rows(results).collect()]
    return {"command": command, "query": query, **({"queries": queries} if queries else {}), "total": len(rows), "results": rows}


def text_lines(results: list[dict[str, Any]], width: int = 0, queries: int = 1, deep: bool = False) -> list[str]:
    """Results for reading: rank, title with heading (or number, if its note comes more than once), score, what else is known.

    ``width`` is that of the terminal, 0 for none: longer titles and lines are cut. A ``deep`` search lists sections and tags below.
    """
    times = Counter(r["note_slug"] for r in results)
    room = max(min(width - 40, 80), 20) if width else 42
    out = []
    for rank, r in enumerate(results, 1):
        title = ("[PDF] " if r.get("file_type") == "pdf" else "") + (r.get("title") or "")
        if r.get("heading_path"):
            short = short_heading(r.get("title") or "", r["heading_path"])
            title += f" (§ {short})" if short else ""
        elif times[r["note_slug"]] > 1:
            title += f" (chunk #{(r.get('chunk_index') or 0) + 1})"
        title = cut_to(title, room) if width else title
        line = f"{rank}. {title:<{room}}  score={r.get('score') or 0:.4f}"
        line += f"  [{r['extra']}]" if r.get("extra") else ""
        line += "  [phantom]" if r.get("is_phantom") else ""
        chips, matched = " ".join(f"#{t}" for t in r.get("tags") or ()), r.get("matched_queries") or []
        if deep:
            out += [cut_to(line, width) if width else line, *_details(matched, chips, width or 140), *([""] if rank < len(results) else [])]
            continue
        line += f"  [{chips}]" if chips else ""
        line += "  [hits: " + ", ".join(f'"{q}"' for q in matched) + "]" if matched and queries > 1 else ""
        out.append(cut_to(line, width) if width else line)
    return out


def _details(matched: list[str], chips: str, width: int) -> list[str]:
    parts = []
    if matched:
        shown = [*matched[:SECTIONS], *([f"… (+{len(matched) - SECTIONS} more)"] if len(matched) > SECTIONS else [])]
        parts.append(f"Matched target sections ({len(matched)}): " + ", ".join(f'"{q}"' for q in shown))
    parts += [f"Tags: {chips}"] if chips else []
    return [cut_to(("   └─ " if k == len(parts) - 1 else "   ├─ ") + p, width) for k, p in enumerate(parts)]


def cut_to(text: str, width: int) -> str:
    return text if len(text) <= width else text[: width - 1] + "…"


def short_heading(title: str, heading: str) -> str:
    """As ``scalars.trimmed_heading``, of one row."""
    plain = lambda s: re.sub(r"[\W_]+", "", s.lower())
    first, _, rest = heading.strip().partition(" > ")
    a, b = plain(title), plain(first)
    same = min(len(a.encode()), len(b.encode())) >= LEAST_TITLE and (a.startswith(b) or b.startswith(a))
    return rest if a and (a == b or same) else heading.strip()


def hint(command: str, **flags: bool) -> str:
    """What to try when a command finds nothing."""
    again = "the vault may have to be ingested again"
    if command == "hidden":
        linked = "" if flags.get("include_linked") else "what is similar may be linked already (--include-linked shows it), or "
        return f"Nothing similar found: {linked}the note stands alone, or {again}."
    if command == "tags":
        more = "--min-shared may be lower" if flags.get("shared") else "--children takes in tags below it" if not flags.get("children") else "see tags --list"
        return f"No notes found: {more}, or {again}."
    return {
        "search": f"No notes match: try other words, or {again}.",
        "boosted": "No notes match: try other words or another --boost.",
        "backlinks": f"No links lead here, or {again}.",
        "connections": "No links within so many hops: try more --hops.",
    }.get(command, "nothing found")


def tag_lines(tags: list[dict[str, Any]], style: str) -> list[str]:
    """A list of tags as text, tab-separated lines or JSON."""
    if style == "json":
        return [json.dumps({"command": "tags --list", "total": len(tags), "tags": tags}, ensure_ascii=False, indent=2)]
    if style == "tsv":
        return ["tag\tcount", *(f"{_escaped(t['tag'])}\t{t['count']}" for t in tags)]
    return [f"#{t['tag']}\t({t['count']} {'note' if t['count'] == 1 else 'notes'})" for t in tags]


def note_lines(note: dict[str, Any], style: str, query: str) -> list[str]:
    """One note as text, a tab-separated line (with the text as it is) or JSON."""
    if style == "json":
        return [json.dumps({"command": "get", "query": query, "note": {k: v for k, v in note.items() if k != "tags" or v}}, ensure_ascii=False, indent=2)]
    if style == "tsv":
        return ["\t".join(NOTE_TSV), "\t".join(str(",".join(note[c] or []) if c == "tags" else "" if note[c] is None else note[c]) for c in NOTE_TSV)]
    path, tags = note["file_path"], " ".join(f"#{t}" for t in note["tags"] or [])
    return [note["title"] or "", *([f"Path:   {path}"] if path else []), *([f"Tags:   {tags}"] if tags else []), f"Chunks: {note['chunks']}", "", *([note["text"], ""] if note["text"] else [])]


def stats_lines(stats: dict[str, int], style: str) -> list[str]:
    if style == "json":
        return [json.dumps({"command": "stats", **stats}, indent=2)]
    if style == "tsv":
        return ["\t".join(stats), "\t".join(map(str, stats.values()))]
    return [f"{k.capitalize():<6}  {v}" for k, v in stats.items()]


def _escaped(text: str) -> str:
    for raw, shown in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        text = text.replace(raw, shown)
    return text


_STEP = re.compile(r"\.\.|\.|([\w-]+)|\[(\*|-?\d+|'[^']*'|\"[^\"]*\"|-?\d*:-?\d*|\?\(@\.([\w.-]+)\s*(==|!=|>=|<=|>|<)\s*([^)]+)\))\]|\*")


def json_path(value: Any, path: str) -> list[Any]:
    """What a path finds: ``$.a.b``, ``[0]``, ``[-1]``, ``[1:3]``, ``[*]``, ``..key`` and ``[?(@.key > 1)]``; ``{.a}``, ``.a`` and ``a`` mean ``$.a``."""
    path = path.strip()
    if path.startswith("{") and path.endswith("}"):
        path = path[1:-1].strip()
    path = path.removeprefix("$")
    found, deep, at = [value], False, 0
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            raise ValueError(f"bad path at {path[at:]!r}")
        at = m.end()
        if m[0] in (".", ".."):
            deep = m[0] == ".."
            continue
        pool = [x for v in found for x in _below(v)] if deep else found
        deep = False
        found = [x for v in pool for x in _take(v, m)]
    return found


def _below(v: Any) -> list[Any]:
    inner = v.values() if isinstance(v, dict) else v if isinstance(v, list) else ()
    return [v, *(x for i in inner for x in _below(i))]


def _take(v: Any, m: re.Match[str]) -> list[Any]:
    key, index = m[1], m[2]
    if m[0] == "*" or index == "*":
        return list(v.values()) if isinstance(v, dict) else list(v) if isinstance(v, list) else []
    if key is None and index[0] in "'\"":
        key = index[1:-1]
    if key is not None:
        return [v[key]] if isinstance(v, dict) and key in v else []
    if not isinstance(v, list):
        return []
    if m[3]:
        return [x for x in v if _holds(json_path(x, m[3]), m[4], m[5].strip())]
    if ":" in index:
        a, b = (int(p) if p else None for p in index.split(":"))
        return v[a:b]
    k = int(index)
    return [v[k]] if -len(v) <= k < len(v) else []


def _holds(found: list[Any], sign: str, text: str) -> bool:
    wanted = text[1:-1] if text[:1] in "'\"" else json.loads(text)
    for x in found:
        try:
            if {"==": x == wanted, "!=": x != wanted}.get(sign) or (sign in (">", ">=", "<", "<=") and {">": x > wanted, ">=": x >= wanted, "<": x < wanted, "<=": x <= wanted}[sign]):
                return True
        except TypeError:
            continue
    return False


def printed(value: Any, path: str) -> list[str]:
    """A line for each thing that a path finds; the items of a single list are lines of their own."""
    found = json_path(value, path)
    if len(found) == 1 and isinstance(found[0], list):
        found = found[0]
    return [x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in found]
