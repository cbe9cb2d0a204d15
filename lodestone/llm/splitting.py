"""Splitting oversized items at natural boundaries (problem 5).

Recursive bisection: a text above the limit is cut at the strongest boundary in the middle half of its
range (of equal ones at that nearest to the midpoint), then each half that is still longer than the
limit minus the overlap. Every piece but the first then takes the overlap from the text before it.
Boundaries are found once per text and kept by strength in sorted arrays, so a cut costs a few binary
searches whatever the length.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = " \t\r\n"
_LINE = re.compile(r"\r\n|\r|\n")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_HEADING = re.compile(r" {0,3}#{1,6}(\s|$)")
_ITEM = re.compile(r"\s*([-*+]|\d{1,9}[.)])\s")
_SENTENCE = re.compile(r"[.!?…]+[\"'”’)\]*_]*\s+(?![a-z])|[。！？]+[”’」』）]*\s*")
_CLAUSE = re.compile(r"[,;:]\s+|[，、；：]\s*")
_SPACE = re.compile(r"\s+")
#: Texts that are cut before their pieces are passed on.
ROWS = 256
#: Strengths, the strongest first.
HEADING, PARAGRAPH, BLOCK, LINE, SENTENCE, INNER, CLAUSE, SPACE = range(8)


def boundaries(text: str) -> list[list[int]]:
    """The places where a piece may begin, in order, by strength. A line within a fence or table is INNER, and so is what
    follows a heading, which should not end a piece. What looks like the end of a sentence is none before a small letter."""
    found: list[list[int]] = [[] for _ in range(8)]
    spans: list[tuple[int, int]] = []  # where sentences are looked for
    fence, start, after_blank, after_heading, table = "", 0, False, False, False
    ends = [m.end() for m in _LINE.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    for end in ends:
        line = text[start:end]
        bare = line.strip()
        mark = _FENCE.match(line)
        if fence:
            kind = INNER
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not line[mark.end() :].strip():
                fence = ""
                spans.append((end, end))
        elif mark:
            kind, fence = (INNER if after_heading else PARAGRAPH if after_blank else BLOCK), mark[1]
        elif _HEADING.match(line):
            kind = HEADING
        elif after_heading:
            kind = INNER
        elif after_blank:
            kind = PARAGRAPH
        elif table and bare.startswith("|"):
            kind = INNER
        elif _ITEM.match(line) or bare.startswith(("|", ">")) or table:
            kind = BLOCK
        else:
            kind = LINE
        if start and bare:
            found[kind].append(start)
        if not fence and not mark and not bare.startswith("|"):
            spans.append((start, end))
        after_blank = not bare and not fence
        after_heading = not fence and not mark and (bool(_HEADING.match(line)) or (not bare and after_heading))
        table = bare.startswith("|") and not fence
        start = end
    merged: list[list[int]] = []
    for a, b in spans:  # sentences may run over lines
        if merged and merged[-1][1] == a:
            merged[-1][1] = b
        else:
            merged.append([a, b])
    for a, b in merged:
        found[SENTENCE] += [m.end() for m in _SENTENCE.finditer(text, a, b) if m.end() < len(text)]
        found[CLAUSE] += [m.end() for m in _CLAUSE.finditer(text, a, b) if m.end() < len(text)]
    found[SPACE] = [m.end() for m in _SPACE.finditer(text) if m.end() < len(text)]
    return found


def _joined(text: str, at: int) -> bool:
    """Whether a cut at ``at`` would part what one reads as a character."""
    c, before = text[at], text[at - 1]
    return bool(unicodedata.combining(c)) or c in "‍️︎" or before == "‍" or (before == "\r" and c == "\n") or "\U0001f3fb" <= c <= "\U0001f3ff"


def cuts(text: str, most: int) -> list[int]:
    """Where pieces of at most ``most`` code points begin, 0 first."""
    if len(text) <= most:
        return [0]
    by = boundaries(text)
    begins, todo = [0], [(0, len(text))]
    while todo:
        lo, hi = todo.pop()
        n = hi - lo
        if n <= most:
            continue
        mid, reach = (lo + hi) / 2, n / 4
        best = 0
        for places in by:
            k = bisect_left(places, mid)
            near = [p for p in places[max(0, k - 1) : k + 1] if abs(p - mid) <= reach and lo < p < hi]
            if near:
                best = min(near, key=lambda p: (abs(p - mid), p))
                break
        if not best:
            best = max(lo + 1, round(mid))
            while best > lo + max(1, n // 4) and _joined(text, best):
                best -= 1
        begins.append(best)
        todo += [(lo, best), (best, hi)]
    return sorted(begins)


def split_text(text: str | None, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """``(start, fresh, end)`` of each piece of the text without outer blanks: it spans start to end, and what is new in it begins at fresh.

    Null and blank texts have no piece, texts within the limit one. Without the overlaps the pieces make up the
    text. The overlap is as long as asked, or reaches back to the text's start; one of more than half
    the limit counts as half of it. Where it would begin within what one reads as a character, it begins behind that.
    """
    text = (text or "").strip(BLANK)
    if not text:
        return []
    if len(text) <= limit:
        return [(0, 0, len(text))]
    overlap = max(0, min(overlap, limit // 2))
    begins = cuts(text, limit - overlap)
    ends = [*begins[1:], len(text)]
    return [(_overlap_start(text, b, overlap), b, e) for b, e in zip(begins, ends)]


def _overlap_start(text: str, fresh: int, overlap: int) -> int:
    start = max(0, fresh - overlap)
    while 0 < start < fresh and _joined(text, start):
        start += 1
    return start


def split_oversized(rows: DataFrame, key: str, text: Column, limit: Column, overlap: Column, *keep: str) -> DataFrame:
    """``(key, piece, start, fresh, end, text, *keep)`` for each text above its limit, pieces in order from 0.

    Lengths count code points without outer spaces, tabs, CR and LF. Texts within the limit, null texts, and rows whose
    limit is null or below 1 give no row; a null overlap counts as 0. Rows given twice give their pieces twice.
    """
    types = dict(rows.dtypes)
    bare = F.btrim(text, F.lit(BLANK))
    wide = rows.select(key, bare.alias("text"), limit.cast("int").alias("limit"), F.coalesce(overlap.cast("int"), F.lit(0)).alias("overlap"), *[F.col(c).alias(f"kept_{c}") for c in keep])
    wide = wide.where((F.col("limit") >= 1) & (F.length("text") > F.col("limit")))
    names = [key, "piece", "start", "fresh", "end", "text", *[f"kept_{c}" for c in keep]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                row: list[int] = []
                made: list[tuple[int, int, int, int]] = []
                pieces: list[str] = []
                for r, (whole, most, shared) in enumerate(zip(*(some[c].to_pylist() for c in ("text", "limit", "overlap")))):
                    for k, (start, fresh, end) in enumerate(split_text(whole, most, shared)):
                        row.append(r)
                        made.append((k, start, fresh, end))
                        pieces.append(whole[start:end])
                again = pa.array(row, pa.int32())
                numbers = np.array(made, np.int32).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([some[key].take(again), *(pa.array(numbers[:, i]) for i in range(4)), pa.array(pieces, pa.string()), *(some[f"kept_{c}"].take(again) for c in keep)], names)

    schema = ", ".join([f"{key} {types[key]}", "piece int, start int, fresh int, end int, text string", *(f"kept_{c} {types[c]}" for c in keep)])
    return wide.mapInArrow(run, schema).select(*names[:6], *[F.col(f"kept_{c}").alias(c) for c in keep])
