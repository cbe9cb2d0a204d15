"""Evaluation texts leaking into training text (problem 7).

The word n-grams of all test items make up a broadcast hash set. A task maps the words of its documents to the
test vocabulary, hashes every window of n known words in one pass of NumPy, looks the hashes up, verifies each
hit word by word, and joins overlapping hits to spans. Documents are neither shuffled nor collected.

The size of the set is checked: items above ``BLOCK_CHARS`` characters in all are searched in several
blocks, one scan after the other, so that one set of bounded size exists at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shingles import WORD
from lodestone.scratch import materialise, spread

# Characters that are removed before words are read.
INVISIBLE = "­​‌‍﻿"
_INVISIBLE = re.compile(f"[{INVISIBLE}]")
#: Characters of test items in one set, whose n-grams then take some 60 MB.
BLOCK_CHARS = 4_000_000
#: Texts that are searched together.
TEXTS = 1000
_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class NgramSet:
    """The n-grams of a set of items."""

    n: int
    vocabulary: dict[str, int]
    hashes: np.ndarray  # sorted
    grams: np.ndarray  # (len(hashes), n) word numbers
    bounds: np.ndarray  # of each n-gram in ``items``
    items: np.ndarray

    @classmethod
    def of(cls, texts: list[tuple[int, str | None]], n: int) -> NgramSet:
        vocabulary: dict[str, int] = {}
        flat: list[int] = []
        ends: list[int] = []
        for _, text in texts:
            flat += [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
            flat += [0] * n  # no window runs into the next item
            ends.append(len(flat))
        words = np.array(flat, np.int32)
        windows = np.lib.stride_tricks.sliding_window_view(words, n) if len(words) >= n else np.zeros((0, n), np.int32)
        at = np.flatnonzero((windows != 0).all(1))
        grams, items = windows[at], np.array([item for item, _ in texts], np.int64)[np.searchsorted(ends, at, "right")]
        order = np.lexsort((items, *grams.T[::-1])) if len(items) else np.zeros(0, int)
        grams, items = grams[order], items[order]
        new = np.r_[True, (grams[1:] != grams[:-1]).any(1)] if len(items) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        grams, bounds = grams[first], np.r_[first, len(items)]
        hashes = window_hashes(grams.ravel(), n)[::n] if len(grams) else np.zeros(0, np.uint64)
        by = np.argsort(hashes, kind="stable")
        counts = np.diff(bounds)[by]
        picked = np.concatenate([items[bounds[g] : bounds[g + 1]] for g in by]) if len(by) else items
        return cls(n, vocabulary, hashes[by], grams[by], np.r_[0, np.cumsum(counts)].astype(np.int64), picked)

    def hits(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(position, n-gram)`` of each verified window; as often as hashes collide."""
        if len(words) < self.n or not len(self.hashes):
            return
        unknown = np.r_[0, np.cumsum(words == 0)]
        at = np.flatnonzero(unknown[self.n :] == unknown[: -self.n])
        if not len(at):
            return
        h = window_hashes(words, self.n)[at]
        gram = np.searchsorted(self.hashes, h)
        while len(at):
            live = gram < len(self.hashes)
            live[live] = self.hashes[gram[live]] == h[live]
            at, h, gram = at[live], h[live], gram[live]
            same = (words[at[:, None] + np.arange(self.n)] == self.grams[gram]).all(1)
            yield at[same], gram[same]
            gram = gram + 1


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    w = words.astype(np.uint64)
    out = np.zeros(len(w) - n + 1, np.uint64)
    for k in range(n):
        out = out * _BASE + w[k : len(w) - n + 1 + k]
    return out


def visible(text: str) -> str:
    return _INVISIBLE.sub("", text)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(visible(text).lower()) if text else []


def _held_items(items: DataFrame, key: str, text: str) -> DataFrame:
    return items.select(F.col(key).cast("long").alias("item"), F.col(text).alias("text")).where("item is not null and text is not null")


def _block_number(items: DataFrame, key: str, text: str) -> int:
    chars = _held_items(items, key, text).agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    return chars // BLOCK_CHARS + 1


def _item_block(items: DataFrame, key: str, text: str, n: int, block: int, blocks: int) -> NgramSet:
    """The set of about ``BLOCK_CHARS`` characters of items."""
    held = _held_items(items, key, text)
    part = held.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block) if blocks > 1 else held
    return NgramSet.of(sorted({(r["item"], r["text"]) for r in part.toLocalIterator()}), n)


def leaked_spans(docs: DataFrame, items: DataFrame, n: int = 12, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc, item_id, first_word, last_word)``: the spans of each document that an item shares with it, n words or more.

    A word is a run of a-z and 0-9 after lower-casing, without the invisible characters. Every word of a span lies in
    a window of ``n`` words that the item holds too; words are numbered from 0, spans of one item do not overlap.
    ``docs`` is a scan. Null texts and rows without key have none. Items given twice count once; a document given twice has its spans twice.
    """
    kind = dict(docs.dtypes)[doc_key]
    held = docs.select(F.col(doc_key).alias("key"), F.col(doc_text).alias("text")).where("key is not null and text is not null")
    held = spread(held)
    sent = []

    def scan(grams: NgramSet) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(grams)
        sent.append(shared)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, TEXTS):
                    part = batch.slice(at, TEXTS)
                    yield _spans(known, *_numbered(known, part["text"].to_pylist()), part["key"])

        return held.mapInArrow(run, f"{doc_key} {kind}, item_id long, first_word int, last_word int")

    blocks = _block_number(items, item_key, item_text)
    if blocks == 1:
        return scan(_item_block(items, item_key, item_text, n, 0, 1))
    found = []
    for b in range(blocks):
        grams = _item_block(items, item_key, item_text, n, b, blocks)
        if len(grams.hashes):
            found.append(materialise(scan(grams), "spans"))
            sent.pop().destroy()
    return reduce(DataFrame.unionByName, found) if found else scan(NgramSet.of([], n))


def _numbered(known: NgramSet, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as numbers, 0 behind each text, and where the texts end."""
    look = known.vocabulary.get
    flat: list[int] = []
    ends: list[int] = []
    for text in texts:
        flat += [look(w, 0) for w in words_of(text)]
        flat.append(0)  # no window runs into the next text
        ends.append(len(flat))
    return np.array(flat, np.int32), np.array(ends)


def _spans(known: NgramSet, words: np.ndarray, ends: np.ndarray, keys: pa.Array) -> pa.RecordBatch:
    found = [(p, g) for p, g in known.hits(words) if len(p)]
    if found:
        place, gram = (np.concatenate(x) for x in zip(*found))
        times = known.bounds[gram + 1] - known.bounds[gram]
        place, item = np.repeat(place, times), np.concatenate([known.items[known.bounds[g] : known.bounds[g + 1]] for g in gram])
        order = np.lexsort((place, item))
        place, item = place[order], item[order]
        doc = np.searchsorted(ends, place, "right")
        begins = np.r_[True, (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + known.n)]
        stops = np.r_[begins[1:], True]
        start = np.r_[0, ends][doc]
        first, last = (place - start)[begins], (place - start)[stops] + known.n - 1
        doc, item = doc[begins], item[begins]
    else:
        first = last = doc = item = np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([keys.take(pa.array(doc)), pa.array(item), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], ["key", "item_id", "first_word", "last_word"])


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without invisible characters and without the words of the spans and what stands between them."""
    text = visible(text)
    lower = text.lower()
    if len(lower) == len(text):
        place = range(len(text) + 1)
    else:  # a few letters become two
        place = [k for k, c in enumerate(text) for _ in c.lower()] + [len(text)]
        lower = "".join(c.lower() for c in text)
    words = [m.span() for m in WORD.finditer(lower)]
    gone, out, at = sorted(spans), [], 0
    for a, b in gone:
        begin, end = place[words[a][0]], place[words[b][1] - 1] + 1
        if begin > at:
            out.append(text[at:begin])
        at = max(at, end)
    return "".join([*out, text[at:]])


def without_leaks(docs: DataFrame, items: DataFrame, n: int = 12, most: float = 0.5, doc_key: str = "doc_id", doc_text: str = "text", **options) -> DataFrame:
    """``(doc, n_words, n_leaked, text)`` for the documents that hold leaked spans: the text without them, null if more than
    ``most`` of its words leaked and the document is to be dropped. A key must name one document."""
    kind = dict(docs.dtypes)[doc_key]
    schema = f"{doc_key} {kind}, n_words int, n_leaked int, text string"
    item_key, item_text = options.get("item_key", "item_id"), options.get("item_text", "text")
    if _block_number(items, item_key, item_text) == 1:  # the documents need not meet their spans again
        shared = docs.sparkSession.sparkContext.broadcast(_item_block(items, item_key, item_text, n, 0, 1))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, TEXTS):
                    part = batch.slice(at, TEXTS)
                    texts = part["text"].to_pylist()
                    found = _spans(shared.value, *_numbered(shared.value, texts), pa.array(range(len(texts)), pa.int32()))
                    by: dict[int, set[tuple[int, int]]] = {}
                    for doc, first, last in zip(*(found[c].to_pylist() for c in ("key", "first_word", "last_word"))):
                        by.setdefault(doc, set()).add((first, last))
                    yield _cleaned(part["key"].take(pa.array(list(by), pa.int32())), [texts[doc] for doc in by], list(by.values()), most)

        held = docs.select(F.col(doc_key).alias("key"), F.col(doc_text).alias("text")).where("key is not null and text is not null")
        return spread(held).mapInArrow(search, schema)

    spans = leaked_spans(docs, items, n, doc_key, doc_text, **options)
    per = spans.groupBy(doc_key).agg(F.collect_set(F.struct("first_word", "last_word")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _cleaned(batch["key"], batch["text"].to_pylist(), [{(s["first_word"], s["last_word"]) for s in found} for found in batch["spans"].to_pylist()], most)

    joined = docs.select(F.col(doc_key).alias("key"), F.col(doc_text).alias("text")).join(per.withColumnRenamed(doc_key, "key"), "key")
    return joined.mapInArrow(run, schema)


def _cleaned(keys: pa.Array, texts: list[str], spans: list[set[tuple[int, int]]], most: float) -> pa.RecordBatch:
    total = [len(words_of(t)) for t in texts]
    leaked = [len({w for a, b in pairs for w in range(a, b + 1)}) for pairs in spans]
    left = [without_words(t, list(pairs)) if k <= most * n else None for t, pairs, n, k in zip(texts, spans, total, leaked)]
    return pa.RecordBatch.from_arrays([keys, pa.array(total, pa.int32()), pa.array(leaked, pa.int32()), pa.array(left, pa.string())], ["key", "n_words", "n_leaked", "text"])
