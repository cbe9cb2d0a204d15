"""Reading level of each document (problem 8).

A linear ranker is learned from pairs of graded passages: for a pair whose bands differ the harder passage must score
higher (logistic loss on the difference of syntax and vocabulary features). Isotonic regression turns scores into
positions on the bands' scale. A document's prose is scored block by block, as documents mix levels, and
the band that holds most of its words is the document's.

Which blocks are English is measured as well: letter trigrams of the graded passages make up a model, and a block counts if its
mean log-probability is less than half as far from that of held-out passages as from that of the same passages with shuffled letters. So
languages need not be known to be rejected. The model is learned on the driver from at most ``MOST_SAMPLES`` graded passages, as
many of each band, and ``MOST_PAIRS`` pairs of their parts; documents are neither shuffled nor collected, and are measured by NumPy
over the characters of many at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm import prose
from lodestone.scratch import spread

#: Graded passages that are used, as many of each band, by the hash of key and text; documented bound of the training set.
MOST_SAMPLES = 2000
#: Pairs of parts that the ranker is fitted on; of more, so many are drawn.
MOST_PAIRS = 200_000
LEAST_WORDS = 80
#: Words of a training passage's parts, about the size of a block.
PART_WORDS = 40
#: Share of the graded passages that a common word occurs in.
COMMON_SHARE = 0.25
#: Letters below which a block is too short to tell its language.
SHORT = 24
#: Characters that are measured at a time.
CHARS = 1 << 20
# The words that open subordinate clauses in English.
SUBORDINATORS = "after although as because before if lest once since than that though till unless until what whatever when whenever where whereas wherever whether which whichever while who whoever whom whose why".split()
FEATURES = ("letters per word", "share of words up to 3 letters", "share from 7 letters", "share from 10 letters", "share from 13 letters", "log words per sentence", "commas per word", "share of subordinators", "share of common words")

_TOP = 0x20000
_CHARS = [chr(c) for c in range(_TOP)]
#: Properties of characters; those from _TOP on are taken as the last one, a letter of a rare script.
_LOWER = np.array([ord(x) if len(x := c.lower()) == 1 else ord(c) for c in _CHARS], np.uint32)
_LETTER = np.array([c.isalpha() for c in _CHARS])
_LETTER[-1] = True
_WORD = np.isin(_LOWER, [ord(c) for c in "abcdefghijklmnopqrstuvwxyz0123456789"])
_CLASS = np.where(_LETTER, 27, 0).astype(np.int16)
_CLASS[97:123] = _CLASS[65:91] = np.arange(1, 27)
_END, _CLOSE, _BLANK, _FULL = (np.isin(np.arange(_TOP), [ord(c) for c in s]) for s in (".!?…", "\"'”’)]*", " \t\r\n\u00a0", "。！？"))
_CUT, _ITEM = 1, 0  # the characters between blocks and before list items
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def word_code(word: str) -> int:
    """The number that :func:`measure` gives a word in lower case."""
    return sum(ord(c) * pow(int(_BASE), k, 1 << 64) for k, c in enumerate(word)) % (1 << 64)


@dataclass
class Measures:
    """Of each block: features, words, letters, words of a-z and 0-9, letters in words with others than ASCII, and letter trigrams."""

    x: np.ndarray
    words: np.ndarray
    letters: np.ndarray
    plain: np.ndarray
    foreign: np.ndarray
    trigrams: np.ndarray  # codes of all blocks
    of: np.ndarray  # the block of each trigram


def measure(blocks: list[str], common: np.ndarray) -> Measures:
    """``common`` are the sorted codes of common words."""
    k = len(blocks)
    c = np.minimum(np.frombuffer(chr(_CUT).join(blocks).encode("utf-32-le", "replace"), np.uint32), _TOP - 1)
    low, letter = _LOWER[c], _LETTER[c]
    cuts = np.flatnonzero(c == _CUT)
    block = lambda at: np.searchsorted(cuts, at)
    count = lambda at, w=None: np.bincount(block(at), w, k)
    edge = np.diff(np.r_[False, letter, False].astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    length, of = end - start, block(start)
    share = lambda good: np.bincount(of[good], minlength=k) / n
    power = np.cumprod(np.r_[np.uint64(1), np.full(len(c), _BASE)])
    back = np.cumprod(np.r_[np.uint64(1), np.full(len(c), _BACK)])
    total = np.r_[np.uint64(0), np.cumsum(low.astype(np.uint64) * power[:-1])]
    code = (total[end] - total[start]) * back[start]
    held = lambda wanted: wanted[np.minimum(np.searchsorted(wanted, code), len(wanted) - 1)] == code if len(wanted) else np.zeros(len(code), bool)
    words = np.bincount(of, minlength=k)
    n = np.maximum(words, 1)
    letters = np.bincount(of, length, k)
    # A sentence ends where white space follows a mark, closing quotes between them aside, and where a list item follows.
    solid = np.flatnonzero(~_CLOSE[c])
    after = solid[1:][_END[c[solid[:-1]]] & _BLANK[c[solid[1:]]]]
    item = np.flatnonzero(c == _ITEM) - 1
    after = np.union1d(after[after + 1 < len(c)], item[(item >= 0) & (c[item] != _CUT)])
    sentences = 1 + count(after[c[after + 1] != _CUT]) + count(np.flatnonzero(_FULL[c]))
    x = np.stack([
        letters / n, share(length <= 3), share(length >= 7), share(length >= 10), share(length >= 13), np.log(n / sentences),
        count(np.flatnonzero((c == 44) | (c == 59))) / n, share(held(_OPENERS)), share(held(common)),
    ], axis=1)
    run = _WORD[c]
    odd = np.r_[0, np.cumsum(c > 127)]
    alien = odd[end] > odd[start]
    kept = letter | np.r_[False, letter[:-1]]  # letters, and one place behind each word
    seq, place = _CLASS[low[kept]].astype(np.int32), np.flatnonzero(kept)
    return Measures(x, words, letters, count(np.flatnonzero(run & ~np.r_[False, run[:-1]])), np.bincount(of[alien], length[alien], k), seq[:-2] * 784 + seq[1:-1] * 28 + seq[2:], block(place[2:]))


_OPENERS = np.sort(np.array([word_code(w) for w in SUBORDINATORS], np.uint64))


@dataclass
class English:
    """A model of letter trigrams."""

    log: np.ndarray
    least: float  # mean log-probability from which a block is English

    @staticmethod
    def _log(trigrams: np.ndarray) -> np.ndarray:
        n = np.bincount(trigrams, minlength=28**3) + 0.05
        return np.log(n / n.sum())

    @classmethod
    def learn(cls, passages: list[str], folds: int = 5) -> English:
        """The bound lies a third of the way from passages that were held out to the same ones with their letters shuffled."""
        rng = np.random.default_rng(1)
        none = np.zeros(0, np.uint64)
        own = [measure([p], none).trigrams for p in passages]
        mixed = []
        for p in passages:
            letters = [ch for ch in p.lower() if ch.isalpha()]
            drawn = iter(rng.permutation(letters))
            mixed.append(measure(["".join(next(drawn) if ch.isalpha() else ch for ch in p.lower())], none).trigrams)
        right, wrong = [], []
        for f in range(min(folds, len(passages))):
            log = cls._log(np.concatenate([t for k, t in enumerate(own) if k % folds != f] or own))
            right += [log[t].mean() for t in own[f::folds] if len(t)]
            wrong += [log[t].mean() for t in mixed[f::folds] if len(t)]
        return cls(cls._log(np.concatenate(own)), float(2 * np.mean(right) + np.mean(wrong)) / 3)

    def scores(self, m: Measures) -> np.ndarray:
        """The mean log-probability of each block."""
        n = np.bincount(m.of, minlength=len(m.words))
        return np.bincount(m.of, self.log[m.trigrams], len(m.words)) / np.maximum(n, 1)


def isotonic(y: np.ndarray) -> np.ndarray:
    """The rising sequence nearest to ``y`` (pool adjacent violators)."""
    pools: list[list[float]] = []
    for v in y:
        pools.append([float(v), 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, nb = pools.pop()
            a, na = pools.pop()
            pools.append([(a * na + b * nb) / (na + nb), na + nb])
    return np.concatenate([np.full(n, v) for v, n in pools]) if pools else np.zeros(0)


@dataclass
class LevelModel:
    bands: tuple[str, ...]
    english: English
    common: np.ndarray  # sorted codes of words
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray  # scores, rising
    values: np.ndarray  # positions on the bands' scale at the knots, 0 to len(bands) - 1

    def position(self, x: np.ndarray) -> np.ndarray:
        return np.interp(((x - self.centre) / self.scale) @ self.weights, self.knots, self.values)

    @classmethod
    def learn(cls, graded: list[tuple[str, str]], bands: tuple[str, ...], penalty: float = 1e-3, steps: int = 400, most_pairs: int = MOST_PAIRS) -> LevelModel:
        """From ``(band, passage)``; ``bands`` from the easiest to the hardest. Passages of other bands or without words are passed over."""
        rank = {b: k for k, b in enumerate(bands)}
        used = [(rank[band], text) for band, text in graded if band in rank and text and prose.LETTERS.search(text)]
        if len({y for y, _ in used}) < 2:
            raise ValueError("passages of at least two bands are needed")
        seen = Counter(w for _, text in used for w in {w.lower() for w in prose.LETTERS.findall(text)})
        common = np.sort(np.array([word_code(w) for w, n in seen.items() if n >= COMMON_SHARE * len(used)], np.uint64))
        parts = [(y, part) for y, text in used for part in _parts(text)]
        m = measure([part for _, part in parts], common)
        y, x = np.array([y for y, _ in parts])[m.words > 0], m.x[m.words > 0]
        centre, scale = x.mean(0), x.std(0) + 1e-9
        z = (x - centre) / scale
        hard, easy = _pairs(y, most_pairs)
        gap = z[hard] - z[easy]
        w = np.zeros(x.shape[1])
        for _ in range(steps):
            w -= 1.0 * (-(gap * (1 / (1 + np.exp(gap @ w)))[:, None]).mean(0) + penalty * w)
        order = np.argsort(z @ w, kind="stable")
        knots, values = (z @ w)[order], isotonic(y[order].astype(float))
        keep = np.r_[True, np.diff(knots) > 0]
        return cls(bands, English.learn(["\n".join(prose.blocks(text)) for _, text in used]), common, centre, scale, w, knots[keep], values[keep])

    def bands_of(self, texts: list[str | None], least_words: int = LEAST_WORDS) -> list[tuple[str, float, int] | None]:
        """Band, mean position and number of words of each text's prose; None for those without enough English prose."""
        out: list[tuple[str, float, int] | None] = [None] * len(texts)
        held: list[tuple[int, list[str]]] = []
        size = 0
        for k, text in enumerate(texts):
            if text and (found := prose.blocks(text)):
                held.append((k, found))
                size += sum(map(len, found))
            if held and (size >= CHARS or k == len(texts) - 1):
                self._place(held, least_words, out)
                held, size = [], 0
        if held:
            self._place(held, least_words, out)
        return out

    def _place(self, held: list[tuple[int, list[str]]], least_words: int, out: list) -> None:
        m = measure([b for _, found in held for b in found], self.common)
        doc = np.repeat(np.arange(len(held)), [len(found) for _, found in held])
        per = lambda w: np.bincount(doc, w, len(held))
        unlike = m.foreign > m.letters / 2
        n = np.where(unlike, m.letters / 5, m.words)  # scripts without spaces
        short, fits = m.letters < SHORT, self.english.scores(m) >= self.english.least
        english, other = fits & ~short & ~unlike, (~fits & ~short) | unlike
        mine = english | (short & ~unlike & (per(n * english) > per(n * other))[doc])  # too short to tell: as the rest
        total, own = per(m.plain), per(n * mine)
        at = np.clip(self.position(m.x), 0, len(self.bands) - 1)
        weight = np.bincount(doc * len(self.bands) + np.rint(at).astype(int), n * mine, len(held) * len(self.bands)).reshape(len(held), -1)
        mean = per(n * mine * at) / np.maximum(own, 1e-9)
        for d in np.flatnonzero((total >= least_words) & (own > per(n) / 2)):
            out[held[d][0]] = (self.bands[int(weight[d].argmax())], float(mean[d]), int(total[d]))

    def band(self, text: str | None, least_words: int = LEAST_WORDS) -> tuple[str, float, int] | None:
        return self.bands_of([text], least_words)[0]


def _pairs(y: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (harder, easier), or ``most`` of them drawn at random."""
    n = np.bincount(y)
    if (len(y) ** 2 - int((n.astype(np.int64) ** 2).sum())) // 2 <= most:
        return np.nonzero(y[:, None] > y[None, :])
    rng = np.random.default_rng(1)
    hard, easy = rng.integers(0, len(y), (2, 8 * most))
    good = np.flatnonzero(y[hard] > y[easy])[:most]
    return hard[good], easy[good]


def _parts(text: str) -> Iterator[str]:
    """Runs of whole sentences of about PART_WORDS words."""
    held: list[str] = []
    n = 0
    for block in prose.blocks(text):
        for s in prose.sentences(block):
            held.append(s)
            n += len(s.split())
            if n >= PART_WORDS:
                yield " ".join(held)
                held, n = [], 0
    if held and n >= PART_WORDS // 2:
        yield " ".join(held)


def learn(samples: DataFrame, bands: tuple[str, ...], key: str = "sample_id", band: str = "band", text: str = "text", most: int = MOST_SAMPLES) -> LevelModel:
    """The model of a table of graded passages."""
    place = F.row_number().over(W.partitionBy("b").orderBy(F.xxhash64("k", "t"), "k", "t"))
    some = samples.select(F.col(key).alias("k"), F.col(band).alias("b"), F.col(text).alias("t")).where(F.col("b").isin(*bands) & F.col("t").isNotNull())
    some = some.withColumn("n", place).where(F.col("n") <= max(1, most // len(bands))).orderBy("k", "b", "t")
    return LevelModel.learn([(r["b"], r["t"]) for r in some.collect()], bands)


def reading_levels(docs: DataFrame, model: LevelModel, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``(key, band, position, n_words)`` of every document with at least ``least_words`` words of prose, most of it English.

    ``band`` holds the larger part of the English prose, ``position`` is the prose's mean on the scale 0 (easiest) to
    the number of bands less 1. ``docs`` is a scan. Null, blank and other texts, and rows without key, give no row; a document given twice gives two.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.bands_of(batch["text"].to_pylist(), least_words)
            good = pa.array([f is not None for f in found], pa.bool_())
            kept = [f for f in found if f]
            yield pa.RecordBatch.from_arrays([batch["key"].filter(good), pa.array([f[0] for f in kept], pa.string()), pa.array([f[1] for f in kept], pa.float64()), pa.array([f[2] for f in kept], pa.int32())], ["key", "band", "position", "n_words"])

    held = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key is not null and text is not null")
    return spread(held).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, band string, position double, n_words int")
