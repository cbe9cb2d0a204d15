from __future__ import annotations

import random
import re

import pytest

from lodestone.llm import contamination as C

DOC, ITEM = "doc_id long, text string, item_id string", "item_id long, text string, answer string"


def words(text):
    return re.findall("[a-z0-9]+", re.sub(f"[{C.INVISIBLE}]", "", text or "").lower())


def brute(docs, items, n=12):
    grams = lambda t: {tuple(words(t)[k : k + n]) for k in range(len(words(t)) - n + 1)}
    held = {i: grams(t) for i, t in items if i is not None}
    return {(d, i) for d, t in docs if d is not None for i, g in held.items() if g & grams(t)}


@pytest.fixture(scope="module")
def case():
    rng = random.Random(4)
    some = lambda n: " ".join(rng.choice(["red", "box", "of", "the", "sea", "and", "lamp", "tree", "river", "stone"]) for _ in range(n))
    items = [(k, some(rng.randrange(5, 60))) for k in range(40)]
    items += [(100, items[0][1] + " more"), (101, None), (102, ""), (None, some(20)), (3, items[3][1])]
    docs = [(k, some(rng.randrange(3, 200))) for k in range(60)]
    for k in range(60, 120):
        w = rng.choice([t for _, t in items if t]).split()
        a = rng.randrange(max(1, len(w) - 12))
        part = w[a : a + rng.randrange(10, 30)]
        docs.append((k, f"{some(9)}. {'-- '.join(part).upper().replace('A', chr(0x200B) + 'A')}; {some(5)}"))
    return docs + [(900, None), (901, ""), (None, items[0][1])], items


def test_against_brute_force(spark, case, monkeypatch):
    docs, items = case
    d, i = spark.createDataFrame([(*x, "z") for x in docs], DOC), spark.createDataFrame([(*x, "z") for x in items], ITEM)
    want = brute(docs, items)
    spans = C.leaked_spans(d, i).collect()
    assert len(want) > 30 and {(r["doc_id"], r["item_id"]) for r in spans} == want
    text = dict(docs)
    for r in spans:
        assert r["last_word"] - r["first_word"] >= 11
        assert " ".join(words(text[r["doc_id"]])[r["first_word"] : r["first_word"] + 12]) in " ".join(words(dict(items)[r["item_id"]]))
    monkeypatch.setattr(C, "BLOCK_CHARS", 500)  # several blocks of items give the same
    assert sorted(map(tuple, C.leaked_spans(d, i).collect())) == sorted(map(tuple, spans))


@pytest.mark.parametrize("chars", [C.BLOCK_CHARS, 500])  # one block of items, several
def test_cleaning(spark, case, monkeypatch, chars):
    monkeypatch.setattr(C, "BLOCK_CHARS", chars)
    docs, items = case
    d, i = spark.createDataFrame([(*x, "z") for x in docs], DOC), spark.createDataFrame([(*x, "z") for x in items], ITEM)
    rows = C.without_leaks(d, i, most=0.7).collect()
    assert {r["doc_id"] for r in rows} == {a for a, _ in brute(docs, items)}
    for r in rows:
        assert r["n_words"] == len(words(dict(docs)[r["doc_id"]]))
        assert (r["text"] is None) == (r["n_leaked"] > 0.7 * r["n_words"])
        if r["text"] is not None:
            assert len(words(r["text"])) == r["n_words"] - r["n_leaked"]
    assert C.without_words("One İ two, three four.", [(3, 3)]) == "One İ two,  four."


def test_empty(spark):
    d, i = spark.createDataFrame([], DOC), spark.createDataFrame([], ITEM)
    assert C.leaked_spans(d, i).count() == 0
