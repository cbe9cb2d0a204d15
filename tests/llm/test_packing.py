from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import packing, tokens


@settings(max_examples=120, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plans_hold_every_item_once(counts):
    plan = packing.plan_containers(counts, 64, groups=6)
    held = Counter()
    for n, kind in plan.kinds:
        assert 0 < sum(s * m for s, m in kind.items()) <= 64
        for s, m in kind.items():
            held[s] += n * m
    assert held == Counter(counts)
    place = packing.Placement(plan)
    filled = defaultdict(int)
    for s, n in counts.items():
        for c in place(np.full(n, s), np.arange(n)):
            filled[int(c)] += s
    assert set(filled) == set(range(plan.containers)) and all(v <= 64 for v in filled.values())


def test_little_room_is_wasted():
    rng = np.random.default_rng(2)
    sizes = np.clip(rng.lognormal(6, 1, 30_000).astype(int), 1, 2048)
    assert packing.plan_containers(dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True)))), 2048).unused < 0.01
    # Thirds and halves that only fit exactly: 1000 pairs and 1000 triples.
    assert packing.plan_containers({32: 2000, 24: 1000, 20: 2000}, 64).containers == 2000
    with pytest.raises(ValueError):
        packing.plan_containers({65: 1}, 64)
    assert packing.plan_containers({}, 64).containers == 0


def test_documents_are_packed_as_full_as_by_best_fit_decreasing():
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].drop_null().to_pylist()
    counts: Counter[int] = Counter()
    for t in texts:
        n = tokens.count(t, tokens.default_vocabulary())
        counts[2048] += n // 2048
        counts[n % 2048] += 1
    counts = Counter({s: n for s, n in counts.items() if s and n})
    plain = packing.Plan(2048, packing._best_fit([], dict(counts), 2048))
    plan = packing.plan_containers(counts, 2048)
    least = -(-sum(s * n for s, n in counts.items()) // 2048)
    assert least <= plan.containers <= plain.containers and plan.unused < 0.004


def test_rows(spark):
    rng = random.Random(1)
    texts = [None, "", " ", "word " * 700] + [" ".join(["tree"] * rng.randrange(1, 60)) for _ in range(200)] + ["same text"] * 100
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, "lost", "x")], "doc_id long, text string, size string")
    got = packing.pack(df, capacity=64).collect()
    filled, seen = Counter(), Counter()
    for r in got:
        filled[r["container_id"]] += r["n_tokens"]
        seen[r["doc_id"]] += r["n_tokens"]
    want = {k: tokens.count(t, tokens.default_vocabulary()) for k, t in enumerate(texts) if t is not None}
    assert dict(seen) == want and max(filled.values()) <= 64
    assert [r["piece"] for r in sorted(got, key=lambda r: r["piece"]) if r["doc_id"] == 3] == list(range(-(-want[3] // 64)))
    assert Counter(r["doc_id"] for r in got if want[r["doc_id"]] <= 64).most_common(1)[0][1] == 1  # never split
    assert packing.pack(df.limit(0)).count() == 0
