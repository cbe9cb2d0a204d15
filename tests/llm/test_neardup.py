from __future__ import annotations

import random
import re

import numpy as np

from lodestone.llm import neardup
from lodestone.llm.shingles import overlaps, shingle_sets

SCHEMA = "id string, note_slug string, text string, score double"
WORDS = [f"w{k}" for k in range(400)]


def sets(text, size=3):
    w = re.findall("[a-z0-9]+", (text or "").lower())
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}


def brute(rows, least, owners=True):
    out = set()
    s = [(i, o, sets(t)) for i, o, t, _ in rows]
    for x in range(len(s)):
        for y in range(len(s)):
            (a, oa, sa), (b, ob, sb) = s[x], s[y]
            if a < b and sa and sb and (not owners or oa != ob) and len(sa & sb) / len(sa | sb) >= least:
                out.add((a, b))
    return out


def corpus(seed, n=250):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        words = ["on", "the", "second", "day", "we"] + [rng.choice(WORDS) for _ in range(rng.randrange(20, 120))]
        rows.append((f"n{k % 40}:{k}", f"n{k % 40}", " ".join(words), 0.0))
        if rng.random() < 0.5:
            for _ in range(rng.randrange(1, 10)):
                p = rng.randrange(len(words))
                words[p : p + rng.randrange(2)] = [rng.choice(WORDS)] * rng.randrange(2)
            rows.append((f"c{k}", f"m{k}", (", ".join(words)).upper(), 0.0))
    return rows


def test_against_brute_force(spark):
    rows = corpus(1) + corpus(2)[:100]
    rows = list({r[0]: r for r in rows}.values())
    want = brute(rows, 0.6)
    got = {tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), size=3, similarity=0.6, owner_col="note_slug").collect()}
    assert len(want) > 100 and not got - want and len(got) >= 0.98 * len(want)


def test_nulls_short_and_blank_texts(spark):
    rows = [("a", "x", None, 0.0), ("b", "y", "", 0.0), ("c", "z", "two words", 0.0), ("d", "w", "two words", 0.0), (None, "v", "one two three", 0.0), ("e", None, "one two three", 0.0), ("f", "u", "One, two: three!", 0.0), ("g", None, "one two three", 0.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in neardup.near_duplicates(df, size=3, similarity=0.6, owner_col="note_slug").collect()}
    assert got == {("e", "f"), ("f", "g")}  # without owner they are of one owner
    assert {tuple(r) for r in neardup.near_duplicates(df, size=3, similarity=0.6).collect()} == {("e", "f"), ("e", "g"), ("f", "g")}
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA), size=3, similarity=0.6).count() == 0


def test_copies_of_a_third_of_all_rows(spark):
    rows = corpus(3, 60)
    many = [(f"copy{k:03}", f"o{k}", rows[0][2], 0.0) for k in range(70)]
    df = spark.createDataFrame(rows + many, SCHEMA)
    written = {tuple(r) for r in neardup.near_duplicates(df, size=3, similarity=0.6, owner_col="note_slug", write_out=100).collect()}
    assert written == brute(rows + many, 0.6)
    starred = {tuple(r) for r in neardup.near_duplicates(df, size=3, similarity=0.6, owner_col="note_slug").collect()}
    assert starred < written and {("copy000", f"copy{k:03}") for k in range(1, 70)} <= starred
    groups = {r["id"]: r["group_id"] for r in neardup.near_duplicate_groups(df, size=3, similarity=0.6).collect()}
    assert len(groups) == len(rows + many) and len({groups[m[0]] for m in many} | {groups[rows[0][0]]}) == 1
    linked = brute(rows + many, 0.6, owners=False)
    assert all(groups[a] == groups[b] for a, b in linked) and all(g <= i for i, g in groups.items())


def test_representative_and_variant_in_one_note(spark):
    words = [f"v{k}" for k in range(60)]
    text, variant = " ".join(words), " ".join([*words[:59], "other"])
    rows = [(f"a{k:03}", "hot", text, 0.0) for k in range(40)] + [(f"b{k:03}", f"o{k}", text, 0.0) for k in range(40)]
    rows += [("v", "hot", variant, 0.0), ("w0", "hot", variant + " more", 0.0), ("w1", "o1", variant + " more", 0.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    options = {"size": 3, "similarity": 0.6, "owner_col": "note_slug"}
    want = brute(rows, 0.6)
    assert {tuple(r) for r in neardup.near_duplicates(df, write_out=None, **options).collect()} == want
    starred = {tuple(r) for r in neardup.near_duplicates(df, **options).collect()}
    copies = {r[0] for r in rows[:80]}
    assert starred < want and {p for p in want if not set(p) <= copies} <= starred
    assert {x for p in starred if set(p) <= copies for x in p} == copies  # each has a link to another note


def test_two_hundred_copies_of_three_owners_in_two_near_classes(spark):
    words = [f"v{k}" for k in range(60)]
    rows = [(f"a{k:03}", f"o{k % 3}", " ".join(words), 0.0) for k in range(200)] + [(f"b{k:03}", f"o{k % 3}", " ".join([*words, "end"]), 0.0) for k in range(200)]
    got = [tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), write_out=None, size=3, similarity=0.6, owner_col="note_slug").collect()]
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] != b[1]}
    assert len(got) == len(want) and set(got) == want


def test_slots_grow_with_the_rows_and_shared_slots_show_frequent_keys(spark):
    assert [neardup.slots_for(n) for n in (0, 10**6, 1_500_000, 10**7, 10**10)] == [1 << 16, 1 << 16, 1 << 17, 1 << 20, 1 << 21]
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 62, (4000, 1))
    keys[:300] = 5
    df = spark.createDataFrame([([int(k[0])], [0]) for k in keys], "keys array<long>, fourth array<int>")
    loose, _ = neardup._counts(df, 1, 64)
    n = neardup._COUNTS[loose]
    assert n.argmax() == 5 and 250 < n[5] < 400 and np.median(n) <= 20


def test_large_classes_are_joined_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SPREAD", 7)
    words = [f"v{k}" for k in range(60)]
    rows = [(f"a{k:03}", f"o{k % 9}", " ".join(words), 0.0) for k in range(30)] + [(f"b{k:03}", f"o{k % 5}", " ".join([*words, "end"]), 0.0) for k in range(20)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), write_out=None, size=3, similarity=0.6, owner_col="note_slug").collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == brute(rows, 0.6)


def test_links_count_records(spark):
    words = [f"v{k}" for k in range(60)]
    rows = [(f"a{k}", f"o{k}", " ".join(words), 0.0) for k in range(50)] + [("v", "p", " ".join([*words, "end"]), 0.0), ("x", "q", "quite another text", 0.0)]
    got = {r["id"]: r["n_links"] for r in neardup.near_duplicate_groups(spark.createDataFrame(rows, SCHEMA), size=3, similarity=0.6).collect()}
    assert got == {f"a{k}": 1 for k in range(50)} | {"v": 50, "x": 0}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200) if k != 99] + [(500, 501), (7, 7)], "a long, b long")
    got = {r["id"]: r["root"] for r in neardup.components(edges).collect()}
    assert got == {k: 0 if k < 100 else 100 for k in range(201)} | {500: 500, 501: 500}


def test_allocation_keeps_the_chance_to_miss_and_takes_cheap_thresholds():
    rng = np.random.default_rng(0)
    loose = rng.integers(0, 1000, (50, 30)).astype(np.float32)
    strict = loose / 10
    how = neardup.allocate(loose, strict, 0.6, 0.002)
    miss = np.where(how == neardup.LOOSE, 1 - 0.6**3, np.where(how == neardup.STRICT, 1 - 0.6**4, 1.0)).prod(1)
    cost = np.where(how == neardup.LOOSE, loose, np.where(how == neardup.STRICT, strict, 0)).sum(1)
    assert (miss <= 0.0021).all() and (cost < loose.sum(1)).all() and len(np.unique(how)) == 3
    assert (neardup.allocate(np.zeros((3, 30), np.float32), np.zeros((3, 30), np.float32), 0.6, 0.002) == neardup.LOOSE).all()


def test_shingles():
    code, bounds = shingle_sets(["a b c d a b c", None, "", "x y", "C, D! A\nb c"], 3)
    assert np.diff(bounds).tolist() == [4, 0, 0, 0, 3]
    assert overlaps(code[: bounds[1]], code[bounds[4] :]) == 3
    assert shingle_sets([], 3)[1].tolist() == [0] and shingle_sets(["a"], 3)[1].tolist() == [0, 0]
