from __future__ import annotations

import numpy as np

from lodestone.llm import catalogue, vectors

SCHEMA = "id string, embedding array<float>, score double"


def near_copies(seed, groups, dim=64):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        centre = rng.normal(size=dim)
        for k in range(rng.integers(1, 5)):
            v = centre + rng.normal(size=dim) * rng.uniform(0.1, 0.45)
            rows.append((f"g{g}:{k}", (v * rng.uniform(0.1, 9)).astype(np.float32)))
    return rows


def brute(rows, k, least):
    ids = [i for i, _ in rows]
    m = np.array([v for _, v in rows], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    out = set()
    for a in range(len(ids)):
        s = m[a] @ m.T
        best = sorted((b for b in range(len(ids)) if b != a and s[b] >= least), key=lambda b: (-round(s[b], 9), ids[b]))[:k]
        out |= {(ids[a], ids[b]) for b in best}
    return out


def test_recall_against_brute_force(spark):
    rows = near_copies(5, 700)
    df = spark.createDataFrame([(i, v.tolist(), 1.0) for i, v in rows], SCHEMA)
    got = {(r["id"], r["similar_id"]) for r in vectors.similar_vectors(df, 5, 0.9).collect()}
    want = brute(rows, 5, 0.9)
    assert len(want) > 500 and not got - want and len(got & want) >= 0.99 * len(want)


def test_unusable_vectors_and_scaled_copies(spark):
    one = [1.0, 2.0] + [0.0] * 62
    rows = [("z", None, 0.0), ("y", [], 0.0), ("x", [0.0] * 64, 0.0), ("w", [1.0] * 32, 0.0), ("v", [float("nan")] * 64, 0.0), ("u", [1.0, None] + [0.0] * 62, 0.0), (None, one, 0.0)]
    rows += [("a", one, 0.0), ("b", [7 * x for x in one], 0.0), ("c", [-x for x in one], 0.0)]
    got = {(r["id"], r["similar_id"], r["score"], r["rank"]) for r in vectors.similar_vectors(spark.createDataFrame(rows, SCHEMA), 5, 0.9).collect()}
    assert got == {("a", "b", 1.0, 1), ("b", "a", 1.0, 1)}
    assert vectors.similar_vectors(spark.createDataFrame([], SCHEMA), 5, 0.9).count() == 0


def test_a_direction_that_a_third_of_all_rows_share(spark):
    rows = near_copies(6, 60)
    shared = rows[0][1]
    rows += [(f"copy{k:03}", shared * (1 + k % 3)) for k in range(80)]
    df = spark.createDataFrame([(i, v.tolist(), 1.0) for i, v in rows], SCHEMA)
    got = vectors.similar_vectors(df, 5, 0.9)
    assert {(r["id"], r["similar_id"]) for r in got.collect()} == brute(rows, 5, 0.9)
    pairs = vectors.unordered(got).collect()
    assert all(r["id_a"] < r["id_b"] for r in pairs) and len(pairs) < 6 * len(rows)


def test_every_vector_gets_its_neighbours_however_far_away(spark):
    rows = near_copies(9, 150)
    rng = np.random.default_rng(10)
    rows += [(f"far{k:03}", rng.normal(size=64).astype(np.float32)) for k in range(150)]
    rows += [(f"copy{k}", rows[0][1] * 2 ** (k % 3)) for k in range(7)] + [(f"twin{k}", rows[-1][1] * 2 ** (k + 1)) for k in range(2)]
    df = spark.createDataFrame([(i, v.tolist(), 1.0) for i, v in rows] + [("zero", [0.0] * 64, 0.0), ("none", None, 0.0), ("short", [1.0], 0.0)], SCHEMA)
    for block in (1 << 17, 100):  # in one round and in several
        got = vectors.most_similar(df, 5, block=block).collect()
        assert len(got) == 5 * len(rows) and {(r["id"], r["rank"]) for r in got} == {(i, k) for i, _ in rows for k in range(1, 6)}
        assert {(r["id"], r["similar_id"]) for r in got} == brute(rows, 5, -1.0)
    few = spark.createDataFrame([("a", [1.0] + [0.0] * 63, 0.0), ("b", [-1.0] + [0.0] * 63, 0.0)], SCHEMA)
    assert {(r["id"], r["similar_id"], r["score"]) for r in vectors.most_similar(few, 5).collect()} == {("a", "b", -1.0), ("b", "a", -1.0)}
    assert vectors.most_similar(spark.createDataFrame([], SCHEMA), 5).count() == 0


def test_the_query_has_no_least_similarity(spark, tmp_path):
    rng = np.random.default_rng(11)
    rows = [(f"n:{k}", rng.normal(size=64).astype(np.float32).tolist(), 1.0) for k in range(40)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("id", "embedding", "timestamp'2024-01-01' AS ingested_at")
    df.write.parquet(f"{tmp_path}/chunks.parquet")
    assert catalogue.p1_similar(spark, str(tmp_path)).count() == 200


def test_transform_keeps_lengths_and_more_digits_are_used_for_more_rows():
    x = np.random.default_rng(0).normal(size=(64, 10)).astype(np.float32)
    assert np.allclose(np.linalg.norm(vectors.hadamard(x), axis=0), np.linalg.norm(x, axis=0), rtol=1e-4)
    assert [vectors.digits_for(n, 64) for n in (10, 100_000, 2_000_000, 3_000_000, 10**9)] == [2, 2, 2, 3, 4]


def test_tables_keep_the_recall_at_more_digits():
    rng = np.random.default_rng(12)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1, keepdims=True)
    for digits in (3, 4):
        tables = vectors.tables_for(digits, 64, 0.9, 3)
        x, y = (vectors.signer(64, tables, 3, digits)(v.astype(np.float32))[0].reshape(2000, tables, 3) for v in (a, b))
        hit = ((x[:, :, :1] == y) | (y[:, :, :1] == x)).any((1, 2))
        assert hit.mean() >= 0.985


def test_many_digits_still_find(spark):
    sign = vectors.signer(64, 12, 3, 3)
    rows = near_copies(8, 300)
    m = np.array([v for _, v in rows], np.float32)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    keys, _ = sign(m)
    stored = keys[:, ::3]
    close = np.argwhere(np.triu(m @ m.T >= 0.9, 1))
    hit = [any(set(keys[a, 3 * t : 3 * t + 3]) & {stored[b, t]} or set(keys[b, 3 * t : 3 * t + 3]) & {stored[a, t]} for t in range(12)) for a, b in close]
    assert np.mean(hit) > 0.95
