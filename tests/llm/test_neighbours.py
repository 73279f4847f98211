import numpy as np

from graphmere.llm import neighbours as N

SCHEMA = "chunk_id long, page_id string, ord int, embedding array<float>, p string, bucket int, id long"


def brute(rows, k, least):
    first = {}
    for r in sorted(rows, key=lambda r: r[0]):
        first.setdefault((r[1], r[2]), r)
    good = [r for r in first.values() if r[3] is not None and len(r[3]) == 64 and all(x is not None and np.isfinite(x) for x in r[3]) and any(r[3])]
    v = np.array([np.array(r[3], dtype=np.float32).astype(float) / np.linalg.norm(np.array(r[3], dtype=np.float32).astype(float)) for r in good])
    ids = [r[0] for r in good]
    s = v @ v.T
    out = {}
    for i, a in enumerate(ids):
        near = sorted(((-round(float(s[i, j]), 9), b) for j, b in enumerate(ids) if j != i and s[i, j] >= least))[:k]
        out[a] = [b for _, b in near]
    return out


def test_recall_and_dirty_rows(spark):
    rng = np.random.default_rng(5)
    rows, n = [], 0
    for c in range(150):
        centre = rng.standard_normal(64)
        for _ in range(rng.integers(1, 6)):
            v = centre + rng.standard_normal(64) * rng.uniform(0, 0.35)
            rows.append((n, f"p{c}", n, [float(x) for x in v * rng.uniform(0.1, 9)], "x", 1, 7))
            n += 1
    rows += [(n, "p0", 0, rows[5][3], "x", 1, 7), (n + 1, "q", 0, None, None, None, None), (n + 2, "q", 1, [1.0] * 63, None, None, None), (n + 3, "q", 2, [0.0] * 64, None, None, None)]
    rows += [(n + 4, "q", 3, [float("nan")] + [1.0] * 63, None, None, None), (n + 5, "q", 4, [float("inf")] + [1.0] * 63, None, None, None), (n + 6, "q", 5, [None] + [1.0] * 63, None, None, None), (n + 7, None, None, rows[0][3], None, None, None)]
    want = brute(rows, 10, 0.92)
    got = {}
    for r in N.most_similar(spark.createDataFrame(rows, SCHEMA)).orderBy("chunk_id", "rank").collect():
        got.setdefault(r["chunk_id"], []).append(r["neighbour"])
    pairs = {(a, b) for a, bs in want.items() for b in bs}
    found = {(a, b) for a, bs in got.items() for b in bs}
    assert len(found & pairs) >= 0.98 * len(pairs) and found <= pairs


def test_copies_do_not_pair_in_full(spark):
    v = [float(i % 5 - 2) for i in range(64)]
    rows = [(i, f"p{i}", 0, v, None, None, None) for i in range(300)]
    out = N.most_similar(spark.createDataFrame(rows, SCHEMA), k=4).collect()
    near = {}
    for r in out:
        near.setdefault(r["chunk_id"], set()).add(r["neighbour"])
    assert len(near) == 300 and near[0] == {1, 2, 3, 4} and near[2] == {0, 1, 3, 4} and near[299] == {0, 1, 2, 3}


def test_full_buckets_are_cut(spark, monkeypatch):
    monkeypatch.setattr(N, "FULL_BUCKET", 20)
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(64)
    rows = [(i, f"p{i}", 0, [float(x) for x in centre + rng.standard_normal(64) * 0.02], None, None, None) for i in range(200)]
    got = {r["chunk_id"] for r in N.most_similar(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) >= 196


def test_full_buckets_lose_no_pair(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centre = rng.standard_normal(64)
    v = centre + rng.standard_normal((160, 64)) * 0.24
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<float>")
    index = N.Index(functions=6)
    whole = {tuple(r) for r in N.candidate_pairs(df, index, 0.92).collect()}
    monkeypatch.setattr(N, "FULL_BUCKET", 10)
    cut = {tuple(r) for r in N.candidate_pairs(df, index, 0.92).collect()}
    s = v @ v.T
    near = {(i, j) for i in range(160) for j in range(i + 1, 160) if 0.92 <= s[i, j] <= 0.96}
    assert len(near) > 1000 and cut == whole and len(near & cut) >= 0.9 * len(near)


def test_recall_at_the_threshold_does_not_fall_with_size(spark):
    rng = np.random.default_rng(4)
    a, b = rng.standard_normal((2, 600, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.921 * a + np.sqrt(1 - 0.921**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(np.concatenate([a, b]))], "id long, v array<float>")
    for n, functions in ((180_000, 22), (1_800_000, 26), (10_000_000, 29)):
        index = N.Index.for_rows(n)
        assert index.functions == functions
        got = {tuple(r) for r in N.candidate_pairs(df, index, 0.92).collect()}
        assert sum((i, i + 600) in got for i in range(600)) >= 0.93 * 600, index


def test_empty(spark):
    assert N.most_similar(spark.createDataFrame([], SCHEMA)).count() == 0
