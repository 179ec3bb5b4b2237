import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from notelake.llm import vectors as V

DDL = "vec_id bigint, vault string, key string, embedding array<float>, id string, note int, q string"
DIM = 8


def made(seed, n, clusters, notes=40):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, DIM))
    x = centres[rng.integers(0, clusters, n)] + 0.15 * rng.normal(size=(n, DIM))
    return [(int(3 * k), "v", f"n{rng.integers(0, notes)}", [float(f) for f in row]) for k, row in enumerate(x.astype(np.float32))]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DDL)


def brute(rows, k, least=-2.0):
    good = [r for r in rows if r[0] is not None and r[3] and len(r[3]) == DIM and all(x is not None and np.isfinite(x) for x in r[3]) and any(r[3])]
    x = np.array([r[3] for r in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cos = x @ x.T
    out = {}
    for i, a in enumerate(good):
        near = sorted((-round(float(cos[i, j]), 5), b[0]) for j, b in enumerate(good) if b[1:3] != a[1:3])
        out[a[0]] = [(b, -c) for c, b in near[:k] if -c >= least]
    return out


def ask(spark, rows, **kw):
    df = V.most_similar(frame(spark, rows), ["vault", "key"], "vec_id", "embedding", dim=DIM, **{"k": 4, **kw})
    out = {}
    for r in df.orderBy("id_a", "rank").collect():
        out.setdefault(r["id_a"], []).append((r["id_b"], r["cosine"]))
    return out


@pytest.mark.parametrize("max_list", [40, V.MAX_LIST])
def test_recall(spark, monkeypatch, max_list):
    monkeypatch.setattr(V, "MAX_LIST", max_list)
    rows = made(1, 500, 25)
    want, got = brute(rows, 4), ask(spark, rows, pivots=32)
    hit = sum(len({b for b, _ in want[i]} & {b for b, _ in got.get(i, [])}) for i in want)
    assert hit >= 0.9 * sum(map(len, want.values()))
    assert all(len(x) <= 4 and len({b for b, _ in x}) == len(x) for x in got.values())
    cosines = {(i, b): c for i, x in brute(rows, 500).items() for b, c in x}
    assert all(abs(c - cosines[i, b]) < 1e-3 for i, x in got.items() for b, c in x)


def test_pairs_of_pivots(spark, monkeypatch):
    monkeypatch.setattr(V, "PAIRS_FROM", 10)
    rows = made(2, 400, 20)
    want, got = brute(rows, 4, 0.95), ask(spark, rows, pivots=32, min_cosine=0.95, data_lists=6)
    hit = sum(len({b for b, _ in want[i]} & {b for b, _ in got.get(i, [])}) for i in want)
    assert hit >= 0.9 * sum(map(len, want.values()))


def test_same_posting_at_any_size(spark, monkeypatch):
    """The rows are told to be many more than they are; all of them are pivots either way."""
    rows = made(6, 400, 20)
    df = frame(spark, rows)
    want = ask(spark, rows, pivots=10**8)
    monkeypatch.setattr(V, "MAX_PIVOTS", 10**8)
    real, told = type(df).count, []
    monkeypatch.setattr(type(df), "count", lambda self: real(self) if told else told.append(real(self)) or 10**8)
    assert ask(spark, rows, pivots=10**8) == want and told == [400]


def test_only_asked_rows(spark):
    rows = made(3, 200, 5)
    got = ask(spark, rows, queries=F.col("vec_id") % 50 == 0, query_lists=8, pivots=32)
    assert set(got) == {r[0] for r in rows if r[0] % 50 == 0}


def test_copies_of_a_third_of_all_rows(spark):
    rows = made(4, 120, 10) + [(10_000 + k, "v", f"c{k % 3}", [1.0] * DIM) for k in range(60)] + [(20_000, "v", "alone", [2.0] * DIM)]
    got = ask(spark, rows, k=5, pivots=32)
    for k in range(60):
        mine = k % 3
        others = [10_000 + j for j in range(60) if j % 3 != mine][:5]
        assert [b for b, _ in got[10_000 + k]] == others
    assert [b for b, _ in got[20_000]] == [10_000 + j for j in range(5)]


def test_dirty_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, "v", "a", [1.0] * DIM), (2, "v", "b", [1.0] * DIM), (3, "v", "c", None), (4, "v", "c", [1.0] * 3), (5, "v", "c", [nan] * DIM), (6, "v", "c", [0.0] * DIM), (7, "v", "c", [inf] + [1.0] * 7), (8, "v", "c", [None] + [1.0] * 7), (None, "v", "d", [1.0] * DIM), (9, None, None, [1e-30] * DIM), (10, "v", "a", [1e30] * DIM)]
    got = ask(spark, rows)
    assert {a: [b for b, _ in x] for a, x in got.items()} == {1: [2, 9], 2: [1, 9, 10], 9: [1, 2, 10], 10: [2, 9]}
    assert all(c == pytest.approx(1, abs=1e-4) for x in got.values() for _, c in x)
    assert ask(spark, rows[2:8]) == {} and ask(spark, rows[:1]) == {}


def test_found(spark, tmp_path, save):
    rng = np.random.default_rng(5)
    base = rng.normal(size=64)
    rows = [(k, "v", f"n{k}", [float(x) for x in (base + (0.05 * k) * rng.normal(size=64))]) for k in range(4)] + [(9, "v", "n0", [float(x) for x in base]), (10, "v", "z", [float(x) for x in rng.normal(size=64)])]
    folder = save(vectors=([(*r, "x", 1, "y") for r in rows], DDL))
    got = {tuple(r) for r in V.p1_found(spark, folder).collect()}
    assert got == {(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3), (1, 9), (2, 9), (3, 9)}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_recall_of_the_registered_query(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/vectors.parquet")
    rows = [tuple(r) for r in v.where(V.usable("embedding", 64)).select("vec_id", "vault", "key", "embedding").collect()]
    x = np.array([r[3] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = set()
    for i, a in enumerate(rows):
        if a[0] % 50 == 0:
            near = sorted((-c, b[0]) for c, b in zip(x[i] @ x.T, rows) if b[1:3] != a[1:3])
            want |= {(a[0], b) for _, b in near[:5]}
    got = {(r["id_a"], r["id_b"]) for r in V.p1_knn(spark, "/root/testdata/sf0.01").collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got) == len(want)
