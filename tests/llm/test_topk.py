"""Exact top-k against brute force, with lengths and angles that make each pruning rule work."""

import math

import numpy as np

from folioforge.llm import topk as T

SCHEMA = "vec_id long, embedding array<float>, label int, norm double"


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0.0) for i, v in rows], SCHEMA)


def _brute(rows, k=10, every=100):
    ints = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, asked = [], {}
    for i, v in ints:
        if i % every == 0:
            asked[i] = min(asked.get(i, v), v)
    for q, v in asked.items():
        found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ints if i != q and len(w) == len(v))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(T, "BUCKET", 60)
    monkeypatch.setattr(T, "BLOCK", 3)
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(6, 12))
    rows = [(i, [float(x) for x in (centers[i % 6] + 0.3 * rng.normal(size=12)) * rng.lognormal(0, 1)]) for i in range(900)]
    rows += [(900, [0.0] * 12), (901, [0.0] * 12), (1000, [-1.0] * 12), (1001, [1.0, 2.0]), (1100, [2.0, 1.0]), (1200, []), (1201, [])]
    got = sorted(tuple(r) for r in T.topk(_frame(spark, rows)).collect())
    assert got == _brute(rows)


def test_nulls_ties_repeats_and_empty(spark):
    assert T.topk(_frame(spark, [])).count() == 0
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (5, [0.5, 0.0]), (4, [0.5, 0.0]), (3, None), (2, [None, 1.0]), (1, [float("nan"), 1.0]), (7, [float("inf"), 0.0]), (5, [0.5, 0.0])]
    assert sorted(tuple(r) for r in T.topk(_frame(spark, rows), k=2).collect()) == [(0, 1, 4, 1024 * 512), (0, 2, 5, 1024 * 512)]


def test_each_rule_prunes():
    rng = np.random.default_rng(1)
    m = (rng.normal(size=(2000, 16)) * 100).astype(np.int64)
    m = m[np.argsort(-(m.astype(float) ** 2).sum(1), kind="stable")]
    ids = np.arange(2000)
    q = m[:3] + 5
    true = np.sort(m @ q.T, axis=0)[::-1][9]
    stats: dict = {}
    found = list(T.search_bucket(np.array([-1, -2, -3]), q, true.astype(float), ids, m, 10, stats))
    assert stats.get("by_coordinate") == 3
    for i, _, scores in found:
        assert list(scores) == sorted((m @ q[i]).tolist(), reverse=True)[:10]
    short = {}
    list(T.search_bucket(np.array([-1]), q[:1], np.array([1e12]), ids, m, 10, short))
    assert short == {"skipped": 1}


def test_length_prunes():
    rng = np.random.default_rng(2)
    m = (rng.normal(size=(500, 8)) * np.geomspace(2000, 2, 500)[:, None]).astype(np.int64)
    m = m[np.argsort(-(m.astype(float) ** 2).sum(1), kind="stable")]
    ids, q = np.arange(500), (rng.normal(size=(1, 8)) * 50).astype(np.int64)
    top = np.sqrt((q[0].astype(float) ** 2).sum()) * np.sqrt((m[0].astype(float) ** 2).sum())
    bound, stats = 0.2 * top, {}
    found = list(T.search_bucket(np.array([-1]), q, np.array([bound]), ids, m, 500, stats))
    scores = m @ q[0]
    assert stats == {"by_length": 1} and sorted(s for _, _, x in found for s in x.tolist()) == sorted(s for s in scores.tolist() if s >= bound)


def test_matrices_are_not_broadcast(spark):
    grp, m = "dim int, grp long, ids binary, m binary", "dim int, q_grp long, q_ids binary, q_m binary"
    buckets = spark.createDataFrame([(2, i, b"i", b"m") for i in range(3)], grp)
    blocks = spark.createDataFrame([(2, i, b"q", b"n") for i in range(2)], m)
    met = T._meet(buckets, blocks, 3, 2)
    assert len(met.collect()) == 6
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
