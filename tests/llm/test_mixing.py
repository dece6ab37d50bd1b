"""Mixing against its contract, on small tables worked out by hand or by brute force."""

import pytest

from folioforge.llm.mixing import mix, mixed_documents, pivot

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), -1) for i, t, s in rows], SCHEMA)


def _targets(sizes, weights=(5, 2, 1), cap=3.0):
    """Brute force: reshare the excess until none is above."""
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        above = {s for s in free if share[s] > cap * sizes[s] * (1 + 1e-12)}
        if not above:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in above}


def test_pivot_keeps_the_sum_and_rounds_all_but_one():
    p, held = pivot(list(range(1000)), [0.3] * 1000, 7)
    assert abs(p.sum() - 300) < 1e-6
    assert sum(0 < x < 1 for x in p) <= 1 and (held < 0 or 0 < p[held] < 1)


def test_pivot_is_unbiased():
    hits = [0.0] * 5
    for seed in range(4000):
        p, held = pivot([11, 12, 13, 14, 15], [0.2, 0.5, 0.9, 0.3, 0.1], seed)
        for i, x in enumerate(p):
            hits[i] += x
    assert [round(h / 4000, 1) for h in hits] == [0.2, 0.5, 0.9, 0.3, 0.1]


def test_targets_and_totals(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 40)), ("a", "b", "c", "d", None)[min(i % 9, 4)]) for i in range(900)]
    got = mix(_docs(spark, rows)).collect()
    assert len(got) == 900
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = _targets(sizes)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 * want[s] and r.source_size == sizes[s] for r in mine)
        assert all(r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= 45
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in mix(_docs(spark, rows).repartition(7)).collect())


def test_edges(spark):
    assert mix(_docs(spark, [])).count() == 0
    got = mix(_docs(spark, [(1, None, "a"), (2, "", None), (2, "", None), (None, "x y", "a"), (5, "x " * 30000, "b")])).collect()
    assert sorted(r.size for r in got) == [0, 0, 0, 2, 30000]
    assert all(r.taken == 0 for r in got if r.size == 0) and all(r.taken <= 3 * r.size for r in got)


@pytest.mark.parametrize("copies", [1, 3])
def test_mixed_documents_repeat_rows(spark, copies):
    rows = [(i, "one two three four", "a" if i % 2 else "b") for i in range(40)] * copies
    docs = _docs(spark, rows)
    plan, out = mix(docs).collect(), mixed_documents(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in plan)
