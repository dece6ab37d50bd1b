"""The Jaccard join against all pairs, with both branches, hot groups and odd rows."""

import random
import re

import pytest

from folioforge.llm import jaccard as J

SCHEMA = "doc_id long, text string, n int, code string, n_shingles int"


def _set(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def _brute(rows, k, similarity):
    sets = [_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and similarity[1] * both >= similarity[0] * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return sorted((str(rows[i][0]), len(sets[i]), str(least[find(i)] if sets[i] else rows[i][0])) for i in range(len(rows)))


def _got(spark, rows, k, similarity, parts=3):
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA).repartition(parts)
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in J.similar_documents(docs, k, similarity).collect())


def _mutated(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at : at + 1] = rng.choice([[f"n{rng.random()}"], [], [words[at], f"m{rng.random()}"]])
    return " ".join(words)


def _rows():
    rng = random.Random(6)
    rows, i = [], 0
    for length in (4, 5, 8, 9, 12, 14, 15, 16, 20, 30, 60, 120, 300):
        for _ in range(3):
            base = [f"v{rng.randrange(400)}" for _ in range(length)]
            for edits in (0, 0, 0, 1, 1, 1, 2, 3, 4):
                rows.append((i, _mutated(rng, base, edits if edits < length else 0)))
                i += 1
    passage = " ".join(f"p{j}" for j in range(60))
    rows += [(1000 + j, f"{passage} " + " ".join(f"u{j}-{x}" for x in range(rng.randrange(3, 30)))) for j in range(60)]
    base = [f"hot{j}" for j in range(150)]
    rows += [(2000 + j, _mutated(rng, base, rng.randrange(0, 9))) for j in range(150)]
    return rows


@pytest.mark.parametrize(("k", "similarity"), [(4, (85, 100)), (5, (80, 100))])
def test_matches_all_pairs(spark, k, similarity):
    rows = _rows()
    assert _got(spark, rows, k, similarity) == _brute(rows, k, similarity)


def test_any_frequency_table_and_boundary_give_the_same(spark, monkeypatch):
    rows = _rows()
    monkeypatch.setattr(J, "REPEATS", 2)
    monkeypatch.setattr(J, "FREQUENT", 37)
    monkeypatch.setattr(J, "ENTRY_COST", 1000.0)
    assert _got(spark, rows, 4, (85, 100)) == _brute(rows, 4, (85, 100))


def test_rounds_compare_few_pairs_of_a_hot_group(spark):
    rng = random.Random(9)
    base = [f"hot{j}" for j in range(200)]
    rows = [(j, _mutated(rng, base, 2)) for j in range(300)]
    pairs = []
    compare = J._compare

    def counted(p, sets, similarity):
        pairs.append(p.count())
        return compare(p, sets, similarity)

    J._compare = counted
    try:
        got = _got(spark, rows, 4, (85, 100))
    finally:
        J._compare = compare
    assert got == _brute(rows, 4, (85, 100)) and sum(pairs) < 300 * 40


def test_boundary_follows_cost():
    assert J.boundary_of({}, (85, 100)) == 0
    assert J.boundary_of({4: 50, 400: 100}, (85, 100)) >= 4  # subsets of four are cheaper than list entries
    assert J.boundary_of({10: 50, 400: 100}, (85, 100)) == 0  # those of ten are not
    assert J.boundary_of({60: 10_000}, (85, 100)) < 60
    for s in range(1, 40):
        for t in range(s, 40):
            least = J.needed(s, t, (85, 100))
            assert all(J.linked(o, s, t, (85, 100)) == (o >= least) for o in range(s + 1))


def test_edges(spark):
    assert _got(spark, [], 4, (85, 100)) == []
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (9, "ONE"), (5, "one two"), (6, "one two three"), (7, "É é"), (8, "é é"), (10, "a b c d"), (10, "a b c d"), (11, "A  b\nc\td"), (None, "a b c d"), (None, "only here it is"), (12, "w " * 20000)]
    assert _got(spark, rows, 4, (85, 100)) == _brute(rows, 4, (85, 100))


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(500, 500), (600, 599)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.id: r.label for r in J.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if x != 500}


def test_one_of_each(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "x y z"), (3, "x y z"), (4, ""), (4, ""), (5, None), (6, "other words are here now"), (None, "a b c d e f")]
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA)
    out = J.one_of_each(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 3, 4, 4, 5, 6]
    assert J.one_of_each(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("parts", [1, 4])
def test_null_and_repeated_ids_link_nothing_by_themselves(spark, parts):
    rng = random.Random(3)
    base = [[f"{name}{j}" for j in range(60)] for name in "abcdef"]
    rows = [(5, " ".join(base[0])), (9, " ".join(base[1])), (None, _mutated(rng, base[0], 1)), (None, _mutated(rng, base[1], 1)), (None, " ".join(base[2]))]
    rows += [(7, " ".join(base[3])), (7, " ".join(base[4])), (8, _mutated(rng, base[4], 1)), (7, " ".join(base[3])), (3, _mutated(rng, base[3], 1))]
    rows += [(None, " ".join(base[5])), (None, " ".join(base[5])), (None, _mutated(rng, base[5], 1))]
    got = _got(spark, rows, 4, (85, 100), parts)
    assert got == _brute(rows, 4, (85, 100))
    assert ("9", 57, "9") in got and ("5", 57, "5") in got


@pytest.mark.parametrize("parts", [1, 4])
def test_one_of_each_drops_copies_only(spark, parts):
    text = lambda name, n=30: " ".join(f"{name}{j}" for j in range(n))
    rows = [(None, text("a")), (None, text("b")), (None, text("c")), (3, text("d")), (3, text("e")), (3, text("e")), (None, text("e")), (4, text("c")), (None, None), (None, "")]
    docs = spark.createDataFrame([(t, i, n) for n, (i, t) in enumerate(rows)], "Text string, DOC_ID long, n int").repartition(parts)
    out = J.one_of_each(docs)
    assert out.columns == ["Text", "DOC_ID", "n"]
    assert sorted((str(r.DOC_ID), str(r.Text)[:2]) for r in out.collect()) == sorted([("None", "a0"), ("None", "b0"), ("4", "c0"), ("3", "d0"), ("3", "e0"), ("None", "No"), ("None", "")])
