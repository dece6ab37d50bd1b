"""Product codes against a plain version, and kd-trees against every distance."""

import hashlib
import math

import numpy as np
import pytest

from folioforge.llm import codes as C

SCHEMA = "vec_id long, embedding array<float>, label int, v string, code map<string,int>, Label string"


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, g, "x", {"a": 1}, "y") for i, v, g in rows], SCHEMA)


def _plain(rows, rounds=2):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for dim in {len(v) for _, v, _ in kept}:
        mine = sorted(((i, v, g) for i, v, g in kept if len(v) == dim), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        cut = [i * dim // 16 for i in range(17)]
        books = [[v[a:b] for _, v, _ in mine[:64]] for a, b in zip(cut, cut[1:])]

        def nearest(part, p):
            return min((sum((x - y) ** 2 for x, y in zip(p, e)), n) for n, e in enumerate(books[part]))

        for _ in range(rounds):
            members = [{} for _ in books]
            for _, v, _ in mine:
                for part in range(16):
                    p = v[cut[part] : cut[part + 1]]
                    members[part].setdefault(nearest(part, p)[1], []).append(p)
            books = [[[sum(x) // len(x) for x in zip(*got[n])] if n in got else e for n, e in enumerate(book)] for book, got in zip(books, members)]
        sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
        for i, v, g in mine:
            found = [nearest(part, v[cut[part] : cut[part + 1]]) for part in range(16)]
            out.append((i, "".join(f"{n:02x}" for _, n in found), sum(d for d, _ in found), g, sha))
    sums = {}
    for _, _, e, g, _ in out:
        sums[g] = sums.get(g, 0) + e
    return sorted(((i, c, e, sums[g], s) for i, c, e, g, s in out), key=str)


def _got(spark, rows):
    found, _ = C.compress(_frame(spark, rows))
    return sorted((tuple(r) for r in found.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


@pytest.mark.parametrize("width, spread", [(1, 3), (4, 2), (4, 300), (9, 5)])
def test_tree_finds_the_lowest_of_the_nearest(width, spread):
    rng = np.random.default_rng(width * spread)
    entries, points = rng.integers(-spread, spread + 1, (64, width)), rng.integers(-spread - 2, spread + 3, (3000, width))
    d = ((points[:, None] - entries[None]) ** 2).sum(2)
    index, best = C.KdTree(entries).nearest(points)
    assert (index == d.argmin(1)).all() and (best == d.min(1)).all()  # argmin gives the first
    if spread < 5:
        assert (np.sort(d, 1)[:, 0] == np.sort(d, 1)[:, 1]).any()  # there are ties


def test_matches_a_plain_version(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=32) * 0.1], [None, 1, 2][i % 3]) for i in rng.permutation(300)]
    rows += [(1000 + i, [0.25] * 32, 1) for i in range(200)]  # ties, and a hot vector
    assert _got(spark, rows) == _plain(rows)


def test_defined_cases(spark):
    assert _got(spark, []) == []
    rows = [(1, [0.5] * 16, 1), (1, [-0.5] * 16, None), (2, None, 1), (3, [None] + [1.0] * 15, 1), (4, [float("nan")] * 16, 1), (5, [float("inf")] * 16, 1), (None, [0.1] * 16, None), (6, [0.3] * 20, 1), (7, [-0.0039] * 20, 9), (8, [], 2)]
    assert _got(spark, rows) == _plain(rows)
    with pytest.raises(Exception, match="scaled components lie within"):
        _got(spark, [(1, [1e9] * 16, 1)])


def test_codes_stand_for_entries(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=16)], 1) for i in range(100)]
    coded, books = C.compress(_frame(spark, rows))
    ints = {i: np.floor(256 * np.float32(v).astype(float)) for i, v, _ in rows}
    errors = {r.vec_id: r.error for r in coded.collect()}
    for r in C.reconstructed(coded, books, 16).collect():
        assert ((ints[r.vec_id] - np.array(r.approx)) ** 2).sum() == errors[r.vec_id]


def test_whole_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    assert _got(spark, rows) == _plain(rows)
