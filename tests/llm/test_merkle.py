"""The Merkle manifest against a plain version, and the traversal against whole trees."""

import zlib
from hashlib import sha256

import pytest

from folioforge.llm import merkle as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos map<string,int>, Digest int"


def _docs(spark, rows):
    return spark.createDataFrame([(*r, "x", {"a": 1}, 2) for r in rows], SCHEMA)


def _h(x):
    return sha256("".join(x).encode()).hexdigest()


def _leaf(row, text):
    return _h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text))


def _tree(leaves):
    """The root, and the siblings (left, right) of each leaf, level by level."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([_h(levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    paths = []
    for i in range(len(leaves)):
        path = []
        for level in levels[:-1]:
            first = i // 8 * 8
            path.append((level[first:i], level[i + 1 : first + 8]))
            i //= 8
        paths.append(path)
    return levels[-1][0], paths


def _plain(rows):
    trees = {}
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, _leaf(r, r[4]))):
        trees.setdefault(r[2], []).append(r)
    names = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    found = {k: _tree([_leaf(r, r[4]) for r in trees[k]]) for k in names}
    root, upper = _tree([found[k][0] for k in names])
    out = []
    for k, top in zip(names, upper):
        subroot, paths = found[k]
        for r, path in zip(trees[k], paths):
            whole = path + top
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = _leaf(r, text)
            for left, right in whole:
                node = _h([*left, node, *right])
            out.append((r[0], _leaf(r, r[4]), subroot, root, _h(d for left, right in whole for d in (*left, *right)), node, node == root))
    return sorted(out, key=str)


def _got(df, levels=M.LEVELS):
    return sorted((tuple(r) for r in M.verified(M.manifest(df, levels=levels)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


@pytest.mark.parametrize("band", [1, 2, 3, 4])
@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 64, 65, 300, 513])
def test_traversal_gives_each_path(n, band):
    leaves = [_h([str(i)]) for i in range(n)]
    root, paths = _tree(leaves)
    height = M.height_of(n)
    assert M.root_of(leaves, height) == root
    assert list(M.traverse(leaves, height, band)) == [[("".join(a), "".join(b)) for a, b in p] for p in paths]


def _rows():
    rows = [(i * 7 % 1000, "s", "en", i, f"Text {i} É" if i % 5 else None) for i in range(150)]
    rows += [(i, None, None, None, "Only") for i in range(2000, 2009)] + [(3000, "s", "", 1, "A" * 100_000), (3001, "é", "zz", 1, "")]
    return rows


def test_matches_a_plain_version_in_one_block(spark):
    assert _got(_docs(spark, _rows())) == _plain(_rows())


@pytest.mark.parametrize("levels", [1, 2])
def test_matches_a_plain_version_over_many_blocks(spark, levels):
    many = _rows() + [(i, "s", f"l{i}", 1, "T") for i in range(5000, 5020)]
    assert _got(_docs(spark, many), levels) == _plain(many)


def test_repeated_rows_nulls_and_one_row(spark):
    rows = [(1, "s", "en", 3, "Abc"), (1, "s", "en", 3, "Abc"), (1, "s", "en", 3, "abd"), (None, "s", "en", 1, "x"), (None, None, None, None, None)]
    assert _got(_docs(spark, rows).repartition(3)) == _plain(rows)
    assert _got(_docs(spark, rows[:1])) == _plain(rows[:1])
    assert _got(_docs(spark, [])) == []


def test_only_changed_texts_fail(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    got = _got(docs)
    assert got == _plain(rows)
    assert {r[6] for r in got} == {True, False} and len({r[3] for r in got}) == 1
