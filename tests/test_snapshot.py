"""Snapshots, digests of files and vectors, anchors."""

import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from folioforge.functions.text import anchor
from folioforge.operators import snapshot as S

PROVENANCE = {"producer": "p", "model": "m", "dimension": 2}


def _tables(spark, papers, index):
    return spark.createDataFrame(papers, "item_key string, date_modified string, title string"), spark.createDataFrame(index, "item_key string, document string, embedding array<double>, date_modified string")


PAPERS = [("A1", "2020", "One"), ("B2", "2021", "Two")]
INDEX = [("A1", "one", [1.0, 2.0], "2020"), ("B2", "two", [0.0, -0.5], "2021")]


def test_snapshots_that_agree(spark):
    a = S.snapshot(*_tables(spark, PAPERS, INDEX), PROVENANCE, {"library": 1})
    b = S.snapshot(*[t.repartition(3) for t in _tables(spark, PAPERS[::-1], INDEX[::-1])], PROVENANCE, {"library": 1})
    assert a == b and a["metadata"]["counts"] == {"papers": 2, "embeddings": 2} and a["snapshot_id"].endswith(a["snapshot_hash"][7:23])
    other = S.snapshot(*_tables(spark, PAPERS, [INDEX[0], ("B2", "two", [0.0, 0.5], "2021")]), PROVENANCE, {"library": 1})
    assert other["snapshot_hash"] != a["snapshot_hash"] != S.snapshot(*_tables(spark, PAPERS, INDEX), PROVENANCE, {"library": 2})["snapshot_hash"]


@pytest.mark.parametrize(
    ("papers", "index", "says"),
    [([], INDEX, "no papers"), (PAPERS, INDEX[:1], "without vectors: B2"), (PAPERS[:1], INDEX, "without papers: B2"), (PAPERS, [INDEX[0], ("B2", "two", [0.0], "2021")], "unsound"), (PAPERS, [INDEX[0], ("B2", "two", [0.0, float("nan")], "2021")], "unsound"), (PAPERS, [INDEX[0], ("B2", "two", [0.0, 1.0], "1999")], "stale"), (PAPERS, [INDEX[0], ("B2", "two", [0.0, 1.0], " ")], "missing"), (PAPERS + PAPERS[:1], INDEX, "repeated")],
)
def test_snapshots_that_do_not(spark, papers, index, says):
    with pytest.raises(S.Drift, match=says):
        S.snapshot(*_tables(spark, papers, index), PROVENANCE, {})


def test_vector_hash(spark):
    got = spark.createDataFrame([([1.5, -2.0],), (None,)], "v array<float>").select(S.vector_hash(F.col("v")).alias("h")).collect()
    assert [r.h for r in got] == [hashlib.sha256(struct.pack("<2d", 1.5, -2.0)).hexdigest(), None]


def test_folders(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "d" / "b.txt").write_text("two")
    before = spark.createDataFrame(S.files(spark, f"file://{tmp_path}").collect(), "path string, size long, sha256 string")
    assert {(r.path, r.size, r.sha256) for r in before.collect()} == {("a.txt", 3, hashlib.sha256(b"one").hexdigest()), ("d/b.txt", 3, hashlib.sha256(b"two").hexdigest())}
    first = S.fingerprint(before)
    (tmp_path / "a.txt").write_text("1")
    (tmp_path / "c").write_text("new")
    after = S.files(spark, f"file://{tmp_path}")
    assert S.fingerprint(after) != first and {(r.path, r.change) for r in S.changed_files(before, after).collect()} == {("a.txt", "changed"), ("c", "added")}


def test_anchors(spark):
    def plain(text, from_start):
        text = text.strip()
        if len(text) < 80:
            return ""
        if from_start:
            at = text.find(" ", 40)
            return (text[:at] if 0 < at < 55 else text[:40]).strip()
        rest = text[:-40]
        at = rest.rfind(" ")
        return (text[at + 1 :] if at != -1 and len(rest) - at < 15 else text[-40:]).strip()

    texts = [" ".join(f"word{i * 7 % 13}" * (1 + i % n) for i in range(30)) for n in (1, 2, 5)] + ["short", " " + "x" * 200, "ab " * 60, "a" * 39 + " " + "b" * 30 + " " + "c" * 45]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", anchor(F.col("t"), True).alias("a"), anchor(F.col("t"), False).alias("b")).collect()
    assert [(r.a, r.b) for r in rows] == [(plain(r.t, True), plain(r.t, False)) for r in rows]
