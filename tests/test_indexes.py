"""Kept indexes: vectors in lists, postings in segments, layers over ranges, hash trees."""

import numpy as np
import pytest

from folioforge.operators import retrieval
from folioforge.sources import hashtree, layers, manifests
from folioforge.sources.layers import LayeredIndex
from folioforge.sources.postings import Postings, SegmentedPostings
from folioforge.sources.vectors import VectorIndex, probes_for, recall

# --------------------------------------------------------------------------- vectors


def _clusters(n, seed=1, width=8):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, width)) * 6
    return [(i, [float(x) for x in centers[i % 12] + rng.normal(size=width)]) for i in range(n)]


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_exact_search_equals_a_full_scan(spark, tmp_path, metric):
    rows = spark.createDataFrame(_clusters(600), "item_key long, embedding array<double>").withColumn("odd", retrieval.F.col("item_key") % 2 == 1)
    index = VectorIndex.build(rows.filter("item_key < 500"), f"file://{tmp_path}/v", metric)
    index.add(rows.filter("item_key >= 500"))
    assert index.count() == 600 and index.rows().select("item_key").distinct().count() == 600
    asked = rows.filter("item_key % 60 = 0").selectExpr("item_key as query_id", "embedding as qv")
    for where in (None, retrieval.F.col("odd")):
        got, want = index.search(asked, 7, probes=1, exact=True, where=where), retrieval.dense_topk(rows, asked, 7, metric, where)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    few = recall(index.search(asked, 5), retrieval.dense_topk(rows, asked, 5, metric)).first()
    assert few["recall"] >= 0.95 and index.manifest()["probes"] < index.manifest()["lists"] / 2


def test_refused_vectors_and_small_indexes(spark, tmp_path):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "item_key string, embedding array<double>")
    index = VectorIndex.build(rows, f"file://{tmp_path}/v")
    for bad in ([None], [[1.0]], [[float("nan"), 1.0]]):
        with pytest.raises(ValueError, match="1 vectors are null"):
            index.add(spark.createDataFrame([("c", bad[0])], "item_key string, embedding array<double>"))
    asked = spark.createDataFrame([(1, [1.0, 0.1])], "query_id long, qv array<double>")
    assert [r.item_key for r in index.search(asked, 5, exact=True).orderBy("rank").collect()] == ["a", "b"]
    empty = VectorIndex.build(rows.limit(0), f"file://{tmp_path}/none")
    assert empty.search(asked, 5, exact=True).count() == 0
    rng = np.random.default_rng(0)
    flat = rng.normal(size=(400, 32))
    assert probes_for(flat, flat[:20]) > 10  # no clusters: most lists


# --------------------------------------------------------------------------- postings


def _docs(spark, rows):
    return spark.createDataFrame(rows, "item_key long, title string, document string")


def _scores(found):
    return {(r.query_id, r.item_key): r.exact for r in found.collect()}


def test_segments_score_as_one_index(spark, tmp_path):
    rng = np.random.default_rng(5)
    words = "red fox dog cat sun moon tree house river stone".split()
    text = lambda n: " ".join(rng.choice(words, n, p=[0.3, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05, 0.05, 0.03, 0.02]))
    rows = {i: (i, text(3), text(int(rng.integers(0, 40)))) for i in range(60)}
    asked = spark.createDataFrame([(1, "red fox"), (2, "stone"), (3, "absent"), (4, "river moon cat")], "query_id long, text string")
    index = SegmentedPostings(spark, f"file://{tmp_path}/seg")

    def check():
        want = retrieval.bm25(None, asked, postings=Postings.of(_docs(spark, list(rows.values())), f"file://{tmp_path}/whole"))
        got, want = _scores(retrieval.bm25(None, asked, postings=index.open())), _scores(want)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)

    index.add(_docs(spark, [rows[i] for i in range(30)]), merge=False)
    index.add(_docs(spark, [rows[i] for i in range(30, 60)]), merge=False)
    check()
    for i in (3, 40, 70):
        rows[i] = (i, "stone river", text(9))
    version = index.upsert(_docs(spark, [rows[i] for i in (3, 40, 70)]), merge=False)
    check()
    added = index.manifest()["segments"][-1]
    assert added["n"] == 3 and index.manifest()["segments"][0]["n"] == 29  # what was added is all that was written
    index.remove(_docs(spark, [rows.pop(i) for i in (3, 5, 31)]))
    check()
    assert index.open(version).documents == 61 and index.open().documents == 58
    index.merge()
    check()
    assert len(index.manifest()["segments"]) == 1 and index.manifest()["gone"] == []
    assert {r.item_key for r in index.open().titles().collect()} == set(rows)


def test_segments_of_one_size_are_merged(spark, tmp_path):
    index = SegmentedPostings(spark, f"file://{tmp_path}/seg")
    for i in range(4):
        index.add(_docs(spark, [(i, "t", f"word{i} all")]))
    assert [s["n"] for s in index.manifest()["segments"]] == [4] and index.open().frequencies(["all", "word2", "none"]) == {"all": 4, "word2": 1}


def test_a_segment_has_a_row_a_term_and_batch(spark, tmp_path):
    """Words that every text holds are one row of a batch, not a row a text; removals still reach single texts, before and after a merge."""
    index = SegmentedPostings(spark, f"file://{tmp_path}/seg")
    for first in (0, 300):
        index.add(_docs(spark, [(i, "head é", f"all of it all {'odd' if i % 2 else 'even'}") for i in range(first, first + 300)]).coalesce(1))
    at = index.open()
    stored = [spark.read.parquet(f"{index.folder}/{s['path']}/postings").filter("t = 'all'").count() for s in at.manifest["segments"]]
    assert stored == [1, 1] and at.frequencies(["all", "odd", "e"]) == {"all": 600, "odd": 300, "e": 600}
    index.remove(spark.createDataFrame([(i,) for i in range(0, 600, 3)], "item_key long"))
    for _ in range(2):
        rows = {(r.item_key, r.ft, r.fd, r.l) for r in index.open().of_terms(["all"]).collect()}
        assert rows == {(i, 0, 2, 7) for i in range(600) if i % 3} and index.open().frequencies(["even"]) == {"even": 200}
        index.merge()


# --------------------------------------------------------------------------- layers


def _rows(spark, rows):
    return spark.createDataFrame(rows, "item_key long, document string")


def _read(index, **span):
    return {r.item_key: r.document for r in index.read(**span).collect()}


def test_changes_are_merged_as_they_are_read(spark, tmp_path):
    index = LayeredIndex(spark, f"file://{tmp_path}/l", per_range=10)
    index.publish(_rows(spark, [(i, f"d{i}") for i in range(0, 80, 2)]))
    want = {i: f"d{i}" for i in range(0, 80, 2)}
    before = {r["path"] for r in index.manifest()["ranges"]}
    index.upsert(_rows(spark, [(4, "new"), (5, "odd"), (200, "far")]))
    want |= {4: "new", 5: "odd", 200: "far"}
    assert {r["path"] for r in index.manifest()["ranges"]} == before and index.manifest()["changes"][0]["rows"] == 3
    first = index.version()
    index.delete(_rows(spark, [(4, ""), (6, ""), (7, "")]))
    assert _read(index) == {k: v for k, v in want.items() if k not in (4, 6)}
    index.insert(_rows(spark, [(4, "again"), (8, "not this")]))
    want = {k: v for k, v in want.items() if k != 6} | {4: "again"}
    assert _read(index) == want and _read(index, version=first)[4] == "new" and index.count() == len(want)
    assert _read(index, lo=4, hi=9) == {k: v for k, v in want.items() if 4 <= k <= 9}
    assert {r.item_key for r in index.get([5, 200, 999]).collect()} == {5, 200}
    touched = {r["range"]: r["path"] for r in index.manifest()["ranges"]}
    index.compact()
    assert _read(index) == want and index.manifest()["changes"] == []
    after = [r["path"] for r in index.manifest()["ranges"]]
    assert sum(p in set(touched.values()) for p in after) == len(after) - 2  # only the first range and the last were written anew
    index.upsert(_rows(spark, [(1, "one")]).withColumn("extra", retrieval.F.lit(7)))
    assert {r.item_key: r.extra for r in index.read().collect()}[1] == 7 and index.read().filter("extra is null").count() == len(want)
    assert index.sweep(keep=1) > 0 and _read(index) == want | {1: "one"}


def test_compaction_starts_by_itself_and_conflicts_are_told(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(layers, "MOST_CHANGES", 2)
    index = LayeredIndex(spark, f"file://{tmp_path}/l")
    for i in range(4):
        index.upsert(_rows(spark, [(i, "x"), (i + 100, "y")]))
    assert sorted(_read(index)) == [0, 1, 2, 3, 100, 101, 102, 103] and len(index.manifest()["changes"]) <= 1
    with pytest.raises(ValueError, match="repeated"):
        index.upsert(_rows(spark, [(1, "a"), (1, "b")]))
    with pytest.raises(manifests.Conflict):
        index._seal(index.version(), {})
    checked = LayeredIndex(spark, f"file://{tmp_path}/c", check=lambda rows: retrieval.F.when(retrieval.F.col("document").isNull(), "a document is missing"))
    with pytest.raises(ValueError, match="a document is missing"):
        checked.upsert(_rows(spark, [(1, None)]))
    assert checked.version() == 0
    named = LayeredIndex(spark, f"file://{tmp_path}/s", per_range=2)
    named.publish(spark.createDataFrame([(k, "v") for k in ("é", "a", "z", "B")], "item_key string, document string"))
    named.delete(spark.createDataFrame([("a",)], "item_key string"))
    assert sorted(_read(named)) == ["B", "z", "é"] and sorted(_read(named, lo="b")) == ["z", "é"]


# --------------------------------------------------------------------------- hash trees


def test_changed_keys_are_found_from_the_root(spark):
    rows = [(i, f"t{i}", None if i % 3 else "s") for i in range(3000)]
    a = spark.createDataFrame(rows, "k long, text string, source string")
    other = [(i, t, "x" if i == 7 else s) for i, t, s in rows if i != 11] + [(9999, "n", None), (None, "null key", None)]
    b = spark.createDataFrame(other, a.schema)
    one, two = hashtree.HashTree(a, "k", ["text", "source"]), hashtree.HashTree(b.repartition(7), "k", ["text", "source"], 2)
    assert one.depth == 2 and one.root()[1] == 3000
    assert sorted(((r.key, r.change) for r in hashtree.changed_keys(one, two).collect()), key=str) == sorted([(7, "changed"), (11, "missing"), (9999, "extra"), (None, "extra")], key=str)
    assert one.differing(two).count() <= 4
    assert hashtree.changed_keys(one, hashtree.HashTree(a.repartition(3), "k", ["text", "source"], 2)).count() == 0
    assert hashtree.agreeing_reads(a, a.repartition(2), "k", ["text"])[1] == 3000
    with pytest.raises(ValueError, match=r"two reads differ: .*7 \(changed\)"):
        hashtree.agreeing_reads(a, b.filter("k is not null"), "k", ["source"])
    assert hashtree.HashTree(a.limit(0), "k", ["text"]).root() == (None, 0)


def test_refresh_keeps_every_column_in_a_layered_index(spark, tmp_path):
    from folioforge.sources.store import IndexStore
    from folioforge.streaming.refresh import refresh

    F = retrieval.F
    schema = "item_key string, document string, date_modified string, title string"
    embed = lambda rows: rows.withColumn("embedding", F.array(F.lit(1.0), F.lit(2.0)))
    layered, whole = LayeredIndex(spark, f"file://{tmp_path}/l"), IndexStore(spark, f"file://{tmp_path}/w", 2, "m")
    whole.publish(spark.createDataFrame([("z", "old", [0.0, 1.0], 5)], "item_key string, document string, embedding array<double>, more int"))
    for turn, rows in enumerate(([("a", "one", "1", "A"), ("b", "two", "1", "B")], [("c", "three", "2", None)])):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        for name, store in (("l", layered), ("w", whole)):
            refresh(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), store, f"{tmp_path}/check-{name}", embed).awaitTermination()
    assert {(r.item_key, r.title, r.date_modified) for r in layered.read().collect()} == {("a", "A", "1"), ("b", "B", "1"), ("c", None, "2")}
    assert [c["rows"] for c in layered.manifest()["changes"]] == [2, 1]
    assert {(r.item_key, r.title, r.more) for r in whole.read().collect()} == {("z", None, 5), ("a", "A", None), ("b", "B", None), ("c", None, None)}
