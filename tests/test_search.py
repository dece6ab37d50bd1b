"""Search paths, the evaluator, paged sources, scans of a library's tables, on hand-made rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from folioforge.functions import text as X
from folioforge.operators import items as I
from folioforge.operators import render, search


def _corpus(spark):
    vectors = {"a": [1.0, 0.0, 0.0], "b": [0.0, 1.0, 0.0], "c": [0.0, 0.0, 1.0], "d": [0.7, 0.7, 0.0]}
    titles = {"a": "Alpha beta gamma", "b": "Bird song", "c": " ProQuest: clip", "d": "Deep sea"}
    docs = spark.createDataFrame([(k, t, None, f"{t} text of {k}") for k, t in titles.items()], "item_key string, title string, doi string, document string")
    index = spark.createDataFrame([(k, v, "x" if k in "ab" else None) for k, v in vectors.items()], "item_key string, embedding array<double>, kind string")
    queries = spark.createDataFrame([("q", "bird song")], "query_id string, text string")
    return docs, index, queries, spark.createDataFrame([("q", [1.0, 0.0, 0.0])], "query_id string, qv array<double>")


def _order(found):
    return [r.item_key for r in found.orderBy("rank").collect()]


def test_modes_filters_and_policies(spark):
    corpus = _corpus(spark)
    assert _order(search.search(*corpus, 2)) == ["a", "d"]
    hybrid = {"mode": "hybrid", "weights": {"dense": 1.0, "lex": 1.0}}
    assert _order(search.search(*corpus, 4, hybrid))[0] == "b" or _order(search.search(*corpus, 4, hybrid))[:2] == ["a", "b"]
    assert _order(search.search(*corpus, 4, {"noise_policy": "exclude"})) == ["a", "d", "b"]
    assert _order(search.search(*corpus, 4, {"noise_policy": "demote"}))[-1] == "c"
    assert sorted(_order(search.search(*corpus, 4, hybrid, {"kind": "x"}))) == ["a", "b"]
    assert sorted(_order(search.search(*corpus, 4, hybrid, {"$or": [{"kind": "x"}, {"kind": {"$ne": "x"}}]}))) == ["a", "b", "c", "d"]
    assert _order(search.search(*corpus, 4, None, None, {"$contains": "Deep"})) == ["d"]
    with pytest.raises(ValueError):
        search.search(*corpus, 4, {"mode": "other"})
    scores = lambda found: found.withColumn("rerank_score", F.when(F.col("item_key") == "b", 9.0).otherwise(0.0))
    assert _order(search.search(*corpus, 1, rerank=scores)) == ["b"]


def test_candidates_are_refilled(spark, monkeypatch):
    monkeypatch.setattr(search, "LEAST_DEPTH", 4)
    rows = [(f"dup{i}", "Same title", [1.0, i / 1000]) for i in range(20)] + [(f"u{i}", f"Unique {i}", [0.5, float(i)]) for i in range(6)]
    docs = spark.createDataFrame([(k, t, None, t) for k, t, _ in rows], "item_key string, title string, doi string, document string")
    index = spark.createDataFrame([(k, v) for k, _, v in rows], "item_key string, embedding array<double>")
    queries = spark.createDataFrame([("q", "none")], "query_id string, text string")
    found = search.search(docs, index, queries, spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, qv array<double>"), 4, {"collapse": True}).orderBy("rank").collect()
    assert len(found) == 4 and found[0].item_key == "dup0" and {r.item_key for r in found[1:]} == {"u0", "u1", "u2"} and found[0].depth > 4


def test_evaluator(spark):
    docs, index, _, _ = _corpus(spark)
    schema = "query_id string, text string, exclude_ids array<string>, candidate_ids array<string>, partition string"
    suite = spark.createDataFrame([("q1", "one", [], None, "dev"), ("q2", "two", ["a"], ["a", "b"], "dev"), ("q3", "three", [], [], "test")], schema)
    vectors = spark.createDataFrame([("q1", [1.0, 0.0, 0.0]), ("q2", [1.0, 0.0, 0.0]), ("q3", [0.0, 1.0, 0.0])], "query_id string, qv array<double>")
    found, overlaps = search.evaluate(suite, docs, index, vectors, "baseline-dense", 10)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.item_key)
    assert got["q1"][0] == "a" and len(got["q1"]) == 4 and got["q2"] == ["b"] and "q3" not in got
    assert {r.query_id: r.overlap for r in overlaps.collect()} == {"q1": 1.0, "q2": 1.0, "q3": 1.0}
    with pytest.raises(ValueError):
        search.evaluate(suite, docs, index, vectors.filter("query_id <> 'q3'"), "baseline-dense")
    found, _ = search.evaluate(suite, docs, index, vectors.filter("query_id <> 'q1'"), "hybrid-gated", 5, skip_missing=True, partition="dev")
    assert {r.query_id for r in found.collect()} == {"q2"}


def test_rankings_are_written(spark, tmp_path):
    rankings = spark.createDataFrame([("q", "s", 1, "a"), ("q", "s", 2, "b")], "query_id string, system string, rank int, item_key string")
    m = search.write_rankings(rankings, spark.createDataFrame([("q", 0.5)], "query_id string, overlap double"), f"file://{tmp_path}/r", {"k": 2})
    assert m == {"query_count": 1, "ann_vs_exact_overlap_at_10": 0.5, "params": {"k": 2}}
    assert [x.item_key for x in spark.read.json(f"file://{tmp_path}/r/rankings").first().ranking] == ["a", "b"]


def test_limits_and_costs(spark):
    assert [search.bounded_limit(x) for x in (None, "5", 0, 1000)] == [10, 5, 1, 100]
    suite = spark.createDataFrame([("é",), ("é",), ("b",)], "text string")
    cached = spark.createDataFrame([(hashlib.sha256(b"b").hexdigest(),)], "key string")
    assert [(r.text, r.estimated_tokens) for r in search.query_costs(suite, cached, 0.2).collect()] == [("é", 34)]


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page int, total int, version int, rows array<struct<key: string, v: int>>")


def test_frozen_pages(spark):
    a, b, c = ("a", 1), ("b", 2), ("c", 3)
    assert sorted(r.key for r in search.frozen_pages(_pages(spark, [(0, 3, 7, [a, b]), (1, 3, 7, [c])]), 2, 5).collect()) == ["a", "b", "c"]
    for bad in ([], [(0, 3, 7, [a, b])], [(0, 3, 7, [a, b]), (1, 3, 8, [c])], [(0, 3, 7, [a, b]), (1, 4, 7, [c])], [(0, 3, 7, [a, b]), (1, 3, 7, [a])], [(0, 3, 7, [a, b]), (2, 3, 7, [c])], [(0, 3, 7, [a]), (1, 3, 7, [b, c])]):
        with pytest.raises(search.Incomplete):
            search.frozen_pages(_pages(spark, bad), 2, 5).count()
    with pytest.raises(search.Incomplete):
        search.frozen_pages(_pages(spark, [(0, 3, 7, [a, b]), (1, 3, 7, [c])]), 2, 1)
    pages = _pages(spark, [(0, 9, 7, [a, b]), (1, 9, 7, [c])])
    assert search.capped_pages(pages, 1).count() == 1 and search.capped_pages(pages, None).count() == 3
    with pytest.raises(search.Incomplete):
        search.checked_records([1, 2], [1])


def test_enrichment(spark):
    found = spark.createDataFrame([("q", 1, "a"), ("q", 2, "gone")], "query_id string, rank int, item_key string")
    items = spark.createDataFrame([("a", "Alpha")], "item_key string, title string")
    out = search.enriched(found, items, spark.createDataFrame([("q", "text")], "query_id string, text string"))
    got = {r.item_key: (r.item and r.item.title, r.error, r.query) for r in out.collect()}
    assert got == {"a": ("Alpha", None, "text"), "gone": (None, "Could not fetch full item data: gone", "text")}
    assert search.enriched_share(out).first().enriched == "1/2 items"


def _tables(spark):
    f = spark.createDataFrame
    return {
        "items": f([(1, "K1", 1, "d", "2020"), (2, "K2", 1, "d", "2021"), (3, "N3", 3, "d", "x"), (4, "A4", 2, "d", "x"), (5, "K5", 1, "d", "2022"), (6, "H6", 4, "d", "x")], "itemID int, key string, itemTypeID int, dateAdded string, dateModified string"),
        "itemTypes": f([(1, "book"), (2, "attachment"), (3, "note"), (4, "annotation")], "itemTypeID int, typeName string"),
        "fields": f([(1, "title"), (26, "DOI")], "fieldID int, fieldName string"),
        "itemData": f([(1, 1, 10), (1, 26, 11), (2, 1, 12)], "itemID int, fieldID int, valueID int"),
        "itemDataValues": f([(10, "One"), (11, "10.1/x"), (12, "Two")], "valueID int, value string"),
        "creators": f([(1, "Ann", "Lee"), (2, None, "Ng"), (3, "Solo", None)], "creatorID int, firstName string, lastName string"),
        "itemCreators": f([(1, 2, 0), (1, 1, 1), (1, 3, 2)], "itemID int, creatorID int, orderIndex int"),
        "itemNotes": f([(3, 1, "<p class='bird'>red fox</p>"), (7, 1, "more")], "itemID int, parentItemID int, note string"),
        "deletedItems": f([(5,)], "itemID int"),
        "itemAttachments": f([(4, 1, "storage:x.pdf", "application/pdf")], "itemID int, parentItemID int, path string, contentType string"),
        "itemAnnotations": f([(6, 4, "Green BIRD", None, 1, "#5fb236", "12")], "itemID int, parentItemID int, text string, comment string, type int, color string, pageLabel string"),
    }


def test_item_scan_and_children(spark):
    t = _tables(spark)
    got = {r.key: r for r in I.item_scan(t).collect()}
    assert set(got) == {"K1", "K2"} and got["K1"].creators == "Ng; Lee, Ann" and got["K1"].notes == "<p class='bird'>red fox</p> more" and got["K1"].doi == "10.1/x" and got["K2"].doi is None
    assert [r.key for r in I.item_scan(t, limit=1).collect()] == ["K2"] and I.item_by_key(t, "K1").count() == 1
    assert I.item_count(t).first().n == 2 and [r.key for r in I.parent_attachments(t, 1).collect()] == ["A4"]
    assert [(r.key, r.parent_key, r.parent_title) for r in I.search_notes(t, "FOX").collect()] == [("N3", "K1", "One")] and I.search_notes(t, "bird").count() == 0
    a = I.search_annotations(t, "bird").first()
    assert (a.key, a.annotation_type, a.page_label, a.attachment_key, a.parent_key, a.parent_title, a.comment) == ("H6", "highlight", "12", "A4", "K1", "One", "")


def test_small_rules(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(X.safe_path(F.lit("a/b.PDF"), ("pdf",))) and not any(one(X.safe_path(F.lit(p), ("pdf",))) for p in ("/a.pdf", "../a.pdf", "a/../b.pdf", "a.exe", "C:\\a.pdf"))
    assert [one(X.overlap_of_paths(F.lit(a), F.lit(b))) for a, b in (("/a/", "/a"), ("/a/b", "/a"), ("/a", "/a/b"), ("/ab", "/a"))] == ["equal", "inside", "contains", None]
    assert [tuple(one(X.split_name(F.lit(n)))) for n in ("Ann van Lee", "Plato")] == [("Ann van", "Lee"), ("", "Plato")]
    md = one(I.annotation_markdown(F.lit(1), F.lit("note"), F.lit("K"), F.lit(""), F.lit("iv"), F.lit(3), F.lit("t"), F.lit(None).cast("string"), F.lit("Paper")))
    assert md == '## Annotation 1 (from "Paper")\n**Type:** note\n**Key:** K\n**Page:** iv (index: 3)\n**Text:** t'
    assert tuple(one(I.corner(F.from_json(F.lit("[[3,4,5,6],[1,9,2,2]]"), "array<array<double>>")))) == (1.0, 4.0)
    rows = spark.createDataFrame([("x", "t", ""), ("y", None, None)], "k string, text string, comment string")
    assert [r.k for r in I.filled_annotations(rows).collect()] == ["x"]
    assert one(render.feed_item_markdown(F.lit("T"), F.lit("book"), F.lit(True), F.lit(""), F.lit("2020"), F.lit(None).cast("string"))) == "### T\n**Type:** book | **Status:** Read\n**Added:** 2020"
    names = spark.createDataFrame([("Shelf",)], "name string")
    held = spark.createDataFrame([("C1", "SHELF"), ("C2", "other")], "key string, name string")
    assert [r.key for r in I.collections_named(held, names).collect()] == ["C1"]
    with pytest.raises(Exception, match="no collection is named"):
        I.collections_named(held.filter("key = 'C2'"), names).collect()


def test_repeated_attachments(spark):
    a = spark.createDataFrame([(1, "k", "application/pdf", "a.pdf", "m", ""), (2, "d", "application/pdf", "a.pdf", "m", None), (3, "d", "text/html", "b", None, "u")], "itemID int, parentItem string, contentType string, filename string, md5 string, url string")
    groups = spark.createDataFrame([("k", "k"), ("k", "d")], "keeper string, member string")
    assert [r.itemID for r in I.repeated_attachments(a, groups).collect()] == [2]


def test_profiles_share_what_they_have_in_common(spark, monkeypatch):
    """Both branches are scored once for all profiles of a suite, with the same rankings as each alone."""
    docs, index, _, _ = _corpus(spark)
    schema = "query_id string, text string, exclude_ids array<string>, candidate_ids array<string>"
    suite = spark.createDataFrame([("q1", "one", [], None), ("q2", "two", ["a"], ["a", "b"])], schema)
    vectors = spark.createDataFrame([("q1", [1.0, 0.0, 0.0]), ("q2", [1.0, 0.0, 0.0])], "query_id string, qv array<double>")
    names, told = ("dense-collapse", "hybrid-rrf", "hybrid-gated-collapse"), []
    for name in ("lexical_topk", "dense_topk"):
        monkeypatch.setattr(search, name, lambda *a, f=getattr(search, name), n=name, **k: told.append(n) or f(*a, **k))

    def ranked(**more):
        told.clear()
        return [[sorted(map(tuple, df.collect())) for df in search.evaluate(suite, docs, index, vectors, n, 2, **more)] for n in names]

    alone = ranked()
    assert told.count("lexical_topk") == 2
    assert ranked(shared={}) == alone and told.count("lexical_topk") == 1
