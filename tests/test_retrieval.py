"""Retrieval on hand-made rows, and BM25 against SQLite's full-text index."""

import sqlite3

import pytest

from folioforge.operators import filters, retrieval


def _ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, item_key string, rank int")


def test_weighted_reciprocal_ranks(spark):
    dense, lexical = _ranked(spark, [(1, "b", 1), (1, "a", 2)]), _ranked(spark, [(1, "a", 1)])
    got = {r.item_key: (r.rank, r.score) for r in retrieval.fuse(dense, lexical, 1.0, 0.25).collect()}
    assert got["a"] == (1, round(1 / 62 + 0.25 / 61, 9)) and got["b"][0] == 2
    with pytest.raises(ValueError):
        retrieval.fuse(dense, lexical, -1.0)


@pytest.mark.parametrize(("text", "gated"), [("alpha beta gamma delta", True), ("alpha beta", False), ("alpha beta gamma", False), ("alpha beta gamma delta more words", True)])
def test_title_gate(spark, text, gated):
    titles = spark.createDataFrame([("a", "Alpha Beta Gamma Delta"), ("b", "Other")], "item_key string, title string")
    queries = spark.createDataFrame([(1, text)], "query_id long, text string")
    lexical = _ranked(spark, [(1, "a", 1)])
    fused = retrieval.fuse(_ranked(spark, [(1, "b", 1), (1, "a", 2)]), lexical, 1.0, 0.0)
    got = {r.item_key: r for r in retrieval.gate(fused, titles, queries).collect()}
    assert got["a"].gated == gated and got["a"].rank == (1 if gated else 2)
    if gated:
        assert got["a"].score == round(1 / 61 + 1 / 61, 9)


def _results(spark, rows):
    return spark.createDataFrame([(1, *r, i + 1) for i, r in enumerate(rows)], "query_id long, item_key string, title string, doi string, rank int")


def test_collapse(spark):
    rows = [("a", "One", "10.1/x"), ("b", "One", "10.1/x"), ("c", "Other", "doi:10.1/X"), ("d", "Two", None), ("e", "Three", None)]
    got = retrieval.collapse(_results(spark, rows), 3).orderBy("rank").collect()
    assert [r.item_key for r in got] == ["a", "d", "e"] and got[0].aliases == ["b", "c"]
    assert retrieval.collapse(_results(spark, [("a", "Same", "10.1/a"), ("b", "Same", None), ("c", "Same", "10.1/b")]), 9).count() == 3
    assert retrieval.collapse(_results(spark, [("a", "Same", None), ("b", "same", "10.1/a")]), 9).count() == 1
    assert retrieval.collapse(_results(spark, [("a", "", None), ("b", "", None)]), 9).count() == 2


@pytest.mark.parametrize(("policy", "want"), [("keep", "abc"), ("demote", "bac"), ("exclude", "b")])
def test_noise(spark, policy, want):
    rows = _results(spark, [("a", " ProQuest: x", None), ("b", "paper", None), ("c", "proquest:", None)])
    assert "".join(r.item_key for r in retrieval.noise(rows, policy).orderBy("rank").collect()) == want


def test_metrics(spark):
    index = spark.createDataFrame([(1, [0.0, 1.0])], "item_key long, embedding array<float>")
    queries = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, qv array<double>")
    assert [retrieval.dense_topk(index, queries, 1, m).first().score for m in ("l2", "cosine", "ip")] == [-1.0, 0.0, 0.0]


def test_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "MAX_QUERIES", 2)
    index = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "item_key long, embedding array<float>")
    queries = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "query_id long, qv array<double>")
    got = retrieval.dense_topk(index, queries, 1).collect()
    assert sorted((r.query_id, r.item_key) for r in got) == [(i, i) for i in range(5)]


def test_bm25_equals_sqlite(spark):
    docs = [(1, "red fox", "the quick red fox jumps over the dog"), (2, "lazy dog", "a dog sleeps"), (3, "", "fox fox fox and hound"), (4, "birds", "nothing to see"), (5, "the fox", "")]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(title, document, tokenize='unicode61')")
    db.executemany("insert into t(rowid, title, document) values (?, ?, ?)", docs)
    want = dict(db.execute("select rowid, -bm25(t, 3.0, 1.0) from t where t match 'fox OR dog OR red'").fetchall())
    frame = spark.createDataFrame(docs, "item_key long, title string, document string")
    queries = spark.createDataFrame([(1, "Fox dog red fox")], "query_id long, text string")
    got = {r.item_key: r.score for r in retrieval.bm25(frame, queries).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in got)


META = [("a", "x", 1, True), ("b", "y", 2, False), ("c", None, None, None)]


@pytest.mark.parametrize(
    ("where", "want"),
    [({"kind": "x"}, "a"), ({"kind": {"$ne": "x"}}, "bc"), ({"n": {"$in": [1, 2]}}, "ab"), ({"n": {"$nin": [1]}}, "bc"), ({"$and": [{"kind": {"$ne": "y"}}, {"n": {"$nin": [5]}}]}, "ac"), ({"flag": True}, "a"), ({"flag": 1}, ""), ({"n": True}, ""), ({"missing": {"$ne": 3}}, "abc"), ({"missing": 3}, "")],
)
def test_metadata_filters(spark, where, want):
    rows = spark.createDataFrame(META, "k string, kind string, n int, flag boolean")
    assert "".join(sorted(r.k for r in rows.filter(filters.matches(where, rows)).collect())) == want


def test_unsupported_filters():
    for bad in ({}, {"a": 1, "b": 2}, {"$and": [{"a": 1}]}, {"a": {"$in": []}}, {"a": {"$gt": 1}}, {"$or": [{"a": 1}, {"b": 2}]}, {"a": None}, {"a": {"$in": [[1]]}}):
        assert not filters.supported(bad)


def test_advanced_search_rules(spark):
    rows = spark.createDataFrame([(1, "2021-05", ["Müller, Hans"], None, "10"), (2, "99", [], "", "9"), (3, None, None, "x", "abc")], "k long, date string, creators array<string>, note string, volume string")

    def found(*conditions, mode="all"):
        return sorted(r.k for r in filters.advanced_search(rows, list(conditions), mode).collect())

    assert found(("creators", "contains", "muller")) == [1]
    assert found(("creators", "doesNotContain", "zzz")) == [1]  # no values never pass
    assert found(("absent", "isNot", "y")) == [1, 2, 3]  # a missing field is one empty string
    assert found(("note", "isNot", "y")) == [2, 3]  # a null has no values
    assert found(("year", "isGreaterThan", "1998")) == [1]  # a short date has no year
    assert found(("volume", "isGreaterThan", "9")) == [1, 3]  # numbers as numbers, else as text
    assert found(("volume", "is", "9"), ("year", "is", "2021"), mode="any") == [1, 2]
    with pytest.raises(ValueError):
        filters.advanced_search(rows, [("a", "like", "b")])


def test_bm25_folds_as_the_full_text_index(spark):
    docs = [(1, "Müller", "straße in münchen"), (2, "muller", "strasse"), (3, "Naïve Café", "x_y z"), (4, "other", "words")]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(title, document, tokenize='unicode61')")
    db.executemany("insert into t(rowid, title, document) values (?, ?, ?)", docs)
    frame = spark.createDataFrame(docs, "item_key long, title string, document string")
    for asked, match in (("MÜLLER", '"müller"'), ("cafe", '"cafe"'), ("strasse", '"strasse"'), ("Straße München", '"strasse" OR "münchen"')):
        want = dict(db.execute("select rowid, -bm25(t, 3.0, 1.0) from t where t match ?", (match,)).fetchall())
        got = {r.item_key: r.score for r in retrieval.bm25(frame, spark.createDataFrame([(1, asked)], "query_id long, text string")).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in got), asked


def test_postings_are_kept_and_follow_changes(spark, tmp_path):
    from folioforge.sources.postings import Postings

    docs = spark.createDataFrame([("k1", "a", "red fox"), ("k2", None, None)], "item_key string, title string, document string")
    folder = f"file://{tmp_path}/lex"
    first = Postings.of(docs, folder)
    assert first.documents == 2 and first.average == 1.5 and Postings.of(docs.repartition(3), folder).path == first.path
    other = Postings.of(docs.replace("red fox", "red dog", subset=["document"]), folder)
    assert other.path != first.path
    asked = spark.createDataFrame([(1, "fox")], "query_id long, text string")
    assert [r.item_key for r in retrieval.bm25(docs, asked, postings=first).collect()] == ["k1"] and retrieval.bm25(docs, asked, postings=other).count() == 0


def test_words():
    from folioforge.functions.tokens import indexed_words, words

    assert words("STRASSE straße ﬁne ½ snake_case Ⅷ") == ["strasse", "strasse", "fine", "1", "2", "snake", "case", "viii"]
    assert indexed_words("Müller Straße") == ["muller", "straße"] and words(None) == []


def test_string_keys_and_overlap(spark):
    index = spark.createDataFrame([("AB12", [1.0, 0.0]), ("CD34", [0.0, 1.0])], "item_key string, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, qv array<double>")
    top = retrieval.dense_topk(index, queries, 1)
    assert {(r.query_id, r.item_key) for r in top.collect()} == {(1, "AB12"), (2, "CD34")}
    none = top.filter("query_id = 1")
    assert {(r.query_id, r.overlap) for r in retrieval.overlap_at(top, none, 1).collect()} == {(1, 1.0), (2, 0.0)}
    docs = spark.createDataFrame([("AB12", "One", None, "one fox"), ("CD34", "Two", None, "two")], "item_key string, title string, doi string, document string")
    asked = spark.createDataFrame([(1, "fox"), (2, "two")], "query_id long, text string")
    for collapse in (True, False):
        got = retrieval.hybrid_search(docs, index, asked, queries, do_collapse=collapse).filter("rank = 1").collect()
        assert {(r.query_id, r.item_key) for r in got} == {(1, "AB12"), (2, "CD34")}
