"""Library operators, text functions, the store and refreshes, on hand-made rows."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from folioforge.functions import position
from folioforge.functions import text as X
from folioforge.operators import library
from folioforge.sources.store import Conflict, IndexStore
from folioforge.streaming import refresh


def _one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


def test_titles_and_identifiers(spark):
    same = {_one(spark, X.duplicate_title, t) for t in ("The Quick Brown Fox", "quick brown fox", "  QUICK  BROWN  FOX!  ")}
    assert same == {"quick brown fox"}
    for text, kind, value in (("https://doi.org/10.1000/AbC.", "doi", "10.1000/abc"), ("arXiv:1706.03762v5", "arxiv", "1706.03762"), ("hep-th/9901001", "arxiv", "hep-th/9901001"), ("PMID: 123", "pmid", "123"), ("https://x.org/y", "url", "https://x.org/y"), ("nonsense", None, None)):
        got = _one(spark, X.identifier, text)
        assert (got.type, got.value) == (kind, value)
    assert _one(spark, X.identifier, "arXiv:1706.03762v5").version == 5
    assert [_one(spark, X.quality, t) for t in ("x" * 500, "x" * 499, "")] == ["good", "degraded", "empty"]


def test_creators(spark):
    schema = "c array<struct<creatorType: string, firstName: string, lastName: string, name: string>>"
    rows = spark.createDataFrame([([("a", "Jane", "Doe", None), ("a", None, None, "UNESCO"), ("a", "", "Roe", None)],), ([],), (None,)], schema)
    assert [r.y for r in rows.select(X.creators_text(F.col("c")).alias("y")).collect()] == ["Doe, Jane; UNESCO; Roe, ", "No authors listed", "No authors listed"]


def test_children_never_multiply(spark):
    parents = spark.createDataFrame([(1,), (2,)], "k long")
    notes = spark.createDataFrame([(1, 1, "n1"), (1, 2, "n2"), (1, 3, None)], "k long, o int, t string")
    names = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, "c")], "k long, o int, t string")
    out = library.concat_children(library.concat_children(parents, notes, "k", "t", "o", "notes", " "), names, "k", "t", "o", "names")
    assert [tuple(r) for r in out.orderBy("k").collect()] == [(1, "n1 n2", "a; b; c"), (2, None, None)]


def test_tree_leaves_out_orphans_and_cycles(spark):
    nodes = spark.createDataFrame([("a", "A", None), ("b", "B", "a"), ("c", "C", "b"), ("o", "O", "gone"), ("x", "X", "y"), ("y", "Y", "x")], "key string, name string, parent string")
    assert sorted((r.key, r.depth, r.path) for r in library.tree(nodes).collect()) == [("a", 0, "A"), ("b", 1, "A/B"), ("c", 2, "A/B/C")]


def test_tree_of_any_depth(spark):
    nodes = spark.createDataFrame([(f"n{i}", f"N{i}", f"n{i - 1}" if i else None) for i in range(12)], "key string, name string, parent string")
    assert library.tree(nodes).count() == 12 and library.tree(nodes.filter("key = 'n3'")).count() == 0


def test_digest_of_string_keys(spark):
    rows = [("ABCD1234", "x"), ("ZZ", "y"), ("Q", None)]
    digest = lambda r, n: library.content_digest(spark.createDataFrame(r, "k string, t string").repartition(n), "k", "t").first()
    assert digest(rows, 1) == digest(rows[::-1], 3) and digest(rows, 1).n == 3
    assert len({digest(r, 1).digest for r in (rows, rows[:2], [("ABCD1235", "x"), *rows[1:]], [("ABCD1234", "z"), *rows[1:]])}) == 4


def test_spans_meet_ranges_once(spark):
    spans = [(k, a, a + n) for k in (1, 2) for a, n in ((0, 10), (10, 0), (4090, 20), (9000, 9000))]
    ranges = [(1, 5, 12), (1, 4095, 4096), (2, 0, 20000), (3, 0, 5)]
    got = library.span_overlaps(spark.createDataFrame(spans, "k int, start long, end long"), spark.createDataFrame(ranges, "k int, range_start long, range_end long"), "k")
    want = [(k, a, b, c, d) for k, a, b in spans for j, c, d in ranges if j == k and a < d and b > c]
    assert sorted((r.k, r.start, r.end, r.range_start, r.range_end) for r in got.collect()) == sorted(want)


def test_merge_and_tags(spark):
    items = spark.createDataFrame([("k", ["x"], "book"), ("d", ["y", "x"], "book"), ("e", ["z"], "attachment")], "item_key string, tags array<string>, item_type string")
    groups = spark.createDataFrame([(1, "k", "k"), (1, "k", "d"), (1, "k", "e")], "group_id long, keeper string, member string")
    r = library.merge_plan(items, groups).first()
    assert (r.tags, r.added, r.n_trashed) == (["x", "y", "z"], ["y", "z"], 2)
    counts = {t.tag: (t.n_added, t.n_removed) for t in library.tag_counts(library.update_tags(items, ["y", "q"], ["x"])).collect()}
    assert counts == {"y": (1, 0), "q": (2, 0), "x": (0, 2)}


def test_preprints(spark):
    items = spark.createDataFrame([(1, "preprint", "A b", None), (2, "journalArticle", "a  B", None), (3, "preprint", "c", "10.1/x"), (4, "journalArticle", "z", "doi:10.1/X"), (5, "preprint", "alone", None), (6, "preprint", "", "")], "item_key long, item_type string, title string, doi string")
    assert sorted(r.item_key for r in library.without_preprints(items).collect()) == [2, 4, 5, 6]


def test_positions():
    hay = "The quick brown fox\njumps over the lazy dog, and the rest is silence."
    assert position.locate("brown fox", hay) == (10, 19, 1.0, "exact")
    assert position.locate("FOX JUMPS", hay)[3] == "squeezed" and hay[slice(*position.locate("foxjumps", hay)[:2])] == "fox\njumps"
    found = position.locate("jumps ovar the lazy dog", hay)
    assert found[3] == "fuzzy" and found[2] > 0.85 and "lazy" in hay[found[0] : found[1]]
    assert position.locate("nothing like this at all", hay) is None and position.locate("", hay) is None and position.locate("x", None) is None


def _rows(spark, keys, text="t"):
    return spark.createDataFrame([(k, f"{text}{k}", [1.0, float(k)]) for k in keys], "item_key long, document string, embedding array<double>")


def test_store(spark, tmp_path):
    store = IndexStore(spark, f"file://{tmp_path}/index", 2, "m1")
    assert store.version() == 0
    with pytest.raises(FileNotFoundError):
        store.read()
    assert store.publish(_rows(spark, [1, 2, 3])) == 1 and store.verify()
    before = store.read(1)
    store.upsert(_rows(spark, [3, 4], "new"))
    assert {r.item_key: r.document for r in store.read().collect()} == {1: "t1", 2: "t2", 3: "new3", 4: "new4"}
    assert before.count() == 3  # a reader's version does not change beside it
    store.insert(_rows(spark, [4, 5], "late"))
    assert {r.item_key: r.document for r in store.read().collect()}[4] == "new4"
    store.delete(_rows(spark, [1, 5]))
    assert sorted(r.item_key for r in store.read().collect()) == [2, 3, 4]
    with pytest.raises(ValueError):
        store.publish(_rows(spark, [1, 1]))
    with pytest.raises(ValueError):
        store.publish(spark.createDataFrame([(1, "x", [1.0])], "item_key long, document string, embedding array<double>"))
    assert store.version() == 4
    assert IndexStore(spark, store.folder, 2, "m2").upsert(_rows(spark, [9])) == 5 and store.read().count() == 1  # another model starts anew
    store.reset()
    assert store.read().count() == 0
    with pytest.raises(Conflict):
        store.publish(_rows(spark, [7]), base=2)  # another writer was faster
    assert store.version() == 6 and store.status()["rows"] == 0
    named = IndexStore(spark, f"file://{tmp_path}/named", 2, "m")
    named.publish(spark.createDataFrame([("ABCD1234", "t", [1.0, 2.0])], "item_key string, document string, embedding array<double>"))
    assert named.verify() and named.read().first().item_key == "ABCD1234"


def test_refresh(spark, tmp_path):
    now = datetime(2024, 5, 2, 12)
    assert [refresh.is_due(p, datetime(2024, 5, 1, 11), now) for p in ("manual", "startup", "daily", "every_2")] == [False, True, True, False]
    assert refresh.is_due("daily", None, now) and not refresh.is_due("manual", None, now)
    arrived = spark.createDataFrame([(1, "b"), (2, "b"), (3, "b"), (4, "b")], "item_key long, date_modified string")
    state = spark.createDataFrame([(1, "indexed", "a"), (2, "failed", "b"), (3, "failed", "a")], "item_key long, status string, date_modified string")
    assert sorted(r.item_key for r in refresh.to_process(arrived, state).collect()) == [3, 4]
    store = IndexStore(spark, f"file://{tmp_path}/index", 2, "m")
    embed = lambda rows: rows.withColumn("embedding", F.array(F.lit(1.0), F.lit(2.0)))
    for turn, keys in enumerate(([1, 2, 2], [2, 3])):
        spark.createDataFrame([(k, f"d{k}", str(turn)) for k in keys], "item_key long, document string, date_modified string").write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("item_key long, document string, date_modified string").parquet(f"{tmp_path}/in")
        refresh.refresh(stream, store, f"{tmp_path}/check", embed).awaitTermination()
    assert sorted(r.item_key for r in store.read().collect()) == [1, 2, 3]


def test_refresh_retries_what_failed_and_changed(spark, tmp_path):
    store = IndexStore(spark, f"file://{tmp_path}/index", 2, "m")
    embed = lambda rows: rows.withColumn("embedding", F.when(~F.col("document").startswith("bad"), F.array(F.lit(1.0), F.lit(2.0))))
    schema = "item_key string, document string, date_modified string"
    for rows in ([("a", "one", "1"), ("b", "bad", "1"), ("c", "bad", "1")], [("a", "changed", "2"), ("b", "good", "1"), ("c", "good", "2")], [("b", "good", "2")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        refresh.refresh(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), store, f"{tmp_path}/check", embed).awaitTermination()
    assert {r.item_key: r.document for r in store.read().collect()} == {"a": "one", "b": "good", "c": "good"} and store.version() == 3


def test_positions_in_pages(spark):
    words = [f"word{i * 37 % 101}" for i in range(60)]
    passage = " ".join(words)
    pages = ["front matter", "intro and more", f"Before.\n{passage.replace(' word3 ', chr(10) + 'word3 ')} After.", "tail", "short needle here"]
    page, start, end, ratio, how = position.locate_in_pages(passage, pages, 2)
    assert (page, ratio, how) == (3, 1.0, "ends") and pages[2][start:end].split() == words
    broken = " ".join(w if i != 1 else "wurd" for i, w in enumerate(words))
    page, start, end, ratio, how = position.locate_in_pages(broken, pages, 3)
    assert page == 3 and how == "ends" and 0.75 <= ratio < 1 and pages[2][start:end].endswith(words[-1])
    assert position.locate_in_pages("short needle", pages, 4)[:4] == (5, 0, 12, 1.0) and position.locate_in_pages("short needle", pages, 1) is None
    assert position.locate_in_pages("front", pages, 3)[0] == 1 and position.ends("too short") is None
    rows = spark.createDataFrame([("short needle", pages, 5), (None, pages, 1), ("x", None, 1)], "n string, p array<string>, t int")
    assert [r.x.page for r in rows.select(position.located_in_pages(F.col("n"), F.col("p"), F.col("t")).alias("x")).collect()] == [5, None, None]
