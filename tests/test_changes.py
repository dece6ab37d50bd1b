"""Merges with children, labels, parents, model names, token limits."""

import pytest
from pyspark.sql import functions as F

from folioforge.functions.tokens import truncated_to_tokens
from folioforge.operators import changes, items


def test_merge_moves_children_once(spark):
    groups = spark.createDataFrame([("k", "k"), ("k", "d"), ("k", "e")], "keeper string, member string")
    children = spark.createDataFrame([(1, "k", "a.pdf"), (2, "d", "a.pdf"), (3, "d", "b.pdf"), (4, "e", "note"), (5, "other", "x")], "itemID int, parentItem string, filename string")
    signed = children.select("itemID", "parentItem", F.lit("application/pdf").alias("contentType"), "filename", F.lit("").alias("md5"), F.lit("").alias("url"))
    repeated = items.repeated_attachments(signed, groups)
    assert [r.itemID for r in repeated.collect()] == [2]
    assert {r.itemID: r.parentItem for r in changes.moved_children(children, groups, repeated).collect()} == {1: "k", 2: "d", 3: "k", 4: "k", 5: "other"}
    held = spark.createDataFrame([("k", ["x"], ["C1"]), ("d", ["y", "x", ""], ["C2"]), ("e", None, None)], "item_key string, tags array<string>, collections array<string>")
    r = changes.merge_preview(held, children, groups, repeated).first()
    assert (r.duplicates, r.new_tags, r.new_collections, r.n_moved, r.n_skipped) == (["d", "e"], ["y"], ["C2"], 2, 1)


def test_labels(spark):
    held = spark.createDataFrame([("a", 1, ["x", "y"]), ("b", 1, None), ("c", 1, ["z"])], "item_key string, version int, tags array<string>")
    schema = "item_key string, `set` array<string>, add array<string>, remove array<string>"
    updates = spark.createDataFrame([("a", None, ["n"], ["x"]), ("b", ["q"], None, None), ("c", None, ["z"], None)], schema)
    got = {r.item_key: (r.version, r.tags) for r in changes.update_labels(held, updates).collect()}
    assert got == {"a": (2, ["n", "y"]), "b": (2, ["q"]), "c": (1, ["z"])}


def test_parents_and_models(spark):
    wanted = spark.createDataFrame([(1, "ABCD1234"), (2, "shelf"), (3, "nowhere")], "id int, parent string")
    held = spark.createDataFrame([("K2", "Shelf"), ("K1", "SHELF")], "key string, name string")
    assert {r.id: r.parent_key for r in changes.parent_collections(wanted, held).collect()} == {1: "ABCD1234", 2: "K1", 3: None}
    assert changes.model_name({"a": [{"b": {"model": " "}}, {"model_name": "m"}]}) == "m" and changes.model_name({"x": 1}) is None


def test_token_limit(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    path = tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    texts = ["one two three four five six", "short", None, "é" * 30, "", "日本語 text 日本語"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", truncated_to_tokens(F.col("t"), 4, path).alias("x")).collect()
    for r in rows:
        text = texts[r.i]
        if text is None:
            assert r.x is None
        elif len(plain.encode(text, add_special_tokens=False).ids) <= 4:
            assert r.x == text
        else:
            assert text.startswith(r.x) and r.x != text and len(r.x) > 0


def test_notes_and_annotations_together(spark):
    from .test_search import _tables

    assert [(r.type, r.key) for r in items.search_notes_and_annotations(_tables(spark), "red").collect()] == [("note", "N3")]
    assert [(r.type, r.key) for r in items.search_notes_and_annotations(_tables(spark), "bird").collect()] == [("annotation", "H6")]
