"""Books' chapters and fragment identifiers, the evaluator's profiles, acquisition rules."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from folioforge.functions import books
from folioforge.operators import acquire, changes

CHAPTER = "<html><head><title>T</title></head><body><p>First words.</p><p>Second <b>bold</b> and more words here.</p></body></html>"


def _book():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", "<container xmlns='urn:oasis:names:tc:opendocument:xmlns:container'><rootfiles><rootfile full-path='OEBPS/p.opf'/></rootfiles></container>")
        z.writestr("OEBPS/p.opf", "<package xmlns='http://www.idpf.org/2007/opf'><manifest><item id='b' href='two.xhtml'/><item id='a' href='sub/../one.xhtml'/></manifest><spine><itemref idref='a'/><itemref idref='gone'/><itemref idref='b'/></spine></package>")
        z.writestr("OEBPS/one.xhtml", CHAPTER)
        z.writestr("OEBPS/two.xhtml", "<p>x</p>")
    return out.getvalue()


def test_spine():
    assert [(i, p) for i, p, _ in books.spine(_book())] == [(0, "OEBPS/one.xhtml"), (2, "OEBPS/two.xhtml")]


def test_fragments():
    assert books.fragment(0, CHAPTER, "words") == "epubcfi(/6/2!/2/4/2,/1:6,/1:11)"
    assert books.fragment(0, CHAPTER, "bold and") == "epubcfi(/6/2!/2/4/4,/2/1:0,/3:4)"
    assert books.fragment(1, CHAPTER, "Secondbold") == "epubcfi(/6/4!/2/4/4,/1:0,/2/1:4)"
    assert books.fragment(0, CHAPTER, "nowhere") is None and books.fragment(0, CHAPTER, "") is None


def test_profiles():
    assert list(changes.PROFILES) == ["baseline-dense", "dense-collapse", "hybrid-rrf", "hybrid-weighted", "hybrid-gated", "hybrid-weighted-collapse", "hybrid-gated-collapse"]
    assert changes.profile("baseline-dense") == changes.DEFAULTS and not changes.profile("hybrid-weighted")["gate"]
    got = changes.profile("hybrid-rrf", {"k": 10, "weights.lex": 0.1})
    assert got["k"] == 10 and got["weights"] == {"dense": 1.0, "lex": 0.1} and changes.PROFILES["hybrid-rrf"]["weights"]["lex"] == 1.0
    with pytest.raises(KeyError):
        changes.profile("none")
    for bad in ("nope", "weights.nope", "k.x"):
        with pytest.raises(ValueError):
            changes.profile("baseline-dense", {bad: 1})


def test_suite_must_be_sound(spark):
    schema = "query_id string, text string, exclude_ids array<string>, candidate_ids array<string>"
    for bad in ([("a", "x", [], None), ("a", "y", [], None)], [("a", " ", [], None)]):
        with pytest.raises(ValueError):
            changes.checked_suite(spark.createDataFrame(bad, schema))
    ids = spark.createDataFrame([("A",), ("B",)], "item_key string")
    suite = spark.createDataFrame([("q", "x", ["A"], ["A", "B"]), ("n", "x", None, [])], schema)
    assert [tuple(r) for r in changes.eligible(suite, ids).collect()] == [("q", "B")]


def test_extraction_quality_and_pdf(spark):
    rows = spark.createDataFrame([("x" * 600, "y"), ("x" * 10, "y" * 700), ("x" * 10, "y" * 20), (None, "")], "a string, b string")
    got = [r.e for r in rows.select(acquire.chosen_extraction({"a": F.col("a"), "b": F.col("b")}).alias("e")).collect()]
    assert [(e.backend, e.quality, e.chain, e.char_count) for e in got] == [("a", "good", ["a"], 600), ("b", "good", ["a", "b"], 700), ("b", "degraded", ["a", "b"], 20), (None, "empty", ["a", "b"], 0)]
    files = spark.createDataFrame([(b"%PDF" + b"x" * 1000,), (b"%PDF",), (b"<html>" + b"x" * 1000,)], "c binary")
    assert [r.p for r in files.select(acquire.is_pdf(F.col("c")).alias("p")).collect()] == [True, False, False]
