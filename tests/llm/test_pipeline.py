"""The pipeline's stages on small tables, each against a plain version of its decision."""

import importlib.util

import pytest

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("the pipeline is not here", allow_module_level=True)

import corpus_pipeline as C
from folioforge.llm.langid import identify
from folioforge.llm.mixing import mix
from folioforge.llm.packing import SEQUENCE

from .test_jaccard import _brute

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = C.known_language(spark, docs, SF)
    assert kept.columns == docs.columns
    found, _ = identify(docs)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(r.doc_id for r in found.filter("not rejected").collect())
    assert kept.count() >= 0.97 * docs.count()

    single = C.one_of_near_copies(spark, kept, SF)
    assert single.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    want = [i for i, n, c in _brute(rows, 5, (80, 100)) if n == 0 or i == c]
    assert sorted(str(r.doc_id) for r in single.select("doc_id").collect()) == sorted(want)

    mixed = C.mix_sources(spark, single, SF)
    assert mixed.columns == docs.columns
    assert sorted(r.doc_id for r in mixed.select("doc_id").collect()) == sorted(r.doc_id for r in mix(single).collect() for _ in range(r.copies))

    packed = C.pack_sequences(spark, mixed, SF).collect()
    assert sum(r.start == 0 for r in packed) == mixed.count()
    filled = {}
    for r in packed:
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert max(filled.values()) <= SEQUENCE


def test_stages_on_columns_of_any_type_and_name(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, label map<string,int>, rid array<map<string,int>>, n int, k struct<m:map<int,int>>"
    text = {"en": "the quick brown fox jumps over the lazy dog and runs into the dark wood where nobody lives", "fr": "le chat dort sur la table de la cuisine pendant que la pluie tombe sur les toits de la ville"}
    rows = [(i, text[lang] + f" {i // 4} {i // 4}", lang, "s" if i % 3 else None, 9, "x", {"a": i}, [{"b": 1}], 2, ({1: 2},)) for i in range(24) for lang in ["en" if i < 12 else "fr"]]
    rows += [rows[0], rows[0], (0, rows[0][1], "en", None, 9, "y", {"a": 0}, None, 3, None), (90, None, None, None, None, None, None, None, None, None), (91, "", "en", "s", 0, "x", {}, [], 0, ({},))]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.dtypes == spark.createDataFrame([], schema).dtypes, name
        docs = spark.createDataFrame(docs.collect(), schema)
    kept = docs.collect()
    assert {r.doc_id for r in kept} <= {i for i in range(24)} | {91}
    assert len({tuple(sorted(r.label.items())) for r in kept if r.doc_id == 0}) <= 1  # one of the repeated rows
    assert C.STAGES[-1][1](spark, docs, SF).filter("start = 0").count() == len(kept)


def test_run_and_empty_tables(spark, tmp_path):
    assert C.run(spark, SF).count() > 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
    assert [name for name, _ in C.STAGES] == ["language_id", "ngram_jaccard_join", "mixing", "packing"]
