"""Language identification: held-out accuracy, rejection, vectorised against plain features."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioforge.llm import langid

SF = "/root/testdata/sf0.01/documents.parquet"


def test_features_match_a_plain_loop():
    text = "Été, Ab 12"
    data = np.frombuffer(text.encode(), np.uint8)
    for order in langid.ORDERS:
        got = langid.features(data, np.array([len(data)]), order)
        for i in range(len(data)):
            if i + order > len(data):
                assert got[i] == langid.BUCKETS
                continue
            h = 0
            for j in range(order):
                h = (h + int(langid._CODES[data[i + j]])) * langid._A % (1 << 64)
            assert got[i] == h >> 48


def _model():
    words = {"aa": "the cat sat on that mat with this hat", "bb": "le chat est dans la maison avec une pomme", "cc": "der hund ist nicht auf dem tisch und schläft"}
    rng = np.random.default_rng(0)
    texts, labels = [], []
    for lang, w in words.items():
        for _ in range(80):
            texts.append(" ".join(rng.choice(w.split(), 12)))
            labels.append(lang)
    return langid.train(texts, labels)


def test_blocks_do_not_change_predictions(monkeypatch):
    model = _model()
    texts = ["the cat", None, "", "12 34", "le chat est " * 500, "der hund", "é", "x"]
    whole = model.predict(pa.array(texts))
    monkeypatch.setattr(langid, "_BLOCK", 64)
    cut = model.predict(pa.array(texts))
    assert whole[0] == cut[0] and np.allclose(whole[1], cut[1], atol=1e-5)
    assert whole[0][:4] == ["aa", "und", "und", "und"] and whole[0][4:6] == ["bb", "cc"]
    assert list(whole[1][1:4]) == [0, 0, 0] and ((0 <= whole[1]) & (whole[1] <= 1)).all()


def test_held_out_accuracy_and_rejection(spark):
    docs = spark.read.parquet(SF)
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    found, model = langid.identify(docs, ~held)
    rows = found.join(docs.select("doc_id", "lang"), "doc_id").filter(held).collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows)
    assert sum(r.rejected for r in rows) <= 0.02 * len(rows)
    assert model.notes["fitted"] <= langid.ROWS


def test_edges(spark):
    schema = "doc_id long, text string, lang string, score double, rejected string"
    empty = spark.createDataFrame([], schema)
    assert langid.identify(empty)[0].count() == 0 and langid.accepted(empty).count() == 0
    docs = spark.createDataFrame([(1, None, "en", 9.0, "x"), (2, "the cat sat", "en", 9.0, "x"), (2, "the cat sat", "en", 9.0, "x"), (3, "le chat dort", "fr", 9.0, "x"), (4, "???", None, 9.0, "x"), (None, "the the the", "en", 9.0, "x")], schema)
    got = sorted((str(r.doc_id), r.lang_pred) for r in langid.identify(docs)[0].collect())
    assert got == [("1", "und"), ("2", "en"), ("2", "en"), ("3", "fr"), ("4", "und"), ("None", "en")]
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "2", "3", "None"]
    nobody = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(nobody)[0].collect()} == {"und"}


@pytest.mark.parametrize("repeat", [1, 2])
def test_reruns_agree(spark, repeat):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a = sorted(map(tuple, langid.identify(docs)[0].collect()))
    b = sorted(map(tuple, langid.identify(docs.repartition(3 * repeat))[0].collect()))
    assert [x[:2] for x in a] == [x[:2] for x in b]


def test_prediction_matches_a_plain_softmax(monkeypatch):
    model = _model()
    monkeypatch.setattr(langid, "_BLOCK", 40)
    texts = ["the cat sat on the mat", "Le Chat", "der", "mixed le hund with", "é", "chat " * 300]
    named, score = model.predict(pa.array(texts))
    for text, name, s in zip(texts, named, score):
        data = np.frombuffer(text.encode(), np.uint8)
        rows = [model.table[b] for order in langid.ORDERS for b in langid.features(data, np.array([len(data)]), order).tolist() if b != langid.BUCKETS]
        mean = np.sum(rows, axis=0) / max(1, len(rows)) if rows else np.zeros(model.table.shape[1])
        z = ((mean @ model.project if model.project is not None else mean) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert name == model.languages[int(p.argmax())] and abs(s - p.max()) < 1e-5


def test_noise_and_unlearned_languages_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("lang is not null and text is not null")
    _, model = langid.identify(docs, F.col("lang").isin("en", "de") & (F.col("doc_id") % 4 != 2))
    told = docs.filter("doc_id % 4 = 2").select("text", "lang").collect()
    clean, foreign = [r.text for r in told if r.lang in ("en", "de")], [r.text for r in told if r.lang not in ("en", "de")]
    share = lambda texts: model.judged(pa.array(texts))[2].mean()
    assert share(clean) <= 2 * langid.REJECT
    assert share(foreign) >= 0.95 and share([langid.scrambled(t) for t in clean]) >= 0.95
    assert share(["Съешь же ещё этих мягких булок", "いろはにほへと ちりぬるを", "xqzv kjwq zzxq pqvk", "\u0645\u0631\u062d\u0628\u0627"]) == 1
    assert share(["The with of and", "Von.", "That it."]) == 0


def test_scrambling_keeps_letters_and_places():
    text = "Ab, cé-d 12 e"
    out = langid.scrambled(text)
    assert sorted(out) == sorted(text) and [c.isalpha() for c in out] == [c.isalpha() for c in text] and out == langid.scrambled(text)
    assert langid.scrambled("") == "" and langid.scrambled("1 2") == "1 2"
