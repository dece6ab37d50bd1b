"""Line windows against the cleaner's own rules, and running sums against plain ones."""

import random

from pyspark.sql import functions as F

from folioforge.functions import clean
from folioforge.operators import lines, order


def _lines(spark, texts):
    return lines.lines_of(spark.createDataFrame(list(enumerate(texts)), "item_key long, document string"))


def test_stamps_are_those_of_the_cleaner(spark):
    spelled = list("arXiv:2105.01234v2")
    texts = ["\n".join(["Before", *spelled, "after"]), "\n".join([*spelled[::-1], "", " ", "x"]), "\n".join(spelled[:7]), "\n".join(["a", *spelled, "arXiv:2105.01234"]), "a\nb\nc", "", "\n".join(["", *"12arxiv:1234.5678", "", *"9arxiv:9999.00001"])]
    dropped = {(r.key, r.at) for r in lines.stamped(_lines(spark, texts)).collect()}
    for i, text in enumerate(texts):
        rows = text.split("\n")
        assert [x for at, x in enumerate(rows) if (i, at) not in dropped] == clean.without_stamps(rows), i


def test_page_edges_are_those_of_the_cleaner(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(40):
        rows = [rng.choice(["Open Access", "PNAS | May", "", "  ", "body text", "Page 3 of 9", "<!-- page break -->", "\f", "research article | x"]) for _ in range(rng.randrange(1, 40))]
        texts.append("\n".join(rows))
    boundary = (F.col("line") == "\f") | F.col("line").rlike(r"(?i)^\s*<!--\s*page\s*break\s*-->\s*$")
    found = lines.running_headers(_lines(spark, texts), boundary, "(?i)^(?:" + "|".join(clean.HEADERS) + ")")
    dropped = {(r.key, r.at) for r in found.collect()}
    for i, text in enumerate(texts):
        rows = text.split("\n")
        assert [x for at, x in enumerate(rows) if (i, at) not in dropped] == [x for x in clean.without_headers(rows) if x is not None and (x or "" in rows)] or "\f" in text, i
    assert dropped


def test_neighbourhoods_and_joining(spark):
    text = "\n".join(["banner" if i in (3, 20) else f"line {i}" for i in range(30)])
    found = lines.near(_lines(spark, [text, None]), F.col("line") == "banner")
    assert sorted(r.at for r in found.filter("near").collect()) == [*range(0, 9), *range(15, 26)]
    assert lines.joined(found.filter("not near")).first()["document"] == "\n".join([*(f"line {i}" for i in range(9, 15)), *(f"line {i}" for i in range(26, 30))])


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "a", "a", "b"]), rng.randrange(1000), rng.randrange(9)) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, o long, v long").repartition(5)
    got = sorted(((r.g, r.o, r.v, r.before) for r in order.running(df, F.col("v"), [F.col("o"), F.col("v")], ["g"]).collect()), key=str)
    want = []
    for g in {x[0] for x in rows}:
        total = 0
        for _, o, v in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])):
            want.append((g, o, v, total))
            total += v
    assert got == sorted(want, key=str)
    assert sorted(r.place for r in order.numbered(df, [F.col("o")]).collect()) == list(range(500))
    assert order.numbered(df.limit(0), [F.col("o")]).count() == 0
