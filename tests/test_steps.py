"""The keyword cascade step by step, and passages against a plain scan of every place."""

import random
import re

from pyspark.sql import functions as F

from folioforge.operators import cascade, passages


def test_each_step_takes_what_is_left(spark, monkeypatch):
    items = spark.createDataFrame([(1, "Étude des hérons Müller 2019", "le lac et la rive"), (2, "Cranes Smith 2020", "wetland notes"), (3, "Nests Smith 2021", "straße am see")], "item_key long, brief string, whole string")
    asked = [(1, "muller 2019"), (2, "smith 2021 anything else"), (3, "Smith nothing"), (4, "strasse see"), (5, "nobody knows"), (6, "  "), (7, "hérons"), (8, "2020 smith zzz")]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    told = lambda found: sorted((r.query_id, r.step, r.item_key) for r in found.collect())
    want = [(1, "as asked", 1), (2, "author and year", 3), (3, "author only", 2), (3, "author only", 3), (4, "everything", 3), (7, "as asked", 1), (8, "author and year", 2)]
    assert told(cascade.cascade(items, queries)) == want
    fallback = lambda left: left.select("query_id", F.lit(2).cast("long").alias("item_key"), F.lit(1).alias("rank"))
    assert told(cascade.cascade(items, queries, fallback=fallback)) == sorted([*want, (5, "by meaning", 2)])
    ran = []
    real = cascade.matched
    monkeypatch.setattr(cascade, "matched", lambda *a: ran.append(1) or real(*a))
    cascade.cascade(items, queries.filter("query_id in (1, 7)"))
    assert len(ran) == 1  # no later step is run where none is left
    monkeypatch.setattr(cascade, "BLOCK", 2)
    assert told(cascade.cascade(items, queries, limit=1)) == [x for x in want if x != (3, "author only", 3)]


def test_all_queries_meet_the_items_in_one_scan(spark):
    """Hundreds of queries neither read the items again nor name their words in the plan."""
    items = spark.createDataFrame([(i, f"Paper {i} näher 20{i % 100:02d}") for i in range(300)], "item_key long, brief string")
    asked = spark.createDataFrame([(f"q{i}", f"paper {i} naher") for i in range(250)], "query_id string, said string")
    got = cascade.matched(items, F.col("brief"), asked, 3)
    plan = got._jdf.queryExecution().toString()
    assert plan.count("item_key#") and "naher" not in plan and "Union" not in plan
    said = {f"q{i}": ["paper", str(i), "naher"] for i in range(250)}
    texts = [(k, f"paper {k} naher 20{k % 100:02d}") for k in range(300)]
    want = {(q, k, r + 1) for q, words in said.items() for r, k in enumerate([k for k, t in texts if all(w in t for w in words)][:3])}
    assert {(r.query_id, r.item_key, r.rank) for r in got.collect()} == want


def _plain(needle, text, least):
    words = lambda s: re.findall(r"[^\W_]+", (s or "").lower())
    p, t = words(needle), words(text)
    best = None
    for start in range(-len(p) + 1, len(t)):
        agree = sum(0 <= start + j < len(t) and t[start + j] == w for j, w in enumerate(p))
        if p and agree >= len(p) - int(len(p) * (1 - least) + 1e-9) and (best is None or agree > best[1]):
            best = (start, agree)
    return best


def test_passages_are_placed_as_by_a_plain_scan(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(30)] + ["é", "Straße"]
    texts = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 80)))) for i in range(25)] + [(90, None), (91, "")]
    asked = [(100, None), (101, ""), (102, "w1"), (103, "w1 w2"), (104, "never there at all")]
    for i in range(30):
        source = rng.choice(texts[:25])[1].split()
        if len(source) > 3:
            at, n = rng.randrange(len(source)), rng.randrange(1, 30)
            cut = source[at : at + n]
            for _ in range(rng.randrange(0, 1 + len(cut) // 4)):
                cut[rng.randrange(len(cut))] = "changed"
            asked.append((i, ("before " if i % 7 == 0 else "") + " ".join(cut)))
    p = spark.createDataFrame(asked, "passage long, words string")
    t = spark.createDataFrame(texts, "text long, words string")
    for least in (0.8, 1.0, 0.65):
        got = {(r.passage, r.text): (r.start, r.agree) for r in passages.placed(p, t, least).collect()}
        want = {(a, b): found for a, x in asked for b, y in texts if (found := _plain(x, y, least))}
        assert got == want, least
    assert passages.placed(p.limit(0), t).count() == 0 and passages.placed(p, t.limit(0)).count() == 0
