"""Where passages stand in texts, word by word, in any text: found by seeds, counted by diagonals, then compared in full.

A passage of n words stands at a place of a text as well as its words agree with those there: likeness is the share that do. A
place of likeness ``least`` differs in at most e words, so of the n - q + 1 runs of q words at least n - q + 1 - q * e are whole
(one change breaks q of them at most). So runs of words are joined by their hash, hits are counted for each passage, text and diagonal (place in the text less
place in the passage), and only diagonals with that many hits are compared. Each passage takes the longest runs for which the bound is still one hit
or more; so nothing is lost, and no text is searched window by window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept

#: Words of a seed at most, and seeds of passages that are broadcast at most.
LONGEST, FEW_SEEDS = 4, 2_000_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _allowed(n: Column, least: float) -> Column:
    """Words that may differ."""
    return F.floor(n * F.lit(1.0 - least) + F.lit(1e-9)).cast("int")


def _seeds(rows: DataFrame, q: int) -> DataFrame:
    """at, seed of each run of q words, for rows with an array ``w``."""
    run = F.transform(F.sequence(F.lit(0), F.size("w") - q), lambda i: F.xxhash64(F.array_join(F.slice("w", i + 1, F.lit(q)), " ")))
    return rows.filter(F.size("w") >= q).select(*[c for c in rows.columns if c != "w"], F.posexplode(run).alias("at", "seed"))


def placed(passages: DataFrame, texts: DataFrame, least: float = 0.8) -> DataFrame:
    """passage, text, start (the word, from 0; negative where the passage begins before the text), n, agree, likeness of the best place of each
    of ``passages`` (passage, words: text) in each of ``texts`` (text, words: text) that holds it; ties to the first place."""
    p = passages.select("passage", words_of(F.col("words")).alias("w")).withColumn("n", F.size("w")).filter("n > 0")
    bound = lambda q: F.col("n") - F.lit(q) + 1 - F.lit(q) * _allowed(F.col("n"), least)
    own = reduce(lambda c, q: c.when(bound(q) >= 1, F.lit(q)), range(LONGEST - 1, 0, -1), F.when(bound(LONGEST) >= 1, F.lit(LONGEST)))
    p = kept(p.withColumn("q", own).withColumn("hits", reduce(lambda c, q: c.when(F.col("q") == q, bound(q)), range(2, LONGEST + 1), F.when(F.col("q") == 1, bound(1)))), "passages")
    lengths = [r["q"] for r in p.select("q").distinct().collect()]  # LONGEST rows at most
    t = texts.select("text", words_of(F.col("words")).alias("w"))
    if not lengths:
        return t.select(F.lit(None).cast(p.schema["passage"].dataType).alias("passage"), "text", F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit(0).alias("agree"), F.lit(0.0).alias("likeness")).limit(0)
    hits = []
    for q in sorted(lengths):
        asked = _seeds(p.filter(F.col("q") == q).select("passage", "hits", "w"), q).withColumnRenamed("at", "j")
        asked = kept(asked, "seeds")
        met = _seeds(t, q).join(F.broadcast(asked) if asked.count() <= FEW_SEEDS else asked, "seed")
        hits.append(met.groupBy("passage", "text", (F.col("at") - F.col("j")).alias("start")).agg(F.count("*").alias("found"), F.max("hits").alias("hits")).filter("found >= hits"))
    likely = kept(reduce(DataFrame.unionByName, hits).select("passage", "text", "start").distinct(), "diagonals")
    both = likely.join(t, "text").join(p.select("passage", "n", F.col("w").alias("pw")), "passage")
    agree = F.size(F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.coalesce(F.get("pw", j) == F.get("w", F.col("start") + j), F.lit(False))))
    found = both.withColumn("agree", agree).withColumn("likeness", F.col("agree") / F.col("n")).filter(F.col("agree") >= F.col("n") - _allowed(F.col("n"), least))
    best = Window.partitionBy("passage", "text").orderBy(F.desc("agree"), "start")
    return found.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select("passage", "text", "start", "n", "agree", "likeness")
