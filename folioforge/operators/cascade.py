"""Keyword search of a set of queries that falls back step by step: each step takes only the queries that are still without a
result, and steps that no query needs are not run."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import folded, search_variants
from ..session import kept

#: Rows whose answers leave together.
BLOCK = 1000
YEAR = r"^(1[89]\d{2}|20\d{2})$"


def _words(query: Column) -> Column:
    return F.filter(F.split(F.trim(query), r"\s+"), lambda w: w != "")


def author_of(query: Column) -> Column:
    """The first word that is no number, else the first word."""
    words = _words(query)
    return F.coalesce(F.get(F.filter(words, lambda w: ~w.rlike(r"^\d+$")), 0), F.get(words, 0))


def author_and_year(query: Column) -> Column:
    """Of queries of more than two words: the author, and the first year if there is one."""
    words = _words(query)
    name, year = F.get(F.filter(words, lambda w: ~w.rlike(r"^\d+$")), 0), F.get(F.filter(words, lambda w: w.rlike(YEAR)), 0)
    simple = F.when(name.isNotNull() & year.isNotNull(), F.concat_ws(" ", name, year)).otherwise(F.coalesce(name, F.get(words, 0)))
    return F.when(F.size(words) > 2, simple)


def author_only(query: Column) -> Column:
    return F.when(F.size(_words(query)) >= 2, author_of(query))


#: Each step's name, what it makes of a query (null where it does not apply), and the text it looks in.
STEPS: tuple[tuple[str, Callable[[Column], Column], str], ...] = (
    ("as asked", lambda q: q, "brief"),
    ("author and year", author_and_year, "brief"),
    ("author only", author_only, "brief"),
    ("everything", lambda q: q, "whole"),
)


def _held(by_word: Mapping[str, list[tuple[int, list[str]]]]):
    """Which queries a row's text answers. by_word: of each spelling the longest word, with the query's number and all its words;
    a text is searched for a word once, and for the others of a spelling only where that one is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch, found, places = whole.slice(at, BLOCK), [], []
                for i, text in enumerate(batch.column("_text").to_pylist()):
                    hit = {q for word, asked in by_word.items() if word in text for q, words in asked if all(w in text for w in words)}
                    found += hit
                    places += [i] * len(hit)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), batch.column("item_key").take(pa.array(places, pa.int64()))], names=["_at", "item_key"])

    return run


def matched(items: DataFrame, text: Column, asked: DataFrame, limit: int) -> DataFrame:
    """query_id, item_key, rank: the first ``limit`` items, by key, whose ``text`` holds all words of any spelling of a
    query (query_id, said), accents, dashes and case aside. The queries are a stated set; an item meets all of them in one scan."""
    spelled = asked.select("query_id", F.explode(search_variants(F.col("said"))).alias("v")).select("query_id", F.array_distinct(_words(F.lower(folded(F.col("v"))))).alias("words")).filter(F.size("words") > 0).distinct()
    told: dict = {}
    for r in spelled.toLocalIterator():
        told.setdefault(r["query_id"], []).append(sorted(r["words"]))
    kind, key = asked.schema["query_id"].dataType, items.schema["item_key"].dataType
    if not told:
        return items.select(F.lit(None).cast(kind).alias("query_id"), "item_key", F.lit(0).alias("rank")).limit(0)
    ids, by_word = sorted(told), {}
    for at, q in enumerate(ids):
        for words in told[q]:
            by_word.setdefault(max(words, key=len), []).append((at, words))
    rows = items.select("item_key", F.lower(folded(F.coalesce(text, F.lit("")))).alias("_text"))
    named = items.sparkSession.createDataFrame(list(enumerate(ids)), f"_at int, query_id {kind.simpleString()}")
    every = rows.mapInArrow(_held(by_word), f"_at int, item_key {key.simpleString()}").join(F.broadcast(named), "_at")  # a stated query set
    order = Window.partitionBy("query_id").orderBy("item_key")
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("query_id", "item_key", "rank")


def cascade(items: DataFrame, queries: DataFrame, limit: int = 10, fallback: Callable[[DataFrame], DataFrame] | None = None, steps=STEPS) -> DataFrame:
    """query_id, step, said, item_key, rank of ``queries`` (query_id, text), a stated set. ``items`` has item_key, brief (title,
    creators, year) and whole. ``fallback`` gives (query_id, item_key, rank) of the queries (query_id, text) that no step answers."""
    waiting, found = kept(queries.filter(F.trim("text") != "").select("query_id", "text"), "cascade"), []
    for name, said, text in steps:
        asked = waiting.select("query_id", said(F.col("text")).alias("said")).filter("said is not null")
        got = kept(matched(items, F.col(text), asked, limit).join(F.broadcast(asked), "query_id").withColumn("step", F.lit(name)), "step")  # a stated query set
        found.append(got)
        waiting = kept(waiting.join(got.select("query_id"), "query_id", "left_anti"), "waiting")
        if waiting.isEmpty():
            break
    else:
        if fallback is not None:
            found.append(fallback(waiting).join(F.broadcast(waiting.select("query_id", F.col("text").alias("said"))), "query_id").withColumn("step", F.lit("by meaning")))
    return reduce(DataFrame.unionByName, [f.select("query_id", "step", "said", "item_key", "rank") for f in found])
