"""Search as it is asked for: filters of either branch, candidates refilled until enough are left, reranking,
enrichment, and the evaluator that runs a suite of queries under a profile."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import kept
from . import filters
from ..sources.postings import Segments
from .changes import DEFAULTS, checked_suite, profile
from .order import running
from .retrieval import Allowed, _gated, dense_topk, fuse, lexical_topk, overlap_at, select_results

# The most rows that a tool returns, and the default.
LIMITS = {"default": 100, "advanced": 500, "retractions": 500}
LEAST_DEPTH, MULTIPLIER = 100, 3


def bounded_limit(limit: int | str | None, default: int = 10, most: int = 100) -> int:
    """A limit as a number within 1 and ``most``."""
    return default if limit is None else max(1, min(int(limit), most))


# --------------------------------------------------------------------------- filters


def dense_filter(where: Mapping, schema: DataFrame) -> Column:
    """A metadata predicate with the operators that only the dense branch knows: $or, $gt, $gte, $lt, $lte."""
    if filters.supported(where):
        return filters.matches(where, schema)
    if not isinstance(where, Mapping) or len(where) != 1:
        raise ValueError(f"unsupported filter: {where}")
    ((key, value),) = where.items()
    if key in ("$and", "$or") and isinstance(value, list) and len(value) >= 2:
        return reduce((lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b), [dense_filter(w, schema) for w in value])
    compare = {"$gt": Column.__gt__, "$gte": Column.__ge__, "$lt": Column.__lt__, "$lte": Column.__le__}
    if not key.startswith("$") and isinstance(value, Mapping) and len(value) == 1:
        ((op, operand),) = value.items()
        if op in compare and isinstance(operand, (int, float)) and not isinstance(operand, bool):
            if dict(schema.dtypes).get(key) in ("int", "bigint", "double", "float", "smallint", "tinyint"):
                return F.coalesce(compare[op](F.col(key), F.lit(operand)), F.lit(False))
            return F.lit(False)
    raise ValueError(f"unsupported filter: {where}")


def document_filter(where: Mapping, document: Column) -> Column:
    """$contains and $not_contains over a document's text, joined by $and and $or."""
    ((op, value),) = where.items()
    if op in ("$and", "$or"):
        return reduce((lambda a, b: a & b) if op == "$and" else (lambda a, b: a | b), [document_filter(w, document) for w in value])
    if op not in ("$contains", "$not_contains"):
        raise ValueError(f"unsupported filter: {where}")
    holds = F.coalesce(document.contains(value), F.lit(False))
    return holds if op == "$contains" else ~holds


# --------------------------------------------------------------------------- search


def search(docs: DataFrame, index: DataFrame, queries: DataFrame, vectors: DataFrame, limit: int = 10, config: Mapping | None = None, where: Mapping | None = None, where_document: Mapping | None = None, rerank: Callable[[DataFrame], DataFrame] | None = None, metric: str = "l2", allowed: Allowed | None = None, postings: Segments | None = None, shared: dict | None = None) -> DataFrame:
    """query_id, rank, item_key, aliases, depth of a stated query set. ``docs`` has item_key, title, doi,
    document; ``index`` item_key, embedding and what ``where`` names; ``queries`` query_id, text; ``vectors`` query_id,
    qv. The candidates' depth doubles for the queries that have too few rows left, until they have enough, or
    all rows were candidates. Where the filter is one that the lexical branch does not know, it is left out. ``allowed`` says what
    single queries may find, in both branches; with ``postings``, a kept index, documents are read for titles only. Searches that differ in their
    ``config`` alone may have one ``shared``: candidates of either branch and titles that one of them made, the others take from it."""
    settings = DEFAULTS | dict(config or {})
    if settings["mode"] not in ("dense", "hybrid"):
        raise ValueError("the mode is dense or hybrid")
    lexical = settings["mode"] == "hybrid" and (where is None or filters.supported(where))
    passed = dense_filter(where, index) if where is not None else None
    rows = index.filter(passed) if passed is not None else index
    if where_document is not None:
        rows = rows.join(docs.filter(document_filter(where_document, F.col("document"))).select("item_key"), "item_key", "left_semi")
    once = _once({} if shared is None else shared)
    count = once(("count",), index.count)
    pool = limit * MULTIPLIER if rerank else limit
    depth, waiting, done = min(max(LEAST_DEPTH, pool), count), [r["query_id"] for r in queries.select("query_id").collect()], []  # a stated query set
    while waiting and count:
        asked, asked_vectors = queries.filter(F.col("query_id").isin(waiting)), vectors.filter(F.col("query_id").isin(waiting))
        these = depth, tuple(waiting)
        dense = once(("dense", *these), lambda: kept(dense_topk(rows, asked_vectors, depth, metric, allowed=allowed), "dense"))
        found, reached = dense.withColumnRenamed("score", "exact").withColumn("lexical_rank", F.lit(None).cast("int")), dense.groupBy("query_id").agg(F.count("*").alias("n_dense"))
        counts = {r["query_id"]: [r["n_dense"], depth] for r in reached.collect()}
        if lexical:
            eligible = rows.select("item_key") if passed is not None or where_document is not None else None
            words = once(("words", settings["title_weight"], *these), lambda: kept(lexical_topk(docs, asked, depth, settings["title_weight"], eligible, postings, allowed), "lexical"))
            counts = {q: [counts.get(q, [0, 0])[0], 0] for q in waiting}
            for r in words.groupBy("query_id").count().collect():
                counts[r["query_id"]][1] = r["count"]
            found = fuse(dense, words, settings["weights"]["dense"], settings["weights"]["lex"], settings["k"])
        titles = docs.select("item_key", "title", "doi")
        if shared is not None:  # of the rows that either branch found, which are the queries times a depth
            both = [dense, words] if lexical else [dense]
            keys = reduce(DataFrame.unionByName, [b.select("item_key") for b in both]).distinct()
            name = ("titles", settings["title_weight"] if lexical else None, *these)
            titles = once(name, lambda: kept(titles.join(F.broadcast(keys), "item_key", "left_semi"), "titles"))  # noqa: B023  called at once
        described = titles.join(F.broadcast(found), "item_key")  # the queries times a depth
        if lexical and settings["gate"]:
            described = _gated(described, asked, settings["k"], settings["gate_min_tokens"], settings["gate_threshold"])
        chosen = kept(select_results(described, pool, settings["noise_policy"], settings["collapse"]).withColumn("depth", F.lit(depth)), "chosen")
        filled = {r["query_id"]: r["count"] for r in chosen.groupBy("query_id").count().collect()}
        over = [q for q in waiting if filled.get(q, 0) >= pool or depth >= count or (counts.get(q, [0, 0])[0] < depth and (not lexical or counts[q][1] < depth))]
        done.append(chosen.filter(F.col("query_id").isin(over or [None])))
        waiting, depth = [q for q in waiting if q not in set(over)], min(count, depth * 2)
    if not done:
        return docs.sparkSession.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, rank int, item_key {index.schema['item_key'].dataType.simpleString()}, aliases array<{index.schema['item_key'].dataType.simpleString()}>, depth int")
    out = reduce(DataFrame.unionByName, done)
    return reranked(out, rerank(out), limit) if rerank else out


def _once(held: dict) -> Callable:
    """What is asked for by a key is made once."""

    def get(key: tuple, make: Callable):
        if key not in held:
            held[key] = make()
        return held[key]

    return get


def reranked(found: DataFrame, scores: DataFrame, limit: int) -> DataFrame:
    """``found`` in the order of ``scores`` (query_id, item_key, rerank_score), the best first, ties as they were."""
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    rows = found.join(scores.select("query_id", "item_key", "rerank_score"), ["query_id", "item_key"])
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select(*found.columns)


def enriched(found: DataFrame, items: DataFrame, queries: DataFrame) -> DataFrame:
    """``found`` with the query's text, the item's fields as ``item``, and an error where the library has no such item."""
    fields = [c for c in items.columns if c != "item_key"]
    rows = items.select("item_key", F.struct(*fields).alias("item"), F.lit(True).alias("_there")).join(F.broadcast(found), "item_key", "right")
    told = rows.join(F.broadcast(queries.select("query_id", F.col("text").alias("query"))), "query_id", "left")
    error = F.when(F.col("_there").isNull(), F.concat(F.lit("Could not fetch full item data: "), F.col("item_key").cast("string")))
    return told.withColumn("error", error).drop("_there")


def enriched_share(found: DataFrame) -> DataFrame:
    """``k/n items``: how many have an item."""
    return found.agg(F.concat(F.count_if(F.col("error").isNull()).cast("string"), F.lit("/"), F.count("*").cast("string"), F.lit(" items")).alias("enriched"))


# --------------------------------------------------------------------------- the evaluator


def evaluate(suite: DataFrame, docs: DataFrame, index: DataFrame, vectors: DataFrame, name: str, k: int = 100, overrides: Mapping | None = None, skip_missing: bool = False, partition: str | None = None, postings: Segments | None = None, shared: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Rankings (query_id, system, rank, item_key) of a suite's queries under a profile, each over its eligible
    items, and per query the overlap of its ten best with the exact cosine order. A query without a vector fails,
    or is left out. All queries are ranked together: candidates and exclusions travel with them, and each depth is one scan.
    Profiles of one suite and partition over the same rows may have one ``shared``: what they have in common is made once."""
    if not 1 <= k <= 100:
        raise ValueError("k is within 1 and 100")
    settings, rows = profile(name, overrides), checked_suite(suite)
    if partition is not None:
        rows = rows.filter(F.col("partition") == partition)
    once = _once({} if shared is None else shared)
    missing = once(("missing",), lambda: [r["query_id"] for r in rows.join(vectors, "query_id", "left_anti").select("query_id").collect()])  # a stated query set
    if missing and not skip_missing:
        raise ValueError(f"no vector for {', '.join(map(str, missing))}")
    rows = rows.filter(~F.col("query_id").isin(missing)) if missing else rows
    allowed, asked = once(("allowed",), lambda: Allowed.of(rows)), rows.select("query_id", "text")
    mine = vectors.join(F.broadcast(asked.select("query_id")), "query_id", "left_semi")  # a stated query set
    found = search(docs, index, asked, mine, k, settings, allowed=allowed, postings=postings, shared=shared)
    exact = dense_topk(index, mine, 10, "cosine", allowed=allowed)
    held = overlap_at(exact if shared is None else once(("exact",), lambda: kept(exact, "exact")), found, 10)
    overlaps = rows.select("query_id").join(held, "query_id", "left").select("query_id", F.coalesce("overlap", F.lit(1.0)).alias("overlap"))
    return found.select("query_id", F.lit(name).alias("system"), "rank", "item_key"), overlaps


def write_rankings(rankings: DataFrame, overlaps: DataFrame, folder: str, settings: Mapping) -> dict:
    """One JSON line a query, and a manifest beside them, which is returned."""
    spark: SparkSession = rankings.sparkSession
    lines = rankings.groupBy("query_id", "system").agg(F.array_sort(F.collect_list(F.struct("rank", "item_key"))).alias("ranking"))
    lines.write.json(f"{folder}/rankings")
    told = overlaps.agg(F.count("*").alias("n"), F.avg("overlap").alias("o")).first()  # one row
    manifest = {"query_count": told["n"], "ann_vs_exact_overlap_at_10": told["o"], "params": dict(settings)}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{folder}/manifest")
    return manifest


def query_costs(suite: DataFrame, cached: DataFrame, price: float) -> DataFrame:
    """text, estimated_tokens, cost of each distinct text that no vector is cached for (key: SHA-256 of the text)."""
    texts = suite.select("text").distinct().withColumn("key", F.sha2("text", 256)).join(cached.select("key").distinct(), "key", "left_anti")
    tokens = F.octet_length("text") + 32
    return texts.select("text", tokens.alias("estimated_tokens"), (tokens * F.lit(price) / F.lit(1e6)).alias("cost"))


# --------------------------------------------------------------------------- paged sources


class Incomplete(ValueError):
    """A paged source does not hold what it says it holds."""


def frozen_pages(pages: DataFrame, page_size: int, max_pages: int) -> DataFrame:
    """The rows of captured pages (page, total, version, rows: array of structs with a key), if they are whole: one total and one
    version, pages from 0 without gaps, each full but the last, as many rows as stated, no key twice."""
    told = pages.agg(F.count("*").alias("n"), F.count_distinct("page").alias("pages"), F.min("page").alias("lo"), F.max("page").alias("hi"), F.count_distinct("total").alias("totals"), F.max("total").alias("total"), F.count_distinct("version").alias("versions"), F.coalesce(F.sum(F.size("rows")), F.lit(0)).alias("rows")).first()  # one row
    if not told["n"]:
        raise Incomplete("no page was read")
    if told["n"] > max_pages:
        raise Incomplete(f"more than {max_pages} pages")
    if told["totals"] != 1 or told["versions"] > 1:
        raise Incomplete("the source changed while it was read")
    if told["pages"] != told["n"] or told["lo"] != 0 or told["hi"] != told["n"] - 1:
        raise Incomplete("pages are missing or repeated")
    if told["rows"] != told["total"] or not pages.filter((F.size("rows") != page_size) & (F.col("page") != told["hi"])).isEmpty():
        raise Incomplete(f"{told['rows']} of {told['total']} rows")
    out = pages.select(F.explode("rows").alias("r")).select("r.*")
    if not out.groupBy("key").count().filter((F.col("count") > 1) | F.col("key").isNull()).isEmpty():
        raise Incomplete("a key is repeated or missing")
    return out


def capped_pages(pages: DataFrame, cap: int | None) -> DataFrame:
    """Rows of pages in order; reading stops after the first page that reaches the cap, and the rest is cut."""
    if cap is None:
        return pages.select(F.explode("rows").alias("r")).select("r.*")
    read = running(pages.select("page", "rows"), F.size("rows"), [F.col("page")]).filter(F.col("before") < cap)
    return read.select("before", F.posexplode("rows").alias("at", "r")).filter(F.col("before") + F.col("at") < cap).select("r.*")


def checked_records(ids: Sequence, *columns: Sequence) -> None:
    """Parallel arrays of one response have to be of one length."""
    if any(len(c) != len(ids) for c in columns):
        raise Incomplete("parallel arrays differ in length")
