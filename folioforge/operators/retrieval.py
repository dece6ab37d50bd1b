"""Dense, lexical and hybrid retrieval: scoring, weighted rank fusion, title gate, noise, collapse.

Query sets are stated and small; they travel as matrices of at most MAX_QUERIES rows or as broadcasts, and
everything else stays distributed: persisted postings are read for the queries' terms only, a batch of vectors
gives its best rows, scores are cut to a depth before fusion, and titles are joined only to what is left.
Ranks follow scores in full precision; scores are rounded where they are returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.text import normalized_doi, normalized_title
from ..functions.tokens import tokens, without_marks, words
from ..functions.vectors import doubles
from ..sources.postings import Postings, Segments
from ..sources.vectors import VectorIndex

MAX_QUERIES = 1000
METRICS = ("l2", "cosine", "ip")
K1, B, FLOOR = 1.2, 0.75, 1e-6


@dataclass(frozen=True)
class Allowed:
    """What each query of a stated set may find: its candidates (None: all), less its exclusions. Queries that are not named may find all."""

    candidates: Mapping[object, frozenset | None]
    excluded: Mapping[object, frozenset]

    @classmethod
    def of(cls, suite: DataFrame) -> Allowed:
        """Of ``suite`` (query_id, candidate_ids, exclude_ids), a stated set."""
        rows = suite.select("query_id", "candidate_ids", "exclude_ids").collect()
        return cls({r["query_id"]: None if r["candidate_ids"] is None else frozenset(r["candidate_ids"]) for r in rows}, {r["query_id"]: frozenset(r["exclude_ids"] or []) for r in rows})

    def mask(self, query: object, names: pa.Array) -> np.ndarray | None:
        """Of keys as text, which the query may find; None: all."""
        only, out = self.candidates.get(query), self.excluded.get(query) or frozenset()
        if only is None and not out:
            return None
        inside = lambda some: pc.is_in(names, value_set=pa.array(sorted(map(str, some)), pa.string())).to_numpy(zero_copy_only=False)
        may = inside(only) if only is not None else np.ones(len(names), bool)
        return may & ~inside(out) if out else may


def _best(ids: list, asked: np.ndarray, k: int, metric: str, allowed: Allowed | None = None):
    """(query_id, item_key, exact): of each batch the k best for each query, ties to the smaller key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norms = np.sqrt((asked * asked).sum(1))
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("v")))
            if not batch.num_rows:
                continue
            keys = batch.column("item_key").to_numpy(zero_copy_only=False)
            m = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(keys), -1)
            if m.shape[1] != asked.shape[1]:
                raise ValueError(f"vectors of {m.shape[1]} and of {asked.shape[1]} components")
            own = np.sqrt((m * m).sum(1)) if metric == "cosine" else None
            names = batch.column("item_key").cast(pa.string()) if allowed else None
            out_q, out_i, out_s = [], [], []
            for i, q in enumerate(asked):
                if metric == "l2":
                    score = 1.0 - ((m - q) ** 2).sum(1)
                else:
                    score = (m * q).sum(1)
                    if own is not None:
                        score /= np.maximum(own * norms[i], 1e-30)
                score = np.where(np.isnan(score), -np.inf, score)
                rows = allowed.mask(ids[i], names) if allowed else None
                near = np.arange(len(score)) if rows is None else np.flatnonzero(rows)
                if len(near) > k:
                    near = near[score[near] >= np.partition(score[near], -k)[-k]]
                near = near[np.lexsort((keys[near], -score[near]))][:k]
                out_q += [ids[i]] * len(near)
                out_i.append(near)
                out_s.append(score[near])
            yield pa.RecordBatch.from_arrays([pa.array(out_q), batch.column("item_key").take(pa.array(np.concatenate(out_i))), pa.array(np.concatenate(out_s))], names=["query_id", "item_key", "exact"])

    return run


def dense_topk(index: DataFrame, queries: DataFrame, k: int = 10, metric: str = "l2", where: Column | None = None, allowed: Allowed | None = None) -> DataFrame:
    """query_id, item_key, score, rank: the k best rows of ``index`` (item_key, embedding, ...) that pass, and that
    ``allowed`` lets a query find, for each of ``queries`` (query_id, qv), a stated set. MAX_QUERIES of them meet a batch as one matrix,
    and k rows a query leave a batch, so the index itself is never shuffled."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    rows = (index.filter(where) if where is not None else index).select("item_key", doubles(F.col("embedding")).alias("v"))
    kinds = queries.schema["query_id"].dataType.simpleString(), rows.schema["item_key"].dataType.simpleString()
    schema = f"query_id {kinds[0]}, item_key {kinds[1]}, exact double"
    asked = [(r["query_id"], r["qv"]) for r in queries.select("query_id", doubles(F.col("qv")).alias("qv")).toLocalIterator()]
    blocks = [asked[at : at + MAX_QUERIES] for at in range(0, len(asked), MAX_QUERIES)]
    scans = [rows.mapInArrow(_best([q for q, _ in b], np.array([v for _, v in b], float), k, metric, allowed), schema) for b in blocks]
    found = reduce(DataFrame.unionByName, scans) if scans else rows.sparkSession.createDataFrame([], schema)
    return _rounded(ranked(found, k))


def ranked(scores: DataFrame, depth: int) -> DataFrame:
    """Adds rank by ``exact`` (not rounded), ties to the smaller key; the best ``depth`` of each query."""
    best = Window.partitionBy("query_id").orderBy(F.desc("exact"), "item_key")
    return scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= depth)


def _rounded(found: DataFrame, digits: int = 6) -> DataFrame:
    return found.select("query_id", "item_key", (F.round("exact", digits) + F.lit(0.0)).alias("score"), "rank")


def bm25(docs: DataFrame | None, queries: DataFrame, title_weight: float = 3.0, eligible: DataFrame | None = None, postings: Postings | Segments | None = None, k: int | None = None, allowed: Allowed | None = None) -> DataFrame:
    """query_id, item_key, score, exact; ``docs`` has item_key, title, document, ``queries`` has query_id,
    text, a stated set. Any query token matches. ``eligible`` (item_key) filters before any limit, not the
    statistics. With ``postings``, a kept index, ``docs`` are not read. Postings of the queries' terms are dealt by item, so each item is scored in one place for all
    queries, in the order of terms; with ``k``, only rows that can be among a query's k best leave it."""
    held = postings or Postings.of(docs)
    wanted: dict[str, set[int]] = {}
    ids = []
    for r in queries.select("query_id", "text").toLocalIterator():
        for t in words(r["text"]):
            wanted.setdefault(without_marks(t), set()).add(len(ids))
        ids.append(r["query_id"])
    found = held.frequencies([t for t in wanted if t])
    terms = sorted(found)
    ratio = {t: math.log((held.documents - n + 0.5) / (n + 0.5)) for t, n in found.items()}
    told = [(t, i, ratio[t] if ratio[t] > 0 else FLOOR) for i, t in enumerate(terms)]
    weights = F.broadcast(queries.sparkSession.createDataFrame(told, "t string, term int, idf double"))
    tf = held.of_terms(terms).withColumn("f", F.col("ft") * F.lit(float(title_weight)) + F.col("fd"))
    if eligible is not None:
        tf = tf.join(eligible.select("item_key").distinct(), "item_key", "left_semi")
    part = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("l") / F.lit(held.average)))
    parts = tf.join(weights, "t").select("item_key", "term", part.alias("part"))
    # Dealt by a hash: a join by item before it would stand in for an exchange by item, and may itself become a broadcast that reads as rows lie.
    parts = parts.repartition(F.xxhash64("item_key")).sortWithinPartitions("item_key", "term")
    kinds = queries.schema["query_id"].dataType.simpleString(), parts.schema["item_key"].dataType.simpleString()
    asked = [sorted(wanted[t]) for t in terms]
    scored = parts.mapInArrow(_summed(ids, asked, k, allowed), f"query_id {kinds[0]}, item_key {kinds[1]}, exact double")
    return scored.withColumn("score", F.round("exact", 6))


def _summed(ids: list, asked: list[list[int]], k: int | None, allowed: Allowed | None = None, rows: int = 20_000):
    """(query_id, item_key, exact) of rows (item_key, term, part) that come sorted by item and term; with ``k``, a task's k best of each
    query, which it holds until its last row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.cumsum([0, *map(len, asked)])
        queries = np.array([q for a in asked for q in a], np.int64)

        def best(q: np.ndarray, total: np.ndarray) -> np.ndarray:
            order = np.lexsort((np.arange(len(q)), -total, q))  # of a query, rows come by key
            place = np.arange(len(order)) - np.searchsorted(q[order], q[order])
            return np.sort(order[place < k])

        def scored(table: pa.Table) -> tuple[np.ndarray, pa.Array, np.ndarray]:
            keys = table.column("item_key").to_numpy()
            term, part = table.column("term").to_numpy(), table.column("part").to_numpy()
            new = np.r_[True, keys[1:] != keys[:-1]]
            item, starts = np.cumsum(new) - 1, np.flatnonzero(new)
            n = first[term + 1] - first[term]
            row = np.repeat(np.arange(len(term)), n)
            q = queries[np.repeat(first[term], n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)]
            code, at = np.unique(q * len(starts) + item[row], return_inverse=True)
            total = np.bincount(at, part[row])  # adds in row order
            q, item = code // len(starts), code % len(starts)
            if allowed:
                keep = np.ones(len(q), bool)
                for one in np.unique(q).tolist():
                    mine = np.flatnonzero(q == one)
                    if (may := allowed.mask(ids[one], table.column("item_key").take(pa.array(starts[item[mine]])).cast(pa.string()).combine_chunks())) is not None:
                        keep[mine] = may
                q, item, total = q[keep], item[keep], total[keep]
            if k is not None:
                keep = best(q, total)
                q, item, total = q[keep], item[keep], total[keep]
            return q, table.column("item_key").take(pa.array(starts[item])).combine_chunks(), total

        def told(q: np.ndarray, chosen: pa.Array, total: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([ids[i] for i in q.tolist()]), chosen, pa.array(total)], names=["query_id", "item_key", "exact"])

        def merged(a, b):
            if a is None:
                return b
            q, total = np.r_[a[0], b[0]], np.r_[a[2], b[2]]
            keep = best(q, total)
            return q[keep], pa.concat_arrays([a[1], b[1]]).take(pa.array(keep)), total[keep]

        held: list[pa.Table] = []
        top = None
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(t.num_rows for t in held) >= rows:
                table = pa.concat_tables(held).combine_chunks()
                keys = table.column("item_key").to_numpy()
                cut = int(np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])[-1])  # the last item may go on
                if cut:
                    found = scored(table.slice(0, cut))
                    if k is None:
                        yield told(*found)
                    else:
                        top = merged(top, found)
                held = [table.slice(cut)]
        if held and sum(t.num_rows for t in held):
            found = scored(pa.concat_tables(held).combine_chunks())
            top = found if k is None else merged(top, found)
        if top is not None and len(top[0]):
            yield told(*top)

    return run


def lexical_topk(docs: DataFrame | None, queries: DataFrame, k: int = 10, title_weight: float = 3.0, eligible: DataFrame | None = None, postings: Postings | Segments | None = None, allowed: Allowed | None = None) -> DataFrame:
    return ranked(bm25(docs, queries, title_weight, eligible, postings, k, allowed), k).select("query_id", "item_key", "score", "rank")


def fuse(dense: DataFrame, lexical: DataFrame, w_dense: float = 1.0, w_lexical: float = 0.5, k: int = 60) -> DataFrame:
    """Weighted reciprocal ranks of two ranked branches (query_id, item_key, rank): score (rounded), exact,
    lexical_rank, rank. Ties keep dense order, then lexical order; of a key's repeats in a branch the first counts."""
    if w_dense < 0 or w_lexical < 0 or k < 0:
        raise ValueError("weights and k are not negative")
    both = dense.select("query_id", "item_key", F.lit(0).alias("branch"), "rank", F.lit(float(w_dense)).alias("w"))
    both = both.unionByName(lexical.select("query_id", "item_key", F.lit(1).alias("branch"), "rank", F.lit(float(w_lexical)).alias("w")))
    first = both.groupBy("query_id", "item_key", "branch", "w").agg(F.min("rank").alias("rank"))
    out = first.groupBy("query_id", "item_key").agg(F.sum(F.col("w") / (F.col("rank") + k)).alias("exact"), F.min(F.struct("branch", "rank")).alias("first"), F.min(F.when(F.col("branch") == 1, F.col("rank"))).alias("lexical_rank"))
    order = Window.partitionBy("query_id").orderBy(F.desc("exact"), "first.branch", "first.rank", "item_key")
    return out.select("query_id", "item_key", F.round("exact", 9).alias("score"), "exact", "lexical_rank", F.row_number().over(order).alias("rank"))


def gate(fused: DataFrame, titles: DataFrame, queries: DataFrame, k: int = 60, least: int = 3, share: float = 0.8) -> DataFrame:
    """``fused`` with gated: the best lexical hit goes first if it shares ``least`` tokens with the query and
    ``share`` of its title's. ``titles`` has item_key, title; columns of it stay."""
    return _gated(titles.join(F.broadcast(fused), "item_key", "right"), queries, k, least, share)  # the queries times a depth


def _gated(rows: DataFrame, queries: DataFrame, k: int, least: int, share: float) -> DataFrame:
    rows = rows.join(F.broadcast(queries.select("query_id", "text")), "query_id", "left")
    own = F.array_distinct(tokens(F.col("title")))
    shared = F.size(F.array_intersect(own, tokens(F.col("text"))))
    hit = (F.col("lexical_rank") == 1) & (shared >= least) & (shared / F.size(own) >= share)
    out = rows.withColumn("gated", F.coalesce(hit, F.lit(False))).withColumn("top", F.max("exact").over(Window.partitionBy("query_id")))
    out = out.withColumn("exact", F.when(F.col("gated"), F.col("top") + F.lit(1.0 / (k + 1))).otherwise(F.col("exact"))).withColumn("score", F.round("exact", 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("gated"), "rank")
    return out.withColumn("rank", F.row_number().over(order)).drop("top", "text", "lexical_rank")


def is_web_clip(title: Column) -> Column:
    return F.coalesce(title, F.lit("")).rlike(r"(?i)^\s*proquest:")


def noise(results: DataFrame, policy: str = "keep") -> DataFrame:
    """``results`` (query_id, item_key, title, rank): web clips kept, put last, or left out."""
    if policy == "exclude":
        results = results.filter(~is_web_clip(F.col("title")))
    elif policy not in ("keep", "demote"):
        raise ValueError(f"unknown policy: {policy}")
    keys = [is_web_clip(F.col("title"))] if policy == "demote" else []
    return results.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*keys, "rank")))


def collapse(results: DataFrame, limit: int) -> DataFrame:
    """One row for each work: by DOI, or by title where the title's results name at most one DOI; empty
    titles stand alone. The best ranked stays, the others become its aliases. No transitive closure."""
    r = results.withColumn("_doi", F.nullif(normalized_doi(F.coalesce("doi", F.lit(""))), F.lit(""))).withColumn("_title", normalized_title(F.coalesce("title", F.lit(""))))
    by_title = Window.partitionBy("query_id", "_title")
    r = r.withColumn("_n", F.size(F.collect_set("_doi").over(by_title))).withColumn("_one", F.min("_doi").over(by_title))
    identity = (
        F.when(F.col("_doi").isNotNull(), F.concat(F.lit("doi:"), "_doi"))
        .when(F.col("_title") == "", F.concat(F.lit("key:"), F.col("item_key").cast("string")))
        .when(F.col("_n") == 1, F.concat(F.lit("doi:"), "_one"))
        .otherwise(F.concat(F.lit("title:"), "_title"))
    )
    grouped = r.withColumn("_id", identity).groupBy("query_id", "_id").agg(F.sort_array(F.collect_list(F.struct("rank", "item_key"))).alias("g"))
    out = grouped.select("query_id", F.col("g")[0]["rank"].alias("first"), F.col("g")[0]["item_key"].alias("item_key"), F.transform(F.slice("g", F.lit(2), F.greatest(F.size("g") - 1, F.lit(0))), lambda x: x["item_key"]).alias("aliases"))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("first")))
    return out.filter(F.col("rank") <= limit).drop("first")


def hybrid_search(docs: DataFrame | None, index: DataFrame, queries: DataFrame, vectors: DataFrame, limit: int = 10, depth: int = 100, w_dense: float = 1.0, w_lexical: float = 0.5, k: int = 60, use_gate: bool = True, policy: str = "keep", do_collapse: bool = True, title_weight: float = 3.0, where: Column | None = None, postings: Segments | None = None) -> DataFrame:
    """query_id, rank, item_key, aliases. ``docs`` has item_key, title, doi, document; ``index`` has
    item_key, embedding; ``queries`` has query_id, text. ``where`` filters ``index`` in both branches. With
    ``postings``, a kept index, documents are not read: it has their words and titles."""
    eligible = index.filter(where).select("item_key") if where is not None else None
    dense = dense_topk(index, vectors, depth, "l2", where)
    lexical = lexical_topk(docs, queries, depth, title_weight, eligible, postings)
    fused = fuse(dense, lexical, w_dense, w_lexical, k)
    titles = postings.titles() if postings else docs.select("item_key", "title", "doi")
    rows = titles.join(F.broadcast(fused), "item_key")  # the queries times a depth
    return select_results(_gated(rows, queries, k, 3, 0.8) if use_gate else rows, limit, policy, do_collapse)


def hybrid_over(lexicon: Segments, vectors: VectorIndex, queries: DataFrame, asked: DataFrame, limit: int = 10, depth: int = 100, w_dense: float = 1.0, w_lexical: float = 0.5, k: int = 60, use_gate: bool = True, policy: str = "keep", do_collapse: bool = True, title_weight: float = 3.0, exact: bool = False, probes: int | None = None) -> DataFrame:
    """``hybrid_search`` over kept indexes: query_id, rank, item_key, aliases of ``queries`` (query_id, text) and ``asked``
    (query_id, qv). Neither documents nor all vectors are read: postings of the queries' terms, lists near their
    vectors, and titles of what is fused."""
    fused = fuse(vectors.search(asked, depth, probes, exact), lexical_topk(None, queries, depth, title_weight, postings=lexicon), w_dense, w_lexical, k)
    rows = lexicon.titles().join(F.broadcast(fused), "item_key")  # the queries times a depth
    return select_results(_gated(rows, queries, k, 3, 0.8) if use_gate else rows, limit, policy, do_collapse)


def select_results(found: DataFrame, limit: int, policy: str = "keep", do_collapse: bool = False) -> DataFrame:
    """query_id, rank, item_key, aliases of ranked rows (query_id, item_key, title, doi, rank), after the noise
    policy, collapsed or cut."""
    kept = noise(found, policy)
    if do_collapse:
        return collapse(kept, limit).select("query_id", "rank", "item_key", "aliases")
    none = F.array().cast(ArrayType(found.schema["item_key"].dataType))
    return kept.filter(F.col("rank") <= limit).select("query_id", "rank", "item_key", none.alias("aliases"))


def overlap_at(exact: DataFrame, found: DataFrame, k: int = 10) -> DataFrame:
    """query_id, overlap: the share of the exact best k that ``found`` has among its own k; 1 if none is exact."""
    none = F.array().cast(ArrayType(found.schema["item_key"].dataType))
    a = exact.filter(F.col("rank") <= k).groupBy("query_id").agg(F.collect_set("item_key").alias("a"))
    b = found.filter(F.col("rank") <= k).groupBy("query_id").agg(F.collect_set("item_key").alias("b"))
    both = F.size(F.array_intersect("a", F.coalesce("b", none)))
    return a.join(b, "query_id", "left").select("query_id", F.when(F.size("a") == 0, 1.0).otherwise(both / F.size("a")).alias("overlap"))
