"""Exact top-k inner products by norm buckets.

Vectors are ranged by length into buckets of BUCKET rows, each packed into one matrix. Queries, packed
in blocks, meet the buckets in two rounds. The first scores every query against a fixed sample bucket
(the longest vectors); its k-th best score bounds the query's final k-th best from below. In the
second, each (block, bucket) pair turns that bound into a local cosine threshold: bound over (query
length x longest length in the bucket). Above 1 the query skips the bucket. Otherwise it prunes by
coordinate, where the threshold is high enough for the feasible interval of the query's strongest
coordinates to be narrow, or by length, reading only the prefix of vectors long enough. What survives
is verified by its integer products.

The pairs are a stated query set against all rows, in blocks: each block and bucket is a row that
holds a matrix of bounded size, and results are cut to k a query before they are shuffled.

Defined cases: vectors that are null or hold a null or non-finite component take no part; only vectors of
equal dimension meet; ties go to the smaller id; repeated ids are candidates of their own, but none of a
query's own id; a repeated query id asks once, with its smallest vector; empty vectors score 0 with each other; no rows
give no rows; extra columns are not read. Components are floor(scale * x) as long; products must fit in 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, written

BUCKET, BLOCK = 4096, 512
#: The grid: lines of buckets at most, and blocks a column.
LINES, COLUMN = 4096, 8
#: Coordinate pruning pays where the feasible interval excludes enough: above this local threshold.
COORDINATE_FROM = 0.35
FOCUS = 3


def quantized(vectors: DataFrame, scale: int, vec_id: str, embedding: str) -> DataFrame:
    rows = pick(vectors, vec_id=vec_id, e=embedding).filter(F.col("vec_id").isNotNull() & F.col("e").isNotNull())
    rows = rows.withColumn("e", F.col("e").cast("array<double>"))
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = F.transform("e", lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    rows = rows.filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return rows.select("vec_id", "v", F.size("v").alias("dim"), norm.alias("norm"))


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row a group: ids and a matrix, longest first."""
    pdf = pdf.sort_values(["norm", "vec_id"], ascending=[False, True], kind="stable")
    m = np.array(pdf["v"].tolist(), np.int64).reshape(len(pdf), -1)
    return pd.DataFrame({"dim": [int(pdf["dim"].iloc[0])], "grp": [int(pdf["grp"].iloc[0])], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "m": [m.tobytes()], "longest": [float(pdf["norm"].iloc[0])]})


_PACKED = "dim int, grp long, ids binary, m binary, longest double"


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Groups of about ``size`` rows of one dimension, neighbours in length. Ranks come from range
    partitions and offsets, never from one sort of all rows."""
    n = rows.count()
    parts = max(1, -(-n // (16 * size)))
    ranged = rows.withColumn("neg", -F.col("norm")).repartitionByRange(parts, "dim", "neg", "vec_id")
    ranged = written(ranged.withColumn("part", F.spark_partition_id()), "topk-ranged")
    inside = Window.partitionBy("part", "dim").orderBy("neg", "vec_id")
    slot = F.floor((F.row_number().over(inside) - 1) / F.lit(size)).cast("long")
    grouped = ranged.withColumn("grp", F.col("part").cast("long") * F.lit(1 << 32) + slot)
    return grouped.select("vec_id", "v", "dim", "norm", "grp").groupBy("dim", "grp").applyInPandas(_pack, _PACKED)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= cut)
        return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def search_bucket(q_ids: np.ndarray, q: np.ndarray, bounds: np.ndarray, ids: np.ndarray, m: np.ndarray, k: int, stats: dict | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query place, ids, scores) of each query's best k in a bucket, longest first, that can reach its bound."""
    stats = stats if stats is not None else {}
    lengths = np.sqrt((m.astype(float) ** 2).sum(1))
    unit = m / np.maximum(lengths, 1e-300)[:, None]
    columns: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    q_len = np.sqrt((q.astype(float) ** 2).sum(1))
    exact = float(lengths.max(initial=0)) * float(q_len.max(initial=0)) < 2.0**52
    mf = m.astype(float) if exact else m
    dense = []
    for i in range(len(q)):
        bound, top = float(bounds[i]), q_len[i] * (lengths[0] if len(lengths) else 0.0)
        if bound > top * (1 + 1e-9) + 1e-6:
            stats["skipped"] = stats.get("skipped", 0) + 1
            continue
        t = (bound / top - 1e-9) if top > 0 and bound > 0 else -1.0
        if t < COORDINATE_FROM:
            if t <= 0 or lengths[-1] * q_len[i] >= bound:  # every vector is long enough
                dense.append(i)
                continue
            stats["by_length"] = stats.get("by_length", 0) + 1
            rows = np.arange(np.searchsorted(-lengths, -(bound / q_len[i]) * (1 - 1e-9) + 1e-9, "right"))
        else:
            stats["by_coordinate"] = stats.get("by_coordinate", 0) + 1
            u, rows = q[i] / q_len[i], None
            for f in np.argsort(-np.abs(u), kind="stable")[:FOCUS]:
                f = int(f)
                if f not in columns:
                    order = np.argsort(unit[:, f], kind="stable")
                    columns[f] = (order, unit[order, f])
                order, sorted_ = columns[f]
                spread = np.sqrt(max(0.0, (1 - t * t) * (1 - u[f] * u[f])))
                lo = np.searchsorted(sorted_, u[f] * t - spread - 1e-9)
                hi = np.searchsorted(sorted_, u[f] * t + spread + 1e-9, "right") if u[f] < t and u[f] > -t else len(sorted_)
                # The interval's far side is open where the query's own coordinate passes the threshold.
                if u[f] <= -t:
                    lo, hi = 0, np.searchsorted(sorted_, u[f] * t + spread + 1e-9, "right")
                if rows is None or hi - lo < len(rows):
                    rows = order[lo:hi]
        if len(rows):
            scores = (mf[rows] @ mf_query(q[i], exact)).astype(np.int64)
            yield from _own(i, q_ids, ids[rows], scores, bound, k)
    if dense:
        stats["dense"] = stats.get("dense", 0) + len(dense)
        for at in range(0, len(dense), 64):
            part = dense[at : at + 64]
            scores = (mf @ mf_query(q[part], exact).T).astype(np.int64)
            for j, i in enumerate(part):
                yield from _own(i, q_ids, ids, scores[:, j], float(bounds[i]), k)


def mf_query(q: np.ndarray, exact: bool) -> np.ndarray:
    return q.astype(float) if exact else q


def _own(i: int, q_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray, bound: float, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    keep = (ids != q_ids[i]) & (scores >= bound)
    ids, scores = ids[keep], scores[keep]
    if len(ids):
        best = _best(ids, scores, k)
        yield i, ids[best], scores[best]


def _matrix(ids: bytes, m: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(m, np.int64).reshape(len(i), dim)


def _bounded(k: int):
    """Round one: each block with every query's k-th best score in the bucket it has met."""

    def bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                q_ids, q = _matrix(r.q_ids, r.q_m, r.dim)
                ids, m = _matrix(r.ids, r.m, r.dim)
                bounds = np.full(len(q_ids), -np.inf)
                for at, _, scores in search_bucket(q_ids, q, bounds.copy(), ids, m, k):
                    if len(scores) == k:
                        bounds[at] = scores[-1]
                yield pd.DataFrame({"dim": [r.dim], "q_grp": [r.q_grp], "q_ids": [r.q_ids], "q_m": [r.q_m], "q_bounds": [bounds.tobytes()]})

    return bounded


def _search(k: int):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                q_ids, q = _matrix(r.q_ids, r.q_m, r.dim)
                ids, m = _matrix(r.ids, r.m, r.dim)
                found = [(np.full(len(i), q_ids[at]), i, s) for at, i, s in search_bucket(q_ids, q, np.frombuffer(r.q_bounds, np.float64), ids, m, k)]
                if found:
                    yield pd.DataFrame({"query_id": np.concatenate([f[0] for f in found]), "vec_id": np.concatenate([f[1] for f in found]), "score": np.concatenate([f[2] for f in found])})

    return search


def _meet(buckets: DataFrame, blocks: DataFrame, n_buckets: int, n_blocks: int) -> DataFrame:
    """Each bucket with each block of its dimension, in a grid of cells: a bucket goes to every
    column of its line, a block to every line of its column, and a cell joins what meets there. Neither side is
    broadcast: files are small beside the matrices in them, and the driver would hold all copies of a side."""
    lines, columns = max(1, min(LINES, n_buckets)), max(1, -(-n_blocks // COLUMN))
    wide = buckets.withColumn("line", F.pmod(F.xxhash64("dim", "grp"), F.lit(lines))).withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    tall = blocks.withColumn("column", F.pmod(F.xxhash64("q_grp"), F.lit(columns)).cast("int")).withColumn("line", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lines - 1).cast("long"))))
    return wide.hint("merge").join(tall, ["dim", "line", "column"])


def topk(vectors: DataFrame, k: int = 10, query_every: int = 100, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each vector whose id is divisible by ``query_every``."""
    rows = quantized(vectors, scale, vec_id, embedding)
    buckets = written(packed(rows, BUCKET), "topk-buckets")
    asked = rows.filter(F.pmod("vec_id", F.lit(query_every)) == 0).groupBy("vec_id").agg(F.min(F.struct("v", "dim", "norm")).alias("x")).select("vec_id", "x.*")
    blocks = written(packed(asked, BLOCK).select("dim", F.col("grp").alias("q_grp"), F.col("ids").alias("q_ids"), F.col("m").alias("q_m")), "topk-blocks")
    n_blocks, n_buckets = blocks.count(), buckets.count()
    longest = buckets.groupBy("dim").agg(F.min(F.struct("grp", "ids", "m")).alias("x")).select("dim", "x.*")
    met = _meet(longest, blocks, 1, n_blocks).select("dim", "q_grp", "q_ids", "q_m", "ids", "m")
    bounded = written(met.mapInPandas(_bounded(k), "dim int, q_grp long, q_ids binary, q_m binary, q_bounds binary"), "topk-bounds")
    met = _meet(buckets, bounded, n_buckets, n_blocks).select("dim", "q_ids", "q_m", "q_bounds", "ids", "m")
    found = met.mapInPandas(_search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
