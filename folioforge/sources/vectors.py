"""An inverted index of vectors: every row lies in the list of its nearest centroid, with its distance to it.

Centroids are fitted once, on a bounded sample (SAMPLE rows, those whose keys hash lowest; a documented parameter);
all rows are then dealt to their lists, sorted by list and distance, in folders of a few lists each. A search reads the
lists nearest to each query, as many as the sample needed for the share TARGET of its own rows' nearest: few where vectors lie in
clusters, most where they do not. What it may have missed is bounded by the triangle inequality: a row whose distance to
its centroid differs from the query's by more than the best k found so far cannot be among them. With ``exact`` the
lists and rows that this does not exclude are read too, and the result is that of a full scan.

The index grows by segments: rows that are added later go to the lists that are there, in a folder of their own,
and a manifest names the segments that count, with the number and the range of distances of each list. Rows whose vectors are
null, of another dimension or not finite are refused with their number. An index that is built of no rows takes none."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import doubles, is_valid
from ..session import kept
from .manifests import Manifests

#: Rows that the centroids are fitted on, rounds of fitting, lists at most, bytes that all centroids may take, lists a folder.
SAMPLE, ROUNDS, MOST_LISTS, MOST_BYTES, PER_FOLDER = 20_000, 12, 4096, 64 << 20, 16
#: The share of the nearest rows that probes are to reach.
TARGET = 0.97
METRICS = ("l2", "cosine")
MAX_QUERIES = 1000
_SLACK = 1e-9


def fitted(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of ``sample`` by Lloyd rounds, from rows of it spread evenly. An empty list takes the farthest row."""
    centroids = sample[np.linspace(0, len(sample) - 1, lists).astype(int)].copy()
    for _ in range(rounds):
        near, distance = nearest(sample, centroids)
        count = np.bincount(near, minlength=lists)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        full = count > 0
        centroids[full] = sums[full] / count[full, None]
        for empty, far in zip(np.flatnonzero(~full), np.argsort(-distance, kind="stable")):
            centroids[empty] = sample[far]
    return centroids


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, and the distance to it."""
    index, distance = np.empty(len(rows), np.int64), np.empty(len(rows))
    norms = (centroids * centroids).sum(1)
    for at in range(0, len(rows), 2048):
        part = rows[at : at + 2048]
        index[at : at + 2048] = (norms - 2 * part @ centroids.T).argmin(1)
        distance[at : at + 2048] = np.sqrt(((part - centroids[index[at : at + 2048]]) ** 2).sum(1))
    return index, distance


def probes_for(sample: np.ndarray, centroids: np.ndarray, k: int = 10, target: float = TARGET, asked: int = 200) -> int:
    """How many lists hold the share ``target`` of the k nearest, for rows of the sample among the sample."""
    index, _ = nearest(sample, centroids)
    ranks = []
    for at in np.linspace(0, len(sample) - 1, min(asked, len(sample))).astype(int):
        distance = ((sample - sample[at]) ** 2).sum(1)
        distance[at] = np.inf
        near = np.argpartition(distance, min(k, len(sample) - 1))[:k]
        place = np.empty(len(centroids), np.int64)
        place[np.argsort(((centroids - sample[at]) ** 2).sum(1), kind="stable")] = np.arange(len(centroids))
        ranks += place[index[near]].tolist()
    return int(np.quantile(ranks, target, method="higher")) + 1 if ranks else 1


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _dealt(centroids: np.ndarray):
    """Adds list and distance to rows (..., v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                index, distance = nearest(_matrix(batch.column("v")), centroids)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(index.astype(np.int32)), pa.array(distance)], names=[*batch.schema.names, "list", "distance"])

    return run


def _scored(ids: list, asked: np.ndarray, reach: np.ndarray, apart: np.ndarray, within: np.ndarray, k: int, metric: str):
    """(query_id, item_key, exact): of each batch, which holds few lists, the k best for each query that probes one of them. Queries
    go one after another, so what is held beside a batch are k rows a query. ``reach`` has the lists that a query probes, ``apart`` the queries' distances to the centroids, ``within`` how far a row may be from the query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, distance = batch.column("list").to_numpy(), batch.column("distance").to_numpy()
            m, keys = _matrix(batch.column("v")), batch.column("item_key")
            order = keys.to_numpy(zero_copy_only=False)
            out_q, out_i, out_s = [], [], []
            for q in np.flatnonzero(reach[:, np.unique(lists)].any(1)).tolist() if len(lists) else ():
                near = np.flatnonzero(reach[q, lists] & (np.abs(distance - apart[q, lists]) <= within[q]))
                if not len(near):
                    continue
                d = ((m[near] - asked[q]) ** 2).sum(1)
                score = 1.0 - d if metric == "l2" else 1.0 - d / 2
                if len(score) > k:
                    enough = score >= np.partition(score, -k)[-k]
                    near, score = near[enough], score[enough]
                best = np.lexsort((order[near], -score))[:k]
                out_q += [ids[q]] * len(best)
                out_i.append(near[best])
                out_s.append(score[best])
            if out_q:
                yield pa.RecordBatch.from_arrays([pa.array(out_q), keys.take(pa.array(np.concatenate(out_i))), pa.array(np.concatenate(out_s))], names=["query_id", "item_key", "exact"])

    return run


class VectorIndex(Manifests):
    """The index in ``folder``."""

    @classmethod
    def build(cls, rows: DataFrame, folder: str, metric: str = "l2", lists: int | None = None, sample: int = SAMPLE) -> VectorIndex:
        """Of ``rows`` (item_key, embedding, ...); columns besides these can be filtered by. About as many lists as the root of the rows."""
        if metric not in METRICS:
            raise ValueError(f"unknown metric: {metric}")
        spark = rows.sparkSession
        index = cls(spark, folder)
        vectors = rows.filter("embedding is not null").select("item_key", doubles(F.col("embedding")).alias("v"))
        few = vectors.orderBy(F.xxhash64("item_key"), "item_key").limit(sample).collect()
        dimension = len(few[0]["v"]) if few else 0
        fine = [r["v"] for r in few if len(r["v"]) == dimension and all(x is not None and math.isfinite(x) for x in r["v"])]
        told = np.array(fine, float).reshape(len(fine), dimension)
        if metric == "cosine":
            told = told / np.maximum(np.sqrt((told * told).sum(1)), 1e-30)[:, None]
        most = max(1, min(MOST_LISTS, MOST_BYTES // (8 * max(1, dimension)), len(told) // 4))
        lists = min(most, lists or max(1, round(math.sqrt(rows.count()))))
        centroids = fitted(told, lists) if len(told) else np.zeros((1, dimension))
        table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>")
        schema = ", ".join(f"`{n}` {t}" for n, t in [*rows.drop("embedding").dtypes, ("v", "array<double>"), ("list", "int"), ("distance", "double"), ("folder", "int")])
        body = {"schema": schema, "metric": metric, "dimension": dimension, "lists": len(centroids), "centroids": index._written(table, "centroids"), "probes": probes_for(told, centroids) if len(told) > 1 else 1, "segments": []}
        index._seal(index.version() + 1, body)
        index.add(rows)
        return index

    def centroids(self, manifest: dict | None = None) -> np.ndarray:
        m = manifest or self.manifest()
        return np.array([r["centroid"] for r in self._read(m["centroids"]).orderBy("list").collect()], float).reshape(m["lists"], m["dimension"])  # MOST_BYTES at most

    def add(self, rows: DataFrame) -> int:
        """A segment of ``rows``, whose keys are new; the version that has it."""
        m = self.manifest()
        v = doubles(F.col("embedding"))
        if m["metric"] == "cosine":
            length = F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-30))
            v = F.transform(v, lambda x: x / length)
        refused = rows.filter(~F.coalesce(is_valid(doubles(F.col("embedding")), m["dimension"]), F.lit(False))).count()
        if refused:
            raise ValueError(f"{refused} vectors are null, not finite, or not of {m['dimension']} components")
        held = rows.withColumn("v", v).drop("embedding")
        schema = ", ".join(f"`{n}` {t}" for n, t in held.dtypes) + ", list int, distance double"
        dealt = held.mapInArrow(_dealt(self.centroids(m)), schema).withColumn("folder", F.floor(F.col("list") / F.lit(PER_FOLDER)).cast("int"))
        dealt = kept(dealt, "dealt")  # ranges are drawn from it
        if dealt.isEmpty():
            return m["version"]
        name = self._written(dealt.repartitionByRange("folder", "list", "distance").sortWithinPartitions("folder", "list", "distance"), "vectors", "folder")
        told = dealt.groupBy("list").agg(F.count("*").alias("n"), F.min("distance").alias("lo"), F.max("distance").alias("hi")).collect()  # a row a list
        segment = {"path": name, "rows": sum(r["n"] for r in told), "lists": {str(r["list"]): [r["n"], r["lo"], r["hi"]] for r in told}}
        return self._seal(m["version"] + 1, {k: x for k, x in m.items() if k != "version"} | {"segments": [*m["segments"], segment]})

    def count(self) -> int:
        return sum(s["rows"] for s in self.manifest()["segments"])

    def rows(self, manifest: dict | None = None) -> DataFrame:
        """Every row that is indexed: item_key, v, list, distance, folder, and its other columns."""
        m = manifest or self.manifest()
        return self._read(*[s["path"] for s in m["segments"]]) if m["segments"] else self.spark.createDataFrame([], m["schema"])

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, exact: bool = False, where: Column | None = None) -> DataFrame:
        """query_id, item_key, score, rank: the k best rows that pass for each of ``queries`` (query_id, qv), a stated set,
        among the ``probes`` nearest lists that hold any row (as many as the sample asked for), or among all with ``exact``."""
        m = self.manifest()
        centroids = self.centroids(m)
        lo, hi, n = np.full(m["lists"], np.inf), np.full(m["lists"], -np.inf), np.zeros(m["lists"], np.int64)
        for segment in m["segments"]:
            for number, (rows, least, most) in segment["lists"].items():
                i = int(number)
                n[i], lo[i], hi[i] = n[i] + rows, min(lo[i], least), max(hi[i], most)
        held = np.flatnonzero(n)
        probes = min(len(held), probes or m["probes"])
        asked = [(r["query_id"], r["qv"]) for r in queries.select("query_id", doubles(F.col("qv")).alias("qv")).toLocalIterator()]
        kinds = queries.schema["query_id"].dataType.simpleString(), self.rows(m).schema["item_key"].dataType.simpleString()
        schema = f"query_id {kinds[0]}, item_key {kinds[1]}, exact double"
        found = []
        for at in range(0, len(asked) if len(held) else 0, MAX_QUERIES):
            ids, q = [x for x, _ in asked[at : at + MAX_QUERIES]], np.array([x for _, x in asked[at : at + MAX_QUERIES]], float)
            if m["metric"] == "cosine":
                q = q / np.maximum(np.sqrt((q * q).sum(1)), 1e-30)[:, None]
            apart = np.vstack([np.sqrt(((centroids - x) ** 2).sum(1)) for x in q])
            first = np.zeros((len(q), m["lists"]), bool)
            order = held[np.argsort(apart[:, held], axis=1, kind="stable")][:, :probes]
            np.put_along_axis(first, order, True, axis=1)
            near = self._scan(m, ids, q, first, apart, np.full(len(q), np.inf), k, schema, where)
            if exact:
                near = kept(near, "probed")
                worst = Window.partitionBy("query_id").orderBy(F.desc("exact"), "item_key")
                kth = {r["query_id"]: r["exact"] for r in near.withColumn("r", F.row_number().over(worst)).filter(F.col("r") == k).select("query_id", "exact").collect()}  # a stated query set
                scale = 1.0 if m["metric"] == "l2" else 2.0
                within = np.array([math.sqrt(max(0.0, (1.0 - kth[i]) * scale)) * (1 + _SLACK) + _SLACK if i in kth else np.inf for i in ids])
                reach = (apart - hi <= within[:, None]) & (lo - apart <= within[:, None]) & (n > 0) & ~first
                near = near.unionByName(self._scan(m, ids, q, reach, apart, within, k, schema, where))
            found.append(near)
        out = found[0] if found else self.spark.createDataFrame([], schema)
        for more in found[1:]:
            out = out.unionByName(more)
        best = Window.partitionBy("query_id").orderBy(F.desc("exact"), "item_key")
        ranked = out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        return ranked.select("query_id", "item_key", (F.round("exact", 6) + F.lit(0.0)).alias("score"), "rank")

    def _scan(self, m: dict, ids: list, q: np.ndarray, reach: np.ndarray, apart: np.ndarray, within: np.ndarray, k: int, schema: str, where: Column | None) -> DataFrame:
        """The rows of the lists that any query reaches, met by the queries that reach them."""
        lists = np.flatnonzero(reach.any(0)).tolist()
        if not lists:
            return self.spark.createDataFrame([], schema)
        rows = self.rows(m).filter(F.col("folder").isin(sorted({i // PER_FOLDER for i in lists})) & F.col("list").isin(lists))
        rows = rows.filter(where) if where is not None else rows
        return rows.select("item_key", "v", "list", "distance").mapInArrow(_scored(ids, q, reach, apart, within, k, m["metric"]), schema)


def recall(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """queries, wanted, hits, recall: how many of the rows (query_id, item_key) of ``wanted`` are in ``found``."""
    hits = wanted.select("query_id", "item_key").join(found.select("query_id", "item_key", F.lit(1).alias("hit")), ["query_id", "item_key"], "left")
    return hits.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("wanted"), F.count("hit").alias("hits"), (F.count("hit") / F.count("*")).alias("recall"))
