"""Product codes of vectors: integer codebooks by Lloyd rounds, assigned through kd-trees.

Components become integers floor(scale * x); a vector is cut into PARTS equal consecutive parts, and each part
position has a codebook of at most ENTRIES entries, at first those parts of the smallest ids. In each round the
codebooks are broadcast, every worker builds a kd-tree for each of them, and batches of parts walk
down all at once: branch and bound over the exact integer distance to a node's box. A node whose bound
equals the best distance so far is visited too, so that of equally near entries the one with the lower index is found. A task gives the
sums and the count of each entry it has used, PARTS * ENTRIES rows at most; those are added up by Spark, and the driver gets the
new codebooks, as many again. All arithmetic is in whole numbers, so results do not depend on the order of rows.

Vectors of equal dimension form a set with codebooks of its own. A dimension that PARTS does not divide is cut at
floor(i * dimension / PARTS).

Defined cases: vectors that are null or hold a null or non-finite component are dropped; with fewer rows than ENTRIES, codebooks have as many
entries as rows; a null id comes last; rows of one id take part each, in the order of their components; entries that are equal to
others, or that no part is nearest to, stay as they are; null labels are one label; an empty table gives no rows; extra columns are
not read, and columns are found by their exact name first. Limits, each an error with its reason: scaled components lie within
2**26, so that sums and distances stay in 64 bits, and codebooks of all dimensions together take at most CODEBOOK_BYTES.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, sliced, with_groups, written

PARTS, ENTRIES, SCALE, ROUNDS = 16, 64, 256, 2
#: Entries a leaf of a kd-tree has at most; rows that walk down together; bytes that all codebooks may take.
LEAF, TOGETHER, CODEBOOK_BYTES = 8, 4096, 64 << 20
WIDEST = 1 << 26


# --------------------------------------------------------------------------- kd-trees


class KdTree:
    """Over the rows of ``entries`` (integers). ``nearest`` finds the nearest entry's index, ties to the lower, and its squared distance."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.top = self._node(np.arange(len(entries)))

    def _node(self, at: np.ndarray) -> tuple:
        own = self.entries[at]
        low, high = own.min(0), own.max(0)
        if len(at) <= LEAF or (low == high).all():
            return low, high, np.sort(at), None
        by = own[:, np.argmax(high - low)]
        order = at[np.lexsort((at, by))]
        half = len(order) // 2
        return low, high, None, (self._node(order[:half]), self._node(order[half:]))

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best = np.full(len(points), np.iinfo(np.int64).max)
        index = np.full(len(points), len(self.entries))
        if len(points):
            self._visit(self.top, np.ascontiguousarray(points.T), np.arange(len(points)), best, index)
        return index, best

    @staticmethod
    def _bound(node: tuple, points: np.ndarray) -> np.ndarray:
        """Squared distance of each column to the node's box."""
        off = np.maximum(node[0][:, None] - points, 0)
        off += np.maximum(points - node[1][:, None], 0)
        off *= off
        return off.sum(0)

    def _visit(self, node: tuple, points: np.ndarray, rows: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        """``points``, the columns of ``rows``, walk below ``node``: each first to the child whose box is nearer, then to the
        other, unless its bound exceeds the best distance by then."""
        if node[3] is None:
            off = points[:, None, :] - self.entries[node[2]].T[:, :, None]
            off *= off
            each = off.sum(0)
            at = each.argmin(0)  # the first of equals
            distance, entry = each[at, np.arange(len(rows))], node[2][at]
            better = (distance < best[rows]) | ((distance == best[rows]) & (entry < index[rows]))
            best[rows[better]], index[rows[better]] = distance[better], entry[better]
            return
        bounds = [self._bound(child, points) for child in node[3]]
        second = bounds[1] < bounds[0]
        for near in (True, False):
            for child, bound, first in zip(node[3], bounds, (~second, second)):
                go = np.flatnonzero((first if near else ~first) & (bound <= best[rows]))
                if len(go):
                    self._visit(child, points[:, go], rows[go], best, index)


# --------------------------------------------------------------------------- codebooks


def cuts(dimension: int, parts: int) -> list[int]:
    return [i * dimension // parts for i in range(parts + 1)]


class Codebooks:
    """Of each dimension, of each part, the entries (entry x component)."""

    def __init__(self, books: dict[int, list[np.ndarray]]) -> None:
        self.books = books

    @classmethod
    def first(cls, vectors: dict[int, np.ndarray], parts: int) -> Codebooks:
        return cls({d: [v[:, a:b].copy() for a, b in zip(cuts(d, parts), cuts(d, parts)[1:])] for d, v in vectors.items()})

    def moved(self, sums: list[tuple[int, int, int, list[int], int]]) -> Codebooks:
        """By (dimension, part, entry, sums, count)."""
        books = {d: [b.copy() for b in parts] for d, parts in self.books.items()}
        for dim, part, entry, total, n in sums:
            books[dim][part][entry] = [s // n for s in total]
        return Codebooks(books)

    def digest(self, dimension: int) -> str:
        return hashlib.sha256(",".join(str(x) for b in self.books[dimension] for x in b.ravel().tolist()).encode()).hexdigest()

    def trees(self) -> dict[int, list[KdTree]]:
        return {d: [KdTree(b) for b in parts] for d, parts in self.books.items()}


def _blocks(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their integers) of each dimension in a batch, TOGETHER rows at a time."""
    vectors = batch.column("v")
    lengths = np.diff(vectors.offsets.to_numpy())
    starts, flat = vectors.offsets.to_numpy()[:-1] - vectors.offsets[0].as_py(), vectors.flatten().to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths):
        of_dim = np.flatnonzero(lengths == dim)
        for at in range(0, len(of_dim), TOGETHER):
            rows = of_dim[at : at + TOGETHER]
            v = np.floor(scale * flat[starts[rows][:, None] + np.arange(dim)])
            if np.abs(v).max(initial=0) > WIDEST:
                raise ValueError(f"scaled components lie within {WIDEST}")
            yield rows, v.astype(np.int64)


def _summing(books: Codebooks, scale: int):
    """Of each entry that a task's parts are nearest to: dim, part, entry, sums, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, held = books.trees(), {}
        for batch in batches:
            for _, v in _blocks(batch, scale):
                dim, at = v.shape[1], 0
                for part, tree in enumerate(trees[dim]):
                    width = tree.entries.shape[1]
                    piece = v[:, at : at + width]
                    at += width
                    nearest, _ = tree.nearest(piece)
                    sums, n = held.setdefault((dim, part), (np.zeros_like(tree.entries), np.zeros(len(tree.entries), np.int64)))
                    order = np.argsort(nearest, kind="stable")
                    used, begin = np.unique(nearest[order], return_index=True)
                    sums[used] += np.add.reduceat(piece[order], begin, axis=0)
                    n[used] += np.diff(np.append(begin, len(order)))
        rows = [(d, p, e, sums[e].tolist(), int(n[e])) for (d, p), (sums, n) in held.items() for e in np.flatnonzero(n)]
        if rows:
            kinds = pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["dim", "part", "entry", "sums", "n"])

    return run


def _coding(books: Codebooks, scale: int):
    """code, error and the codebooks' digest of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = books.trees()
        told = {d: books.digest(d) for d in trees}
        for batch in batches:
            code, error, digest = [""] * batch.num_rows, np.zeros(batch.num_rows, np.int64), [""] * batch.num_rows
            for rows, v in _blocks(batch, scale):
                found, at = np.zeros((len(v), len(trees[v.shape[1]])), np.uint8), 0
                for part, tree in enumerate(trees[v.shape[1]]):
                    width = tree.entries.shape[1]
                    found[:, part], distance = tree.nearest(v[:, at : at + width])
                    error[rows] += distance
                    at += width
                for row, own in zip(rows, found):
                    code[row], digest[row] = own.tobytes().hex(), told[v.shape[1]]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error), pa.array(digest, pa.string())], names=["vec_id", "label", "code", "error", "codebooks_sha256"])

    return run


# --------------------------------------------------------------------------- the operator


def _kept(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    rows = pick(vectors, vec_id=vec_id, v=embedding, label=label)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v"), F.col("label").cast("string").alias("label"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(F.col("v").isNotNull() & fine)


def _first_vectors(rows: DataFrame, entries: int, scale: int) -> dict[int, np.ndarray]:
    """Of each dimension the integers of the vectors with the smallest ids."""
    out, size = {}, 0
    for dim in sorted(r["dim"] for r in rows.select(F.size("v").alias("dim")).distinct().limit(CODEBOOK_BYTES // 8).collect()):
        whole = F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
        found = rows.filter(F.size("v") == dim).select("vec_id", whole.alias("v")).orderBy(F.isnull("vec_id"), "vec_id", "v").limit(entries).collect()
        out[dim] = np.array([r["v"] for r in found], np.int64).reshape(len(found), dim)
        size += out[dim].nbytes
        if size > CODEBOOK_BYTES:
            raise ValueError(f"codebooks of all dimensions take more than {CODEBOOK_BYTES} bytes")
    return out


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE, rounds: int = ROUNDS, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> tuple[DataFrame, Codebooks]:
    """vec_id, label, code, error, label_error, codebooks_sha256 of each row that is kept, and the codebooks.
    ``code`` has two hex digits a part, so ``entries`` is at most 256."""
    rows = _kept(vectors, vec_id, embedding, label)
    books = Codebooks.first(_first_vectors(rows, entries, scale), parts)
    for _ in range(rounds):
        sums = rows.select("v").mapInArrow(sliced(_summing(books, scale), TOGETHER), "dim int, part int, entry int, sums array<long>, n long")
        places = sums.select("dim", "part", "entry", "n", F.posexplode("sums").alias("i", "s"))
        added = places.groupBy("dim", "part", "entry", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        added = added.groupBy("dim", "part", "entry").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]).alias("sums"), F.max("n").alias("n"))
        books = books.moved([tuple(r) for r in added.collect()])  # as many rows as the codebooks have entries
    coded = written(rows.mapInArrow(sliced(_coding(books, scale), TOGETHER), "vec_id long, label string, code string, error long, codebooks_sha256 string"), "codes")
    coded = coded.withColumn("group", F.coalesce(F.concat(F.lit("="), "label"), F.lit("-")))
    labels = coded.groupBy("group").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    told = with_groups(coded, labels, "group", "n", coded.count())
    return told.select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256"), books


def reconstructed(coded: DataFrame, books: Codebooks, dimension: int) -> DataFrame:
    """vec_id, approx (the integers that its code stands for) of rows of ``coded``, all of one dimension."""
    kept = books.books[dimension]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.frombuffer(bytes.fromhex("".join(batch.column("code").to_pylist())), np.uint8).reshape(batch.num_rows, len(kept))
            found = np.hstack([book[codes[:, part]] for part, book in enumerate(kept)])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(found.tolist(), pa.list_(pa.int64()))], names=["vec_id", "approx"])

    return coded.select("vec_id", "code").mapInArrow(sliced(run, TOGETHER), "vec_id long, approx array<long>")
