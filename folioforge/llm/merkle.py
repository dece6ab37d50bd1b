"""A Merkle manifest of a data set: leaves, roots, authentication paths, and what tampering does to them.

Every row is a leaf, each group of rows (a language) a tree of ARITY children a node, and the trees' roots,
in the groups' order, are the leaves of the tree that gives the root. A lone last node of a level
is hashed too, and a tree of one leaf is that leaf.

Rows are cut down to their digests in one pass, numbered in each tree by range partitions and offsets, and dealt out in
aligned blocks of ARITY ** LEVELS leaves. Blocks give their roots; those are the nodes of the next, so many times smaller table,
and so on until each tree has one. Then the paths come down again: the upper part of a path is a row a block, computed once,
and meets its block in a cogroup, where the lower part is made by fractal traversal. For each band
of BAND levels a block holds two subtrees: the existing one, whose nodes are the siblings on the current path,
and the desired one right of it, which takes one leaf a round and replaces the other when the path leaves it. So a task
holds the digests of one block and a few subtrees of ARITY ** BAND nodes, whatever the size of the tree.

A path is an array of (left, right), from the leaf to the root: the siblings left and right of the node, concatenated.
Folding and proofs are column functions over it.

Defined cases: any null field counts as ``-``; a null group is a tree of its own, the first; null ids come last in
their tree; rows of equal ids come in the order of their digests, equal rows in any; a very long text is hashed whole; an empty table gives no
rows; extra columns are not read, and columns are found by their exact name first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, written

ARITY, BAND, LEVELS = 8, 2, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Runs of a tree in a partition that are broadcast when rows are numbered, at most.
FEW_RUNS = 100_000
PATH = "array<struct<left:string,right:string>>"
_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# --------------------------------------------------------------------------- one block


def _digest(run: Sequence[str]) -> str:
    return sha256("".join(run).encode()).hexdigest()


def height_of(size: int, levels: int = LEVELS) -> int:
    """Levels that a block of a tree of ``size`` nodes has above its leaves."""
    height = 0
    while height < levels and ARITY**height < size:
        height += 1
    return height


class Subtree:
    """Levels ``low`` to ``high`` of a subtree, filled leaf by leaf. Of the levels below ``low`` only open runs are held."""

    def __init__(self, low: int, high: int) -> None:
        self.low, self.high, self.root = low, high, None
        self.open: list[list[str]] = [[] for _ in range(high)]
        self.nodes: list[list[str]] = [[] for _ in range(high - low)]

    def feed(self, node: str, level: int = 0) -> None:
        while level < self.high:
            if level >= self.low:
                self.nodes[level - self.low].append(node)
            run = self.open[level]
            run.append(node)
            if len(run) < ARITY:
                return
            self.open[level], node, level = [], _digest(run), level + 1
        self.root = node

    def finish(self) -> Subtree:
        """Close the runs that are short."""
        for level in range(self.high):
            if run := self.open[level]:
                self.open[level] = []
                self.feed(_digest(run), level + 1)
        return self

    def around(self, level: int, at: int) -> tuple[str, str]:
        """The siblings left and right of node ``at`` of a level, counted in this subtree."""
        nodes, first = self.nodes[level - self.low], at - at % ARITY
        return "".join(nodes[first:at]), "".join(nodes[at + 1 : first + ARITY])


def root_of(leaves: Sequence[str], height: int) -> str:
    if not height:
        return leaves[0]
    tree = Subtree(height, height)
    for leaf in leaves:
        tree.feed(leaf)
    return tree.finish().root


def traverse(leaves: Sequence[str], height: int, band: int = BAND) -> Iterator[list[tuple[str, str]]]:
    """The path of each leaf in turn, up to its block's root."""
    bands = [(low, min(low + band, height)) for low in range(0, height, band)]
    existing = [Subtree(low, high) for low, high in bands]
    for subtree in existing:
        for leaf in leaves[: ARITY**subtree.high]:
            subtree.feed(leaf)
        subtree.finish()
    moving = range(len(bands) - 1)  # the top one covers the block
    desired = [Subtree(*bands[b]) for b in moving]
    path: list[tuple[str, str]] = [("", "")] * height
    for i in range(len(leaves)):
        for b in moving:
            if i and i % ARITY ** bands[b][1] == 0:
                existing[b], desired[b] = desired[b].finish(), Subtree(*bands[b])
        for b, (low, high) in enumerate(bands):
            inside = i % ARITY**high if b in moving else i
            for level in range(low, high):
                if i % ARITY**level == 0:  # else the node is the one of the leaf before
                    path[level] = existing[b].around(level, inside // ARITY**level)
        yield list(path)
        for b in moving:
            if (ahead := i + ARITY ** bands[b][1]) < len(leaves):
                desired[b].feed(leaves[ahead])


# --------------------------------------------------------------------------- trees in blocks


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` (tree, ...) with pos, their number in their tree by ``order``, and the tree's size. Any tree may
    hold most of the rows: no window sees more than one row a partition of it."""
    keys = {f"_o{i}": c for i, c in enumerate(order)}
    ranged = rows.withColumns(keys).repartitionByRange("tree", *keys).sortWithinPartitions("tree", *keys).drop(*keys)
    placed = written(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()), "merkle-order")
    runs = placed.groupBy("_part", "tree").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = written(runs.select("_part", "tree", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("size")), "merkle-runs")
    few = runs.count() <= FEW_RUNS
    return placed.join(F.broadcast(runs) if few else runs, ["_part", "tree"]).withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before")


def _block(levels: int) -> Column:
    return F.shiftright("pos", levels * (ARITY.bit_length() - 1)).alias("block")


def _roots(levels: int):
    def run(nodes: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("pos")
        size = nodes.column("size")[0].as_py()
        root = root_of(nodes.column("digest").to_pylist(), height_of(size, levels))
        return pa.table({"tree": nodes.column("tree")[:1], "pos": nodes.column("block")[:1], "size": pa.array([-(-size // ARITY**levels)], pa.int64()), "digest": pa.array([root])})

    return run


def climbed(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """``nodes`` (tree, pos, size, digest, ...), the roots of their blocks, of those' blocks, ..., of the trees."""
    chain, largest = [nodes], nodes.agg(F.max("size")).first()[0] or 0
    while True:
        blocks = chain[-1].select("tree", "pos", "size", "digest", _block(levels)).groupBy("tree", "block")
        chain.append(written(blocks.applyInArrow(_roots(levels), "tree string, pos long, size long, digest string"), "merkle-roots"))
        if (largest := -(-largest // ARITY**levels)) <= 1:
            return chain


def _joined(payload: list[str], levels: int):
    def run(nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("pos")
        upper = [(s["left"], s["right"]) for s in above.column("path")[0].as_py()]
        left, right, ends = [], [], [0]
        for own in traverse(nodes.column("digest").to_pylist(), height_of(nodes.column("size")[0].as_py(), levels)):
            for a, b in (*own, *upper):
                left.append(a)
                right.append(b)
            ends.append(len(left))
        steps = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], names=["left", "right"])
        path = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps)
        same = {c: pa.array(above.column(c).to_pylist() * nodes.num_rows, pa.string()) for c in ("subroot", "root")}
        return pa.table({c: nodes.column(c) for c in payload} | {"path": path.cast(_PATH)} | same)

    return run


def descended(chain: list[DataFrame], above: DataFrame, payload: list[str], levels: int) -> DataFrame:
    """``payload`` of the nodes that ``chain`` began with, and their path. ``above`` (tree, pos, path, subroot, root)
    goes on from each tree's root."""
    for nodes in chain[-2::-1]:
        keep = payload if nodes is chain[0] else ["tree", "pos"]
        kinds = dict(nodes.dtypes)
        schema = ", ".join(f"{c} {kinds[c]}" for c in keep) + f", path {PATH}, subroot string, root string"
        below = nodes.select(*dict.fromkeys(["tree", "pos", "size", "digest", *keep]), _block(levels)).groupBy("tree", "block")
        above = below.cogroup(above.withColumnRenamed("pos", "block").groupBy("tree", "block")).applyInArrow(_joined(keep, levels), schema)
    return above


# --------------------------------------------------------------------------- manifests


def encoded(c: Column) -> Column:
    """``-`` for null, else the length in bytes, a colon and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[encoded(fields[f]) for f in FIELDS]).cast("binary"), 256)


def lowered(text: Column) -> Column:
    """A tampering: A-Z in lower case."""
    return F.translate(text.cast("string"), UPPER, LOWER)


def a_third(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def manifest(docs: DataFrame, tampered=a_third, tampering=lowered, levels: int = LEVELS) -> DataFrame:
    """doc_id, lang, leaf, tampered_leaf (null where ``tampered`` does not hold), path, subroot, root: one row for each of ``docs``."""
    rows = pick(docs, **{f: f for f in FIELDS}).select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.col("n_chars").cast("long").alias("n_chars"), F.col("text").cast("string").alias("text"))
    own = {f: F.col(f) for f in FIELDS}
    lang = F.col("lang").cast("string")
    tree = F.coalesce(F.concat(F.lit("="), lang), F.lit("-"))  # the null group, "-", comes before any "="
    changed = F.when(tampered(F.col("doc_id")), leaf_of(own | {"text": tampering(F.col("text"))}))
    leaves = written(rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", lang.alias("lang"), tree.alias("tree"), leaf_of(own).alias("digest"), changed.alias("tampered_leaf")), "merkle-leaves")
    chain = climbed(numbered(leaves, F.isnull("doc_id"), F.col("doc_id"), F.col("digest"), F.col("rid")), levels)
    tops = climbed(numbered(chain[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), F.col("name")), levels)
    none = F.lit(None).cast("string")
    ends = tops[-1].select("tree", "pos", F.array().cast(PATH).alias("path"), none.alias("subroot"), F.col("digest").alias("root"))
    named = descended(tops, ends, ["name", "digest"], levels)
    above = written(named.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"), "root"), "merkle-tops")
    return descended(chain, above, ["doc_id", "lang", "digest", "tampered_leaf"], levels).withColumnRenamed("digest", "leaf")


def proof_digest(path: Column) -> Column:
    """The digest of all siblings on a path, from left to right, from the leaf to the root."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "").cast("binary"), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of a path."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]).cast("binary"), 256))


def verified(found: DataFrame) -> DataFrame:
    """``manifest()`` with proof_sha256, folded_root (from the tampered leaf where there is one) and verified."""
    root = folded(F.coalesce("tampered_leaf", "leaf"), F.col("path"))
    return found.withColumn("proof_sha256", proof_digest(F.col("path"))).withColumn("folded_root", root).withColumn("verified", F.col("folded_root") == F.col("root"))
