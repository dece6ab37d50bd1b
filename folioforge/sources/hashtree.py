"""Digest trees over the hashed keys of a table: whether two reads agree, and which keys differ, without joining the tables.

A row's place is the SHA-256 of its key; leaves are the prefixes of it that leave about LEAF rows each, so the depth of the
tree follows the number of rows. A node's digest is that of its children's in order, 16 at most. Two trees are compared from the
root down: only below nodes that differ is the next level looked at, and rows are read only in leaves that do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import kept

LEAF, MOST_DEPTH = 64, 12


def depth_for(rows: int, leaf: int = LEAF) -> int:
    depth = 0
    while depth < MOST_DEPTH and rows > leaf * 16**depth:
        depth += 1
    return depth


def row_digest(columns: Sequence[str]) -> Column:
    """Of the values, each with its length in bytes, ``-`` for null; of any types, as text or as JSON."""
    parts = []
    for c in columns:
        text = F.to_json(F.struct(F.col(c)), {"ignoreNullFields": "false"})
        parts += [F.octet_length(text).cast("string"), F.lit(":"), text]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _rows(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """A row's place and digest."""
    return rows.select(F.sha2(F.coalesce(F.col(key).cast("string"), F.lit("-")).cast("binary"), 256).alias("place"), row_digest([key, *columns]).alias("digest"))


class HashTree:
    """The tree of ``rows`` by ``key`` over ``columns``; of ``depth``, by default as their number asks."""

    def __init__(self, rows: DataFrame, key: str, columns: Sequence[str], depth: int | None = None) -> None:
        self.rows, self.key, self.columns = rows, key, list(columns)
        self.depth = depth_for(rows.count()) if depth is None else depth
        level = _rows(rows, key, columns).select(F.left("place", F.lit(self.depth)).alias("node"), F.concat("place", "digest").alias("digest"), F.lit(1).cast("long").alias("n"))
        levels = []
        for d in range(self.depth, -1, -1):
            joined = F.array_join(F.array_sort(F.collect_list("digest")), "")
            grouped = level.groupBy(F.left("node", F.lit(d)).alias("node")).agg(F.sha2(joined, 256).alias("h"), F.sum("n").alias("n"))
            levels.append(grouped.select(F.lit(d).alias("depth"), "node", "h", "n"))
            level = grouped.select("node", F.concat("node", F.lit(":"), "h").alias("digest"), "n")
        out = levels[0]
        for more in levels[1:]:
            out = out.unionByName(more)
        self.nodes = kept(out, "hashtree")

    def root(self) -> tuple[str | None, int]:
        """The digest and the number of rows; None and 0 of no rows."""
        found = self.nodes.filter("depth = 0").first()  # one row
        return (found["h"], found["n"]) if found else (None, 0)

    def differing(self, other: HashTree) -> DataFrame | None:
        """The leaves (node) that differ; None if there are none. Trees have one depth."""
        if self.depth != other.depth:
            raise ValueError("trees of different depth")
        nodes = None
        for d in range(self.depth + 1):
            mine, theirs = self.nodes.filter(F.col("depth") == d), other.nodes.filter(F.col("depth") == d)
            if nodes is not None:
                above = nodes.withColumnRenamed("node", "_above")
                under = lambda side: side.withColumn("_above", F.left("node", F.lit(d - 1))).join(above, "_above", "left_semi")  # noqa: B023, E731
                mine, theirs = under(mine), under(theirs)
            both = mine.select("node", "h").join(theirs.select("node", F.col("h").alias("o")), "node", "full")
            nodes = kept(both.filter(~F.col("h").eqNullSafe(F.col("o"))).select("node"), "differing")
            if nodes.isEmpty():
                return None
        return nodes

    def _in(self, nodes: DataFrame) -> DataFrame:
        place = F.sha2(F.coalesce(F.col(self.key).cast("string"), F.lit("-")).cast("binary"), 256)
        return self.rows.select(F.col(self.key).alias("key"), row_digest([self.key, *self.columns]).alias("digest"), F.left(place, F.lit(self.depth)).alias("node")).join(nodes, "node", "left_semi")


def changed_keys(a: HashTree, b: HashTree) -> DataFrame:
    """key, change: missing (only in ``a``), extra (only in ``b``), changed. Rows of leaves that differ are all that is joined."""
    nodes = a.differing(b)
    if nodes is None:
        return a.rows.select(F.col(a.key).alias("key"), F.lit("").alias("change")).limit(0)
    mine = a._in(nodes).groupBy("key").agg(F.sort_array(F.collect_list("digest")).alias("mine"))
    theirs = b._in(nodes).groupBy("key").agg(F.sort_array(F.collect_list("digest")).alias("theirs"))
    both = mine.join(theirs, mine["key"].eqNullSafe(theirs["key"]), "full").select(F.coalesce(mine["key"], theirs["key"]).alias("key"), "mine", "theirs")
    change = F.when(F.col("theirs").isNull(), "missing").when(F.col("mine").isNull(), "extra").when(F.col("mine") != F.col("theirs"), "changed")
    return both.select("key", change.alias("change")).filter("change is not null")


def agreeing_reads(first: DataFrame, second: DataFrame, key: str, columns: Sequence[str]) -> tuple[str | None, int]:
    """Digest and count of a table that was read twice; an error names keys on which the reads differ."""
    a = HashTree(first, key, columns)
    b = HashTree(second, key, columns, a.depth)
    if a.root() != b.root():
        some = [f"{r['key']} ({r['change']})" for r in changed_keys(a, b).orderBy("key").limit(10).collect()]
        raise ValueError(f"two reads differ: {', '.join(some)}")
    return a.root()
