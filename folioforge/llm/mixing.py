"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same expected number of copies: its source's target over its
source's size. The whole part is certain; the fractions are rounded pairwise: of two documents, one
takes as much of the other's fraction as fits, chosen at random so that both expectations stand,
until one of them is whole. Pairs are neighbours by size, so that what one loses the other gains in
words too. Groups of bounded size do this apart; each leaves at most one open document, and those
meet level by level in a reduction tree until a source has one, which is rounded at random.

Random numbers are hashes of the seed and of the two documents, and groups are hashes of rows, so
reruns agree whatever the partitions are. Rows that agree in id, source and text are one document of as
many copies: their fractions add up, and what is taken is spread evenly over them, so no group holds
more of them than of others. Targets are found by levels, one sum over the sources each.

Defined cases: null text has size 0; a null source is a source, last in order; a null id is hashed as
such; repeated rows are told apart by other columns only, each with its share; equal sizes are ordered by hash;
a document or source of size 0 takes 0; no rows give no rows; extra columns are kept by the mix itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import comparable, WORD, mix_int, pick, place_of, written

#: Rows of a leaf group, and open rows that meet in a group of each further level.
LEAF, FAN = 4096, 256
#: Equal rows that one row is expanded into at a time.
EQUAL = 8192


def pivot(ids: Sequence[int], fractions: Sequence[float], seed: int) -> tuple[np.ndarray, int]:
    """Round fractions in the order given. Returns them, 0 or 1 but for one at most, and that one's place (-1: none)."""
    p = [float(x) for x in fractions]
    top, held = 1.0 - 1e-12, -1
    for j, b in enumerate(p):
        if b <= 1e-12 or b >= top:
            p[j] = float(round(b))
            continue
        if held < 0:
            held = j
            continue
        a = p[held]
        u = mix_int(mix_int(int(ids[held]) ^ seed) + int(ids[j]) + j) / 2.0**64
        if a + b < 1.0:
            stays = u * (a + b) < a
            p[held], p[j] = (a + b, 0.0) if stays else (0.0, a + b)
        else:
            whole = u * (2.0 - a - b) < 1.0 - b
            p[held], p[j] = (1.0, a + b - 1.0) if whole else (a + b - 1.0, 1.0)
        open_ = [i for i in (held, j) if 1e-12 < p[i] < top]
        for i in (held, j):
            if i not in open_:
                p[i] = float(round(p[i]))
        held = open_[0] if open_ else -1
    return np.array(p, float), held


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds _rank, from 0 by name (null last): sorted by ranges, counted by partition."""
    null_last = [F.col("source").isNull(), F.col("source")]
    each = sources.repartitionByRange(*null_last).sortWithinPartitions(*null_last)
    place = F.monotonically_increasing_id()  # the partition above 33 bits, the row's number below
    each = written(each.select("*", F.shiftright(place, 33).alias("_range"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("_local")), "mix-ranks")
    counts = sorted((r["_range"], r["n"]) for r in each.groupBy("_range").agg(F.count("*").alias("n")).collect())  # a row a partition
    before, rows = 0, [(-1, 0)]
    for part, n in counts:
        rows.append((part, before))
        before += n
    offsets = sources.sparkSession.createDataFrame(rows, "_range long, _before long")
    return each.join(F.broadcast(offsets), "_range").withColumn("_rank", F.col("_before") + F.col("_local")).drop("_range", "_before", "_local")


def targets(sources: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """``sources`` has source, source_size (and more); adds target. All share by weight; those above
    their cap get it, the rest share what is left, until none is above."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = _ranked(sources).withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    ranked = written(ranked, "mix-weights")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = None, -1
    while True:
        above = F.lit(False) if level is None else F.col("_cap") < F.lit(level) * F.col("_w") * (1 - 1e-15)
        r = ranked.agg(F.sum(F.when(above, F.col("_cap")).otherwise(0.0)).alias("held"), F.sum(F.when(above, 0.0).otherwise(F.col("_w"))).alias("w"), F.count_if(above).alias("n")).first()
        if r["n"] == capped or not r["w"]:
            break
        level, capped = (total - r["held"]) / r["w"], r["n"]
    target = F.col("_cap") if level is None else F.least(F.col("_cap"), F.lit(level) * F.col("_w"))
    return ranked.withColumn("target", target).drop("_w", "_cap", "_rank")


def _rounder(seed: int, last: bool):
    """Round one group, longest documents first, so that what stays open is short."""

    def rounded(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "rid"], ascending=[False, True], kind="stable").reset_index(drop=True)
        p, held = pivot(pdf["rid"].to_numpy(), pdf["part"].to_numpy(), seed)
        if last and held >= 0:
            u = mix_int(mix_int(int(pdf["rid"].iloc[held]) ^ seed) + 7919) / 2.0**64
            p[held], held = float(u < p[held]), -1
        pdf["part"] = p
        pdf["open"] = np.arange(len(pdf)) == held
        return pdf

    return rounded


def _row_hash(doc_id, source, text):
    return F.xxhash64(doc_id, source.cast("string"), text.cast("string"))


def _plan(docs: DataFrame, weights: Sequence[float], cap: float, seed: int, text: str, doc_id: str, source: str) -> DataFrame:
    """rid, doc_id, source, size, n, source_size, target, copies: one row for each group of equal rows."""
    words = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    slim = pick(docs, doc_id=doc_id, source=source, text=text).select("doc_id", F.col("source").cast("string").alias("source"), words.alias("size"), _row_hash(F.col("doc_id"), F.col("source"), F.col("text")).alias("rid"))
    slim = written(slim.groupBy("doc_id", "source", "size", "rid").agg(F.count("*").alias("n")), "mix-sizes")
    sources = targets(slim.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("_rows")), weights, cap)
    sources = written(sources.withColumn("_groups", F.ceil(F.col("_rows") / F.lit(LEAF)).cast("long")), "mix-targets")
    widest = sources.agg(F.max("_groups")).first()[0] or 1
    goal = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(F.lit(0.0)) * F.col("n")
    rows = slim.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select(
        "d.doc_id", "d.source", "d.size", "d.rid", "d.n", "s.source_size", "s.target", F.pmod(F.xxhash64("d.rid"), F.col("s._groups")).alias("grp"), goal.alias("_goal")
    )
    rows = rows.withColumn("whole", F.floor("_goal").cast("long")).withColumn("part", F.col("_goal") - F.floor("_goal")).drop("_goal").withColumn("open", F.lit(False))
    done, level, schema = [], 0, rows.schema
    while True:
        last = widest <= 1
        found = rows.groupBy("source", "grp").applyInPandas(_rounder(seed + level, last), schema)
        found = written(found, f"mix-level{level}")
        done.append(found.filter(~F.col("open")))
        if last:
            break
        rows = found.filter("open").withColumn("grp", F.floor(F.col("grp") / F.lit(FAN)).cast("long"))
        widest, level = -(-widest // FAN), level + 1
    return reduce(DataFrame.unionByName, done).withColumn("copies", F.col("whole") + F.round("part").cast("long")).drop("grp", "whole", "part", "open")


def _each(rows: DataFrame, n: str, number: str) -> DataFrame:
    """Every row ``n`` times, numbered from 0 in ``number``. A row of very many is expanded in blocks that are dealt out."""
    few = rows.filter(F.col(n) <= EQUAL).withColumn(number, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)))
    blocks = rows.filter(F.col(n) > EQUAL).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / EQUAL))))
    blocks = blocks.repartition("rid", "_block")
    least = F.least(F.col(n) - 1, (F.col("_block") + 1) * EQUAL - 1)
    many = blocks.withColumn(number, F.explode(F.sequence(F.col("_block") * EQUAL, least))).drop("_block")
    return few.filter(F.col(n) > 0).unionByName(many)


def _share(copies: str, n: str, number: str):
    """Of ``copies`` spread evenly over ``n`` rows, those of the row so numbered."""
    return F.floor(F.col(copies) / F.col(n)) + (F.col(number) < F.col(copies) % F.col(n)).cast("long")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, seed: int = 20240229, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row for each row of ``docs``."""
    rows = _each(_plan(docs, weights, cap, seed, text, doc_id, source), "n", "_k").withColumn("copies", _share("copies", "n", "_k"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "rid")


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, seed: int = 20240229, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs``, all their columns, each as often as it is taken."""
    plan = _plan(docs, weights, cap, seed, text, doc_id, source).filter("copies > 0").select("rid", "n", "copies")
    columns = [f"c{i}" for i in range(len(docs.columns))]
    flat = docs.toDF(*columns)
    at = [F.lit(None) if i is None else F.col(f"c{i}") for i in (place_of(docs, doc_id), place_of(docs, source), place_of(docs, text))]
    joined = flat.withColumn("rid", _row_hash(*at)).join(plan, "rid")
    one = joined.filter("n = 1").withColumn("times", F.col("copies"))
    # Rows that agree in id, source and text: first those that agree in all, then their places among the others.
    order = F.struct(*comparable(flat, columns)).alias("_order")
    equal = joined.filter("n > 1").select("rid", "n", "copies", F.struct(*columns).alias("_row"), order)
    equal = equal.groupBy("rid", "n", "copies", "_order").agg(F.any_value("_row").alias("_row"), F.count("*").alias("m"))
    before = Window.partitionBy("rid").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    equal = equal.withColumn("first", F.coalesce(F.sum("m").over(before), F.lit(0)))
    extra = F.greatest(F.lit(0), F.least(F.col("m"), F.col("copies") % F.col("n") - F.col("first")))
    equal = equal.withColumn("times", F.col("m") * F.floor(F.col("copies") / F.col("n")) + extra)
    taken = one.select("rid", "times", *columns).unionByName(equal.select("rid", "times", "_row.*"))
    return _each(taken, "times", "_k").select(*columns).toDF(*docs.columns)
