"""Places and running sums over any number of rows: partitions by range, an offset for each, windows inside of them only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept

#: Groups of partitions whose offsets are broadcast, at most.
FEW_RUNS = 100_000


def running(rows: DataFrame, value: Column, order: list[Column], by: list[str] | None = None, name: str = "before") -> DataFrame:
    """``rows`` with the sum of ``value`` (a whole number) over the rows before each, by ``order`` among those that agree in ``by``.
    Rows are ranged by both, so one group may hold most of them; rows that agree in all come in any order."""
    groups, keys = list(by or []), {f"_o{i}": c for i, c in enumerate(order)}
    ranged = rows.withColumns(keys | {"_value": value.cast("long")}).repartitionByRange(*groups, *keys).sortWithinPartitions(*groups, *keys)
    placed = kept(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()).drop(*keys), "running")
    runs = placed.groupBy("_part", *groups).agg(F.sum("_value").alias("_sum"))
    of = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))  # a row a partition
    earlier = of.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = kept(runs.select("_part", *groups, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_earlier")), "offsets")
    hint = F.broadcast(runs) if runs.count() <= FEW_RUNS else runs
    same = placed["_part"] == runs["_part"]
    for g in groups:
        same &= placed[g].eqNullSafe(runs[g])
    inside = Window.partitionBy("_part", *groups).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    met = placed.join(hint, same).select(*[placed[c] for c in placed.columns], "_earlier")
    return met.withColumn(name, F.col("_earlier") + F.coalesce(F.sum("_value").over(inside), F.lit(0))).drop("_earlier", "_value", "_part", "_at")


def numbered(rows: DataFrame, order: list[Column], by: list[str] | None = None, name: str = "place") -> DataFrame:
    """``rows`` with their number, from 0, by ``order`` among those that agree in ``by``."""
    return running(rows, F.lit(1), order, by, name)


def start_pages(rows: DataFrame, chars: str, order: list[Column], by: list[str], per_page: int = 1800) -> DataFrame:
    """``rows`` with page: the pages of ``per_page`` characters that are full before each begins, among those that agree in ``by``."""
    held = running(rows, F.coalesce(F.col(chars), F.lit(0)), order, by, "_chars")
    return held.withColumn("page", F.floor(F.col("_chars") / per_page).cast("long")).drop("_chars")


def quantile(rows: DataFrame, value: str, share: float, by: list[str], name: str = "quantile") -> DataFrame:
    """The exact quantile of each group, between its two nearest values as far as it lies between them; nulls are left out. Groups may be
    few and large: values are ranged, not gathered."""
    held = rows.filter(F.col(value).isNotNull()).select(*by, value)
    counts = held.groupBy(*by).agg(F.count("*").alias("_n"))
    at = (F.col("_n") - 1) * F.lit(float(share))
    placed = numbered(held, [F.col(value)], by, "_place")
    same = F.lit(True)
    for g in by:
        same &= placed[g].eqNullSafe(counts[g])
    near = placed.join(counts, same).select(*[placed[g] for g in by], placed[value].alias("_v"), "_place", at.alias("_at")).filter((F.col("_place") == F.floor("_at")) | (F.col("_place") == F.ceil("_at")))
    low, high = F.min_by("_v", "_place"), F.max_by("_v", "_place")
    return near.groupBy(*by).agg((low + (high - low) * (F.max("_at") - F.floor(F.max("_at")))).alias(name))
