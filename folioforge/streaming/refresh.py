"""Incremental refresh of an index: what arrives is skipped if it is indexed, retried if it failed before and has
changed since, and published batch by batch; and when a refresh is due."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import kept
from ..sources.layers import LayeredIndex
from ..sources.store import IndexStore


def is_due(policy: str, last: datetime | None, now: datetime) -> bool:
    """manual never, startup always, daily after a day, every_N after N days; at once if never done."""
    if policy == "manual":
        return False
    if policy == "startup" or last is None:
        return policy == "startup" or policy == "daily" or policy.startswith("every_")
    days = 1 if policy == "daily" else int(policy.removeprefix("every_"))
    return now - last >= timedelta(days=days)


def to_process(arrived: DataFrame, state: DataFrame) -> DataFrame:
    """Rows of ``arrived`` (item_key, date_modified, ...) that ``state`` (item_key, status, date_modified)
    does not hold as indexed, or holds as failed with another date."""
    known = state.select("item_key", "status", F.col("date_modified").alias("_seen"))
    joined = arrived.join(known, "item_key", "left")
    wanted = F.col("status").isNull() | ((F.col("status") == "failed") & ~F.col("date_modified").eqNullSafe(F.col("_seen")))
    return joined.filter(wanted).drop("status", "_seen")


def newest(arrived: DataFrame) -> DataFrame:
    """The latest arrival of each key; dates compare as text."""
    return arrived.groupBy("item_key").agg(F.max_by(F.struct(*arrived.columns), F.coalesce("date_modified", F.lit(""))).alias("r")).select("r.*")


STATE = "item_key {key}, status string, date_modified string, batch long"


def refresh(stream: DataFrame, store: IndexStore | LayeredIndex, checkpoint: str, embed):
    """Starts a query over what has arrived, then stops. All columns of what is embedded reach the store; a layered index writes
    no more than these rows. ``embed`` turns rows (item_key, document,
    date_modified, ...) into rows with an embedding, null where that failed. What became of each key lies beside the
    checkpoint, by batch, so a repeated batch replaces its own share; the newest entry of a key counts."""
    spark, state = stream.sparkSession, f"{checkpoint.rstrip('/')}-state"
    schema = STATE.format(key=stream.schema["item_key"].dataType.simpleString())

    def batch(rows: DataFrame, number: int) -> None:
        spark.createDataFrame([], schema).write.mode("append").parquet(f"{state}/batch=-1")
        seen = spark.read.schema(schema).parquet(state).filter((F.col("batch") >= 0) & (F.col("batch") < number))
        known = seen.groupBy("item_key").agg(F.max_by(F.struct("status", "date_modified"), "batch").alias("x")).select("item_key", "x.*")
        made = kept(embed(to_process(newest(rows), known)), "refreshed")
        good = made.filter("embedding is not null")
        if not good.isEmpty():
            store.upsert(good)
        outcome = made.select("item_key", F.when(F.col("embedding").isNull(), "failed").otherwise("indexed").alias("status"), "date_modified")
        outcome.write.mode("overwrite").parquet(f"{state}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """An extension over event streams: counts and sums of each event type by window, for rows up to ``late`` behind."""
    framed = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
    return framed.agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
