"""Queries without SQL: cleaning, positions in texts, streams; each is tested on its own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import cleaned
from ..functions.position import located
from ..session import remove_at_exit, shared_folder
from ..streaming.memory import counted, remembered
from ..streaming.refresh import activity, newest, to_process

QUERIES: dict = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_clean(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", cleaned(F.col("text")).alias("text"))


def fuzzy_position(spark, sf_dir):
    """Where each page's title stands in its text."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("needle"), F.regexp_replace("html", "<[^>]*>", " ").alias("hay"))
    return p.select("page_id", located(F.col("needle"), F.col("hay")).alias("p")).select("page_id", "p.start", "p.end", "p.ratio", "p.strategy")


def event_activity(spark, sf_dir):
    """The stream of events read to its end, by hour; windows go to a table as they close, the last ones by one row
    far ahead that closes them."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = f"{shared_folder(spark)}/folioforge-activity-{uuid.uuid4().hex[:12]}"
    remove_at_exit(spark, folder)
    last = events.agg(F.max("ts").alias("ts")).filter("ts is not null")
    end = last.select(*[(F.col("ts") + F.expr("interval 1 day") if c == "ts" else F.lit(None)).cast(t).alias(c) for c, t in events.dtypes])
    events.write.parquet(f"{folder}/in/part=0")
    stream = lambda: spark.readStream.schema(events.schema).parquet(f"{folder}/in/*")
    for step in (None, end):
        if step is not None:
            step.write.parquet(f"{folder}/in/part=1")
        query = activity(stream()).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema("start timestamp, event_type string, n long, total double").parquet(f"{folder}/out").filter("event_type is not null").withColumn("start", F.col("start").cast("timestamp_ntz"))


def refresh_plan(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_key"), F.col("n_chars").cast("string").alias("date_modified"))
    known = d.filter("item_key % 2 = 0").select("item_key", F.when(F.col("item_key") % 4 == 0, "failed").otherwise("indexed").alias("status"), F.when(F.col("item_key") % 8 == 0, "old").otherwise(F.col("date_modified")).alias("date_modified"))
    return to_process(newest(d), known)


def refresh_memory(spark, sf_dir):
    """Events as attempts on users' items, read as a stream in two parts with one checkpoint between them."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("item_key"), F.col("ts").cast("timestamp").alias("at"), F.date_format("ts", "yyyy-MM-dd").alias("date_modified"), F.when(F.floor("value") % 10 == 0, "ok").otherwise("failed").alias("outcome"))
    folder = f"{shared_folder(spark)}/folioforge-memory-{uuid.uuid4().hex[:12]}"
    remove_at_exit(spark, folder)
    e = e.groupBy("item_key", "at").agg(F.min("date_modified").alias("date_modified"), F.max("outcome").alias("outcome"))  # one attempt a moment
    half = e.agg(F.percentile_approx(F.unix_micros("at"), 0.5).alias("h")).first()["h"]
    for i, part in enumerate((F.unix_micros("at") <= F.lit(half), F.unix_micros("at") > F.lit(half))):
        e.filter(part).write.parquet(f"{folder}/in/part={i}")
        stream = spark.readStream.schema(e.schema).parquet(f"{folder}/in/*")
        query = counted(remembered(stream)).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema("item_key long, at timestamp, decision string, tries int").parquet(f"{folder}/out").withColumn("at", F.col("at").cast("timestamp_ntz"))


SQL["refresh_memory"] = """
with a as (select user_id, ts, min(strftime(ts, '%Y-%m-%d')) as d, max(case when floor(value) % 10 = 0 then 'ok' else 'failed' end) as o from events group by all),
f as (select *, row_number() over (partition by user_id, d order by ts) = 1 as first from a),
g as (select *, coalesce(max(case when first and o = 'ok' then 1 else 0 end) over (partition by user_id order by ts rows between unbounded preceding and 1 preceding), 0) as done from f)
select user_id as item_key, ts as "at", case when not first or done = 1 then 'skipped' when o = 'ok' then 'indexed' else 'failed' end as decision, (sum(case when first and done = 0 then 1 else 0 end) over (partition by user_id order by ts))::int as tries from g"""
QUERIES["refresh_memory"] = refresh_memory
QUERIES |= {"text_clean_v2": text_clean, "fuzzy_position": fuzzy_position, "event_activity": event_activity, "refresh_plan": refresh_plan}
SQL["refresh_plan"] = "select doc_id as item_key, n_chars::varchar as date_modified from documents where doc_id % 2 <> 0 or (doc_id % 8 = 0 and n_chars::varchar <> 'old')"
SQL["event_activity"] = "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 6) as total from events group by all"
