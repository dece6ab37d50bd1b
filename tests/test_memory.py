"""Streams that remember: failed items, and sources behind a breaker, against plain folds; restarts and counters."""

import random
from datetime import datetime, timedelta

from folioforge.streaming import memory

START = datetime(2024, 1, 1)


def _run(spark, folder, n, rows, schema, transform):
    spark.createDataFrame(rows, schema).write.parquet(f"file://{folder}/in/part={n}")
    stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(f"file://{folder}/in/*")
    query = transform(stream).writeStream.format("parquet").option("path", f"file://{folder}/out").option("checkpointLocation", f"file://{folder}/check").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_failures_are_remembered_over_restarts(spark, tmp_path):
    schema = "item_key string, at timestamp, date_modified string, outcome string"
    at = lambda i: START + timedelta(seconds=i)
    first = [("a", at(1), "d1", "failed"), ("a", at(2), "d1", "ok"), ("b", at(1), "d1", "ok"), ("b", at(3), "d2", "failed"), ("c", at(1), None, "failed")]
    second = [("a", at(10), "d1", "ok"), ("a", at(11), "d2", "ok"), ("a", at(12), "d3", "ok"), ("c", at(10), None, "ok"), ("d", at(10), "d", "failed")]
    transform = lambda s: memory.counted(memory.remembered(s))
    assert memory.counters(_run(spark, tmp_path, 0, first, schema, transform)) == {"seen": 5, "indexed": 1, "failed": 2, "skipped": 2, "extracted": 0, "timeout": 0, "metadata_only": 0, "closed": 0}
    _run(spark, tmp_path, 1, second, schema, transform)
    got = sorted((r.item_key, r.at, r.decision, r.tries) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    want = [("a", at(1), "failed", 1), ("a", at(2), "skipped", 1), ("a", at(10), "skipped", 1), ("a", at(11), "indexed", 2), ("a", at(12), "skipped", 2), ("b", at(1), "indexed", 1), ("b", at(3), "skipped", 1), ("c", at(1), "failed", 1), ("c", at(10), "skipped", 1), ("d", at(10), "failed", 1)]
    assert got == sorted(want)


def _fold(rows, most, cooldown):
    out, state = [], {}
    for source, key, at, outcome in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        run, until = state.get(source, (0, START - timedelta(days=1)))
        if at < until:
            out.append((source, key, at, "metadata only"))
            continue
        run = run + 1 if outcome == "timeout" else 0
        if run >= most:
            run, until = 0, at + timedelta(seconds=cooldown)
        out.append((source, key, at, "timeout" if outcome == "timeout" else "extracted"))
        state[source] = (run, until)
    return sorted(out)


def test_a_breaker_opens_and_closes(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice("xyz"), i, START + timedelta(seconds=20 * i), "timeout" if rng.random() < 0.75 else "ok") for i in range(300)]
    schema = "source string, item_key long, at timestamp, outcome string"
    for n, part in enumerate((rows[:100], rows[100:], [("w", 999, START + timedelta(days=2), "ok")], [("w", 1000, START + timedelta(days=3), "ok")])):
        _run(spark, tmp_path, n, part, schema, lambda s: memory.guarded(s, most=3, cooldown=200))
    found = spark.read.parquet(f"file://{tmp_path}/out").collect()
    got = sorted((r.source, r.item_key, r.at, r.decision) for r in found if r.decision != "closed" and r.source != "w")
    assert got == _fold(rows, 3, 200) and any(r[3] == "metadata only" for r in got)
    assert all(r.item_key is None for r in found if r.decision == "closed")
