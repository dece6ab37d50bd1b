"""What a refresh remembers while it runs: items whose extraction failed, and sources that keep timing out.

Both are states of a stream: one row an item, or one a source, updated as attempts arrive and kept in the query's checkpoint, so a restart
goes on where it stopped. Attempts of one micro-batch are taken in the order of their time."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Consecutive timeouts that open a breaker, and for how long it stays open.
MOST_TIMEOUTS, COOLDOWN = 5, 600

_ITEM_STATE = "status string, date_modified string, tries int"
_SOURCE_STATE = "run int, open_until long"


def _remembered(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, date, tries = state.get if state.exists else (None, None, 0)
    arrived = pd.concat(rows).sort_values(["at", "date_modified", "outcome"], kind="stable")
    out = []
    for r in arrived.itertuples(index=False):
        if status == "indexed" or (status == "failed" and date == r.date_modified):
            out.append((key[0], r.at, "skipped", tries))
            continue
        status, date, tries = ("indexed" if r.outcome == "ok" else "failed"), r.date_modified, tries + 1
        out.append((key[0], r.at, status, tries))
    state.update((status, date, tries))
    yield pd.DataFrame(out, columns=["item_key", "at", "decision", "tries"])


def remembered(attempts: DataFrame) -> DataFrame:
    """item_key, at, decision, tries of a stream of attempts (item_key, at, date_modified, outcome: ok or failed): indexed,
    failed, or skipped: what is indexed already, and what failed before and has the same date since."""
    kind = attempts.schema["item_key"].dataType.simpleString()
    told = attempts.select("item_key", "at", F.coalesce("date_modified", F.lit("")).alias("date_modified"), "outcome").groupBy("item_key")
    return told.applyInPandasWithState(_remembered, f"item_key {kind}, at timestamp, decision string, tries int", _ITEM_STATE, "append", GroupStateTimeout.NoTimeout)


def _seconds(at: datetime) -> int:
    return int(pd.Timestamp(at).timestamp() * 1000)


def _breaker(most: int, cooldown: int):
    def guarded(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, until = state.get if state.exists else (0, 0)
        if state.hasTimedOut:  # time has passed without an attempt: closed again
            state.remove()
            yield pd.DataFrame([(key[0], None, pd.Timestamp(until, unit="ms"), "closed")], columns=["source", "item_key", "at", "decision"])
            return
        out = []
        for r in pd.concat(rows).sort_values(["at", "item_key"], kind="stable").itertuples(index=False):
            now = _seconds(r.at)
            if now < until:
                out.append((key[0], r.item_key, r.at, "metadata only"))
                continue
            run = run + 1 if r.outcome == "timeout" else 0
            if run >= most:
                run, until = 0, now + 1000 * cooldown
            out.append((key[0], r.item_key, r.at, "timeout" if r.outcome == "timeout" else "extracted"))
        state.update((run, until))
        if until > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(until)
        yield pd.DataFrame(out, columns=["source", "item_key", "at", "decision"])

    return guarded


def guarded(attempts: DataFrame, most: int = MOST_TIMEOUTS, cooldown: int = COOLDOWN, late: str = "10 minutes") -> DataFrame:
    """source, item_key, at, decision of a stream of attempts (source, item_key, at, outcome: ok or timeout): extracted or timeout;
    after ``most`` timeouts in a row of one source the breaker opens, and for ``cooldown`` seconds its items are indexed by
    metadata only. When the watermark passes that time without an attempt, a row says that it is closed."""
    kind = attempts.schema["item_key"].dataType.simpleString()
    told = attempts.select("source", "item_key", "at", "outcome").withWatermark("at", late).groupBy("source")
    return told.applyInPandasWithState(_breaker(most, cooldown), f"source string, item_key {kind}, at timestamp, decision string", _SOURCE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def counted(decisions: DataFrame, name: str = "decisions") -> DataFrame:
    """``decisions`` with counters that a query reports with each batch."""
    told = [F.count_if(F.col("decision") == d).alias(d.replace(" ", "_")) for d in ("indexed", "failed", "skipped", "extracted", "timeout", "metadata only", "closed")]
    return decisions.observe(name, F.count("*").alias("seen"), *told)


def counters(query: StreamingQuery, name: str = "decisions") -> dict[str, int]:
    """The sums of a query's counters over the batches that it reports."""
    total: dict[str, int] = {}
    for progress in query.recentProgress:
        for key, n in (progress.observedMetrics.get(name).asDict() if progress.observedMetrics.get(name) else {}).items():
            total[key] = total.get(key, 0) + n
    return total
