"""Stateful streams: sessions with timers, and a join of two streams by time. Each equals a batch query over the same rows."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from declq.checkpoint import scratch

#: The state store that keyed state with timers needs.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SESSION = "user_id long, start timestamp, end timestamp, n long, total double"


class Sessions(StatefulProcessor):
    """State of a user: open sessions as (start, end, n, total) in microseconds of event time. A timer closes each.

    Events may come in any order within the watermark's delay, so one may join two sessions. A session is given once the
    watermark has passed its end by the gap, when no event can join it any more; then its state goes.
    """

    def __init__(self, gap_seconds: int):
        self.gap = gap_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "start long, end long, n long, total double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - names of the interface
        spans = [tuple(x) for x in self.open.get()] if self.open.exists() else []
        for part in rows:
            at = part["ts"].astype("datetime64[us]").astype("int64")
            spans += [(t, t, 1, 0.0 if v != v else v) for t, v in zip(at.tolist(), part["value"].astype(float).tolist())]
        self._keep(self._joined(spans))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        spans = [tuple(x) for x in self.open.get()] if self.open.exists() else []
        closed = [s for s in spans if s[1] + self.gap < passed]
        self._keep([s for s in spans if s[1] + self.gap >= passed])
        if closed:
            start, end, n, total = zip(*closed)
            times = {"start": pd.to_datetime(list(start), unit="us"), "end": pd.to_datetime(list(end), unit="us")}
            yield pd.DataFrame({"user_id": key[0], **times, "n": n, "total": total})

    def _joined(self, spans: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        for start, end, n, total in sorted(spans):
            if out and start - out[-1][1] <= self.gap:
                a, b, m, sum_ = out[-1]
                out[-1] = a, max(b, end), m + n, sum_ + total
            else:
                out.append((start, end, n, total))
        return out

    def _keep(self, spans: list[tuple]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not spans:
            self.open.clear()
            return
        self.open.put(spans)
        self.handle.registerTimer(min(s[1] for s in spans) // 1000 + self.gap // 1000 + 1)

    def close(self) -> None:
        pass


def closed_sessions(events: DataFrame, gap_seconds: int = 1800, late: str = "2 hours") -> DataFrame:
    """(user_id, start, end, n, total): sessions of a stream of events (ts, user_id, value), each once it can't change any more.

    Events more than `gap_seconds` apart are of different sessions; those later than the watermark are dropped; a null value
    counts as 0. Needs ROCKSDB as the session's state store (see with_state_store).
    """
    grouped = events.where("user_id is not null and ts is not null").select("user_id", "ts", "value").withWatermark("ts", late).groupBy("user_id")
    return grouped.transformWithStateInPandas(Sessions(gap_seconds), SESSION, "Append", "EventTime")


def followed(events: DataFrame, first: str, then: str, within: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(user_id, first_id, first_at, then_id, then_at): pairs of a user's event of type `first` and one of type `then` at most `within` after it.

    Both sides of the stream keep rows only while the other side's watermark leaves room for a partner.
    """
    side = lambda kind, name: events.where(F.col("event_type") == kind).select(F.col("event_id").alias(f"{name}_id"), F.col("user_id").alias(f"{name}_user"), F.col("ts").alias(f"{name}_at")).withWatermark(f"{name}_at", late)
    near = F.expr(f"first_user = then_user AND then_at >= first_at AND then_at <= first_at + INTERVAL {within}")
    return side(first, "first").join(side(then, "then"), near).select(F.col("first_user").alias("user_id"), "first_id", "first_at", "then_id", "then_at")


def with_state_store(spark: SparkSession) -> None:
    """Set the state store of streams that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def replayed(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """All that a stream gives for what there is now, as a table. With the same `folder` a later call goes on where this one stopped."""
    spark = stream.sparkSession
    folder = folder or scratch(spark, "stream")
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/rows").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
