"""Streams: resumable ingest, latest-version upserts, activity windows, delivery de-duplication."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues


def resumable(stream: DataFrame, handle: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, signature: str) -> StreamingQuery:
    """K1: what arrives is handled once and appended to ``target``; a restart goes on where it stopped,
    another option signature starts afresh. The batch number is part of the path, so a batch that is
    run again replaces itself."""

    def save(batch: DataFrame, number: int) -> None:
        handle(batch).write.mode("overwrite").parquet(f"{target}/signature={signature}/batch={number}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{checkpoint}/{signature}").trigger(availableNow=True).start()


def latest_versions(rows: DataFrame) -> DataFrame:
    """The newest version of each source_path by (modified_at, version), nulls last; one maximum a path, so a path
    with many versions is combined early."""
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    at = F.struct(F.coalesce(F.unix_micros(F.col("modified_at").cast("timestamp")), F.lit(NEVER)).alias("at"), F.coalesce("version", F.lit(NEVER)).alias("version"))
    return rows.groupBy("source_path").agg(F.max_by(row, at).alias("row")).select("row.*")


#: The time of a version that names none: before all others.
NEVER = -(1 << 62)
ARRIVAL = "__arrival"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS = "spark.sql.shuffle.partitions"


class LatestVersion(StatefulProcessor):
    """Keeps the (modified_at, version) of the newest version that a path has had, and passes newer rows on.

    With ``idle`` (milliseconds) a path that gets nothing new for so long, by the time of arrival, is forgotten by a
    timer; should an old version of it come after that, it is passed on once more, which readers of the log aren't
    misled by.
    """

    def __init__(self, idle: int | None = None) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "at long, version long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        best = self.best.get()  # each question costs a round trip, so it isn't asked first whether there is any
        best = None if best is None else tuple(best)
        newest = None
        for part in rows:
            at = part["modified_at"].astype("datetime64[us]").astype("int64").where(part["modified_at"].notna(), NEVER)
            version = part["version"].fillna(NEVER).astype("int64")
            k = np.lexsort((version.to_numpy(), at.to_numpy()))[-1]
            own = int(at.iloc[k]), int(version.iloc[k])
            if best is None or own > best:
                best, newest = own, part.iloc[[k]]
        if newest is not None:
            self.best.update(best)
            if self.idle is not None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(int(time.time() * 1000) + self.idle)
            yield newest.drop(columns=ARRIVAL, errors="ignore")

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.best.clear()
        return iter([])

    def close(self) -> None:
        pass


def newer_versions(stream: DataFrame, idle: int | None = None) -> DataFrame:
    """K2: the rows of a stream (source_path, modified_at, version: a whole number, any others) that are newer than
    all their path had before, at most one a path and batch; older versions that come late lose."""
    rows = stream.withColumn("version", F.col("version").cast("long"))
    # rows are never late by their arrival, which the watermark, and so the timers, follow
    timed = rows.withColumn(ARRIVAL, F.current_timestamp()).withWatermark(ARRIVAL, "0 seconds")
    return timed.groupBy("source_path").transformWithStateInPandas(LatestVersion(idle), rows.schema, "Append", "EventTime")


def upsert_latest(stream: DataFrame, target: str, checkpoint: str, idle: int | None = None) -> StreamingQuery:
    """K2: append what is newer than before to the log in ``target``; ``read_latest`` reads the table. Nothing is
    rewritten, and state is one small row a path, kept by RocksDB on the executors and in the checkpoint. Each batch
    opens and saves every part of the state, so there are no more parts than cores, however many a shuffle has."""
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in (PROVIDER, PARTITIONS)}
    spark.conf.set(PROVIDER, ROCKS)  # a query keeps the settings it starts under
    # a setting that nobody has set has no value of its own, but a default
    spark.conf.set(PARTITIONS, str(min(int(spark.conf.get(PARTITIONS)), max(1, spark.sparkContext.defaultParallelism))))
    try:
        return newer_versions(stream, idle).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        for k, value in before.items():
            spark.conf.unset(k) if value is None else spark.conf.set(k, value)


def read_latest(spark: SparkSession, target: str) -> DataFrame:
    """The latest version of each path in the log that ``upsert_latest`` keeps."""
    return latest_versions(spark.read.parquet(target))


def activity(stream: DataFrame, keys: list[str], late: str = "2 days", window: str = "1 day") -> DataFrame:
    """K3: events of each key a day. In append mode a day comes once the watermark (``late`` behind the latest
    event) has passed its end; what comes for it after that is dropped and counted as late, and its state goes."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), *keys).agg(F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("day"), *keys, "events")


def append_activity(stream: DataFrame, keys: list[str], target: str, checkpoint: str, late: str = "2 days") -> StreamingQuery:
    """K3: closed days appended to ``target``; a restart goes on where it stopped."""
    return activity(stream, keys, late).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def state_progress(query: StreamingQuery) -> dict[str, int]:
    """Rows that a query's stateful operators dropped as late, removed from state, and keep now, by its progress."""
    steps = [op for p in query.recentProgress for op in p["stateOperators"]]
    kept = query.lastProgress["stateOperators"] if query.lastProgress else []
    return {"late": sum(op["numRowsDroppedByWatermark"] for op in steps), "removed": sum(op["numRowsRemoved"] for op in steps), "kept": sum(op["numRowsTotal"] for op in kept)}


def sliding(days: DataFrame, keys: list[str], lengths: tuple[int, ...], as_of: Column) -> DataFrame:
    """E7, E8 downstream of ``activity``: events of the last closed days of each length."""
    age = F.datediff(as_of, F.col("day"))
    return days.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when((age >= 0) & (age < n), F.col("events"))), F.lit(0)).alias(f"last_{n}d") for n in lengths])


def once(stream: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """K4: each delivery once, as long as repeats come within the watermark; a key's state goes when it has passed."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
