"""Streaming twins: thinning, debounce, upsert feeds and the daily log sink."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def thin_stream(events: DataFrame, key: str, at: str, gap_seconds: float, watermark: str = "1 hour") -> DataFrame:
    """First-wins thinning with the time of the last kept event as the only state of a key; idle keys are evicted.

    A suppressed event doesn't extend the wait. Events of a batch are ordered in their key; later batches only go on.
    """
    schema = events.schema
    gap = pd.Timedelta(seconds=gap_seconds)

    def step(keys, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        rows = pd.concat(list(frames)).sort_values(at, kind="stable")
        keep = []
        for t in rows[at]:
            ok = last is None or t - last >= gap
            keep.append(ok)
            last = t if ok else last
        if last is not None:
            state.update((int(last.value // 1000),))
            state.setTimeoutTimestamp(max(int(last.value // 1_000_000) + int(gap_seconds * 2000), state.getCurrentWatermarkMs() + 1))
        yield rows[keep]

    return events.withWatermark(at, watermark).groupBy(key).applyInPandasWithState(step, schema, "last_us long", "append", GroupStateTimeout.EventTimeTimeout)


def debounce_stream(events: DataFrame, key: str, at: str, value: str, quiet: str = "500 milliseconds", watermark: str = "1 minute") -> DataFrame:
    """The last event of each run: a session window that closes after ``quiet`` without events."""
    return events.withWatermark(at, watermark).groupBy(F.session_window(at, quiet).alias("w"), key).agg(F.max_by(value, at).alias(value), F.max(at).alias(at), F.count("*").alias("changes")).drop("w")


def split_deletes(events: DataFrame, kind: str = "kind") -> tuple[DataFrame, DataFrame]:
    """Deletions apply at once; everything else waits to be debounced."""
    return events.where(F.col(kind) == "unlink"), events.where(F.col(kind) != "unlink")


def upsert_feed(stream: DataFrame, path: str, checkpoint: str, key: str = "uri", version: str = "version"):
    """Replace-by-key table kept by a stream: each batch's last list of a key replaces the stored one.

    Versions of the table alternate between two folders, so a lost batch can be run again.
    """
    from ..operators.diagnostics import replace_by_key

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        old, new = f"{path}/v{(epoch + 1) % 2}", f"{path}/v{epoch % 2}"
        try:
            state = spark.read.schema(batch.schema).parquet(old)
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
            state = batch.limit(0)
        replace_by_key(state, batch, key, version).write.mode("overwrite").parquet(new)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")


def daily_log(stream: DataFrame, path: str, checkpoint: str, trigger: str = "1 second"):
    """Append-only JSON log, a folder a day, flushed by the trigger."""
    from ..sources.logs import call_log

    return call_log(stream).writeStream.partitionBy("date").format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=trigger)
