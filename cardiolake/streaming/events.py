"""Structured Streaming extension: the same series as they arrive.

Not part of the batch surface: detection needs whole recordings.  Watermarks
bound the state; late rows beyond them are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _marked(events: DataFrame, delay: str | None) -> DataFrame:
    """With a watermark, unless the stream already has one (``delay`` None)."""
    return events.withWatermark("ts", delay) if delay else events


def deduplicated(events: DataFrame, delay: str | None = "1 hour") -> DataFrame:
    return _marked(events, delay).dropDuplicatesWithinWatermark(["event_id"])


def window_rates(events: DataFrame, length: str = "1 hour", slide: str | None = None, delay: str | None = "1 hour") -> DataFrame:
    """Events, mean and range of values per series and (sliding) window."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return _marked(events, delay).groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "low", "high")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str | None = "1 hour") -> DataFrame:
    return _marked(events, delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def running_intervals(events: DataFrame, timeout_ms: int = 3_600_000) -> DataFrame:
    """Interval to the previous event of the series; the state is one timestamp a series."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        if state.hasTimedOut:
            state.remove()
            return
        for frame in frames:
            t = frame["ts"].sort_values().astype("int64").to_numpy() / 1e9 if str(frame["ts"].dtype).endswith("[ns]") else frame["ts"].sort_values().map(pd.Timestamp.timestamp).to_numpy()
            before = [last, *t[:-1]]
            last = float(t[-1])
            yield pd.DataFrame({"user_id": key[0], "time_s": t, "rr_s": [None if b is None else float(a - b) for a, b in zip(t, before)]})
        state.update((last,))
        state.setTimeoutDuration(timeout_ms)

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, time_s double, rr_s double", "last double", "append", GroupStateTimeout.ProcessingTimeTimeout)
