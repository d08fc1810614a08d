"""Registry of the named queries, and the driver tables in the engine's layouts.

An event series per user is a recording with irregular samples, an embedding is a
short uniform signal, ten embeddings in a row a longer one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tables import shared_path as scratch_path  # noqa: F401
from ..operators import beats

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Common table expressions of the SQL forms: event series with time in seconds, and beats with their intervals.
SERIES_SQL = "series AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)"
BEATS_SQL = SERIES_SQL + """, rr AS (SELECT *, t - lag(t) OVER w AS rr_prev, lead(t) OVER w - t AS rr_next FROM series WINDOW w AS (PARTITION BY user_id ORDER BY i)),
beats AS (SELECT *, 60.0 / CASE WHEN rr_prev > 0 THEN rr_prev WHEN rr_next > 0 THEN rr_next END AS hr FROM rr)"""


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL form."""

    def add(fn: Query) -> Query:
        _QUERIES[fn.__name__] = fn
        if sql:
            _SQL[fn.__name__] = sql.replace("{SERIES}", SERIES_SQL).replace("{BEATS}", BEATS_SQL)
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the long layout: user_id, sample_index, time_s, value, event_type, event_id."""
    e = table(spark, sf_dir, "events")
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))") / 1e6
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select("user_id", i.cast("long").alias("sample_index"), t.alias("time_s"), "value", "event_type", "event_id")


def phenotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series(spark, sf_dir).withColumnRenamed("sample_index", "r_index").withColumnRenamed("time_s", "r_time_s")
    return beats.rr_intervals(rows, ["user_id"]).withColumn("r_amplitude", F.col("value"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as packed signals of 64 Hz."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("recording_id"), F.col("label").cast("string").alias("channel"), F.lit(64.0).alias("fs_hz"), F.lit(0.0).alias("t0_s"), F.col("embedding").cast("array<double>").alias("values"))


def r6(c):
    return F.round(c, 6)


def long_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten embeddings in a row as one packed signal of 64 Hz."""
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).cast("long").alias("recording_id"), "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    packed = e.groupBy("recording_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "v"))), lambda x: x["v"])).alias("values"))
    return packed.select("recording_id", F.lit("x").alias("channel"), F.lit(64.0).alias("fs_hz"), F.lit(0.0).alias("t0_s"), "values")
