"""Beats and phenotypes from peaks: window functions over ordered beats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite_or_null, heart_rate, let, median_of, total

VALUE_FIELDS = ("heart_rate_bpm", "rr_prev_s", "r_amplitude", "qrs_width_proxy_s")


def rr_intervals(peaks: DataFrame, keys: Sequence[str] = ("recording_id",), order: Sequence[str] = ("r_index",), time: str = "r_time_s") -> DataFrame:
    """Previous and next interval and heart rate of every beat."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = peaks.withColumn("rr_prev_s", F.col(time) - F.lag(time).over(w)).withColumn("rr_next_s", F.lead(time).over(w) - F.col(time))
    return rows.withColumn("heart_rate_bpm", heart_rate("rr_prev_s", "rr_next_s"))


def segment_beats(peaks: DataFrame, recordings: DataFrame, pre_s: float = 0.35, post_s: float = 0.55, keys: Sequence[str] = ("recording_id",)) -> DataFrame:
    """Distinct peaks inside the recording with clipped windows.

    ``peaks``: keys, r_index; ``recordings``: keys, n_samples, time_start_s, time_end_s, fs_hz.
    """
    if pre_s < 0 or post_s < 0:
        raise ValueError("beat window must not be negative")
    inside = peaks.select(*keys, "r_index").distinct().join(recordings, list(keys)).where("r_index >= 0 AND r_index < n_samples")
    timed = inside.withColumn("r_time_s", F.col("time_start_s") + F.col("r_index") / F.col("fs_hz"))
    clipped = timed.withColumn("start", F.greatest("time_start_s", F.col("r_time_s") - pre_s)).withColumn("end", F.least("time_end_s", F.col("r_time_s") + post_s))
    beats = rr_intervals(clipped, keys)
    index = (F.row_number().over(Window.partitionBy(*keys).orderBy("r_index")) - 1).cast("int")
    return beats.select(*keys, index.alias("index"), "r_index", "r_time_s", "start", "end", "rr_prev_s", "rr_next_s", "heart_rate_bpm")


def smoothed_amplitude(samples: DataFrame, keys: Sequence[str] = ("recording_id",), order: Sequence[str] = ("sample_index",), value: str = "value", half: int = 2) -> DataFrame:
    """Mean over the samples at most ``half`` places away."""
    return samples.withColumn("r_amplitude", F.avg(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(-half, half)))


def local_baseline(samples: DataFrame, radius: int, keys: Sequence[str] = ("recording_id",), order: Sequence[str] = ("sample_index",), value: str = "value") -> DataFrame:
    """Median over the ``radius`` samples before and the ``radius`` from the sample on."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-radius, radius - 1)
    return samples.withColumn("baseline", F.percentile(value, F.lit(0.5)).over(w))


def beat_phenotypes(signals: DataFrame, peaks: DataFrame, keys: Sequence[str] = ("recording_id", "channel")) -> DataFrame:
    """Intervals, amplitude and width proxy of every beat.

    ``signals`` is the packed layout (keys, fs_hz, t0_s, values); windows are
    slices of the packed array, so samples are never joined one by one.
    """
    distinct = peaks.select(*keys, F.col("r_index").cast("int").alias("r_index")).distinct()
    here = distinct.join(signals, list(keys)).where("r_index >= 0 AND r_index < size(values)")
    here = here.withColumn("r_time_s", F.col("t0_s") + F.col("r_index") / F.col("fs_hz")).withColumn("__r", F.greatest(F.lit(1), F.bround(F.lit(0.2) * F.col("fs_hz")).cast("int")))
    here = here.withColumn("__lo", F.greatest(F.lit(0), F.col("r_index") - F.col("__r"))).withColumn("__hi", F.least(F.size("values"), F.col("r_index") + F.col("__r")))
    window = F.expr("slice(values, __lo + 1, __hi - __lo)")
    near = F.expr("slice(values, greatest(0, r_index - 2) + 1, least(size(values), r_index + 3) - greatest(0, r_index - 2))")
    here = here.select(*keys, "fs_hz", "r_index", "r_time_s", near.alias("__n"), window.alias("__w"))
    here = here.withColumn("r_amplitude", total(F.col("__n")) / F.size("__n"))
    away = let(median_of(F.col("__w")), lambda m: F.transform("__w", lambda v: F.abs(v - m)))

    def width(d: Column) -> Column:
        """Places of the first and last value of at least half the largest."""

        def span(limit: Column) -> Column:
            above = F.filter(F.transform(d, lambda v, i: F.when(v >= limit, i)), lambda i: i.isNotNull())
            return let(above, lambda a: F.when((F.size(d) > 5) & (limit > 0) & (F.size(a) >= 2), F.array_max(a) - F.array_min(a)))

        return let(0.5 * F.array_max(d), span)

    wide = let(away, width) / F.col("fs_hz")
    out = rr_intervals(here.withColumn("qrs_width_proxy_s", wide), keys)
    return out.select(*keys, F.col("r_index").cast("long").alias("r_index"), "r_time_s", "rr_prev_s", "rr_next_s", "heart_rate_bpm", "r_amplitude", "qrs_width_proxy_s")


def summary(phenotypes: DataFrame, keys: Sequence[str] = (), fields: Sequence[str] = VALUE_FIELDS, fast: float = 100.0, slow: float = 60.0) -> DataFrame:
    """Mean, median, sd and quartiles of each field; shares of fast and slow beats."""
    aggs = [F.count("*").alias("n_beats")]
    for f in fields:
        v = finite_or_null(f)
        q = F.percentile(v, F.lit([0.25, 0.5, 0.75]))
        aggs += [F.avg(v).alias(f"{f}_mean"), F.stddev_samp(v).alias(f"{f}_sd"), q.alias(f"__{f}")]
    rate = finite_or_null(fields[0])
    aggs += [F.avg((rate > fast).cast("double")).alias("share_fast"), F.avg((rate < slow).cast("double")).alias("share_slow")]
    out = phenotypes.groupBy(*keys).agg(*aggs)
    for f in fields:
        for i, name in enumerate(("p25", "median", "p75")):
            out = out.withColumn(f"{f}_{name}", F.get(f"__{f}", F.lit(i)))
        out = out.drop(f"__{f}")
    return out


def aggregate_by_unit(phenotypes: DataFrame, unit: str = "unit_id", fields: Sequence[str] = VALUE_FIELDS) -> DataFrame:
    """Per experimental unit: beats, and n, mean, median, sd of the finite values of each field."""
    aggs = [F.count("*").alias("n_beats")]
    for f in fields:
        v = finite_or_null(f)
        aggs += [F.count(v).alias(f"{f}_n"), F.avg(v).alias(f"{f}_mean"), F.percentile(v, F.lit(0.5)).alias(f"{f}_median"), F.stddev_samp(v).alias(f"{f}_sd")]
    return phenotypes.groupBy(unit).agg(*aggs)


def long_gaps(peaks: DataFrame, ratio: float = 1.65, keys: Sequence[str] = ("recording_id",), at: str = "r_index") -> DataFrame:
    """Gaps between neighbouring peaks longer than ``ratio`` times the median gap."""
    if not ratio > 1:
        raise ValueError("gap ratio must be greater than one")
    w = Window.partitionBy(*keys).orderBy(at)
    gaps = peaks.select(*keys, F.col(at).alias("left"), F.lead(at).over(w).alias("right")).where("right IS NOT NULL").withColumn("gap", F.col("right") - F.col("left"))
    typical = gaps.groupBy(*keys).agg(F.percentile("gap", F.lit(0.5)).alias("typical_gap"))
    return gaps.join(typical, list(keys)).where((F.col("typical_gap") > 0) & (F.col("gap") > ratio * F.col("typical_gap")))


def rr_regularity(peaks: DataFrame, keys: Sequence[str] = ("recording_id",), time: str = "r_time_s", order: str = "r_index") -> DataFrame:
    """1 / (1 + coefficient of variation of the intervals)."""
    w = Window.partitionBy(*keys).orderBy(order)
    gaps = peaks.select(*keys, (F.col(time) - F.lag(time).over(w)).alias("rr"))
    cv = F.stddev_pop("rr") / F.greatest(F.avg("rr"), F.lit(1e-8))
    return gaps.groupBy(*keys).agg(F.coalesce(1.0 / (1.0 + cv), F.lit(0.0)).alias("rr_regularity"))
