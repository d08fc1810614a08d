"""Structural checks of series, beats, annotations and phenotypes as DataFrame expressions.

Layouts: ``samples`` (recording_id, sample_index, time_s, channel columns or
channel/value), ``phenotypes`` and ``annotations`` as in the README.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import is_finite, nonblank

#: Names that mark a time column, in order of preference, and the review states.
TIME_NAMES = ("time", "t", "timestamp", "time_s", "seconds")
STATUSES = ("unreviewed", "accepted", "flagged")
MAX_WINDOW = 100_000


def guess_time_column(columns: Sequence[str]) -> str | None:
    named = {}
    for c in columns:
        named[str(c).strip().lower()] = c
    return next((named[n] for n in TIME_NAMES if n in named), None)


def unique_labels(labels: Sequence[str]) -> list[str]:
    """Blank names become channel_<position>, repeats get a running number that is not taken."""
    wanted = [str(x).strip() or f"channel_{i + 1}" for i, x in enumerate(labels)]
    taken, out = set(), []
    for name in wanted:
        label, k = name, 2
        while label in taken:
            label, k = f"{name}_{k}", k + 1
        taken.add(label)
        out.append(label)
    return out


def sampling_rate(samples: DataFrame, keys: Sequence[str] = ("recording_id",), order: str = "sample_index", time: str = "time_s") -> DataFrame:
    """Per recording: 1 / median of the positive finite steps, to six places."""
    step = F.col(time) - F.lag(time).over(Window.partitionBy(*keys).orderBy(order))
    steps = samples.select(*keys, step.alias("dt"))
    median = F.expr("percentile(CASE WHEN dt > 0 AND dt < double('Infinity') THEN dt END, 0.5)")
    return steps.groupBy(*keys).agg(F.round(F.try_divide(F.lit(1.0), median), 6).alias("fs_hz"))


def validate_series(df: DataFrame, time_col: str | None = None, keys: Sequence[str] = ("recording_id",), order: str = "sample_index") -> DataFrame:
    """One row per recording: errors, warnings, channels, rate, duration, valid.

    Every column besides keys, order and time is a channel.  ``order`` is the
    physical row order; it is not derived from time, so disorder is seen.
    """
    time_col = time_col or guess_time_column([c for c in df.columns if c not in keys and c != order])
    if time_col is None:
        counts = df.groupBy(*keys).agg(F.count("*").alias("n_samples"))
        return counts.select(
            *keys, F.array(F.lit("no time column")).alias("errors"), F.array().cast("array<string>").alias("warnings"), F.lit(None).cast("string").alias("time_col"),
            F.array().cast("array<string>").alias("signal_cols"), F.lit(None).cast("double").alias("fs_hz"), F.lit(None).cast("double").alias("duration_s"), "n_samples", F.lit(False).alias("valid"),
        )
    channels = [c for c in df.columns if c not in keys and c not in (order, time_col)]
    number = lambda c: F.expr(f"try_cast(`{c}` AS double)")
    base = df.select(*keys, F.col(order).alias("__o"), number(time_col).alias("__t"), *[number(c).alias(f"__c{i}") for i, c in enumerate(channels)])
    base = base.withColumn("__dt", F.col("__t") - F.lag("__t").over(Window.partitionBy(*keys).orderBy("__o")))
    stats = [
        F.count("*").alias("n_samples"),
        F.count_if(~is_finite("__t")).alias("bad_time"),
        F.count_if(F.col("__dt") <= 0).alias("not_rising"),
        F.stddev_pop("__dt").alias("dt_sd"),
        F.expr("percentile(__dt, 0.5)").alias("dt_median"),
        F.expr("percentile(CASE WHEN __dt > 0 THEN __dt END, 0.5)").alias("dt_positive"),
        (F.max("__t") - F.min("__t")).alias("duration_s"),
    ]
    for i in range(len(channels)):
        stats += [F.count(f"__c{i}").alias(f"n{i}"), F.count_if(F.isnan(f"__c{i}")).alias(f"nan{i}"), F.count_if(F.abs(f"__c{i}") == F.lit(float("inf"))).alias(f"inf{i}")]
    agg = base.groupBy(*keys).agg(*stats)
    fs = F.round(F.try_divide(F.lit(1.0), F.col("dt_positive")), 6)
    errors: list[Column] = [
        F.when(F.col("n_samples") < 2, "fewer than two samples"),
        F.when(F.col("bad_time") > 0, "time has missing or non-numeric values"),
        F.when(F.col("not_rising") > 0, "time must be strictly increasing"),
        F.when(F.col("duration_s") <= 0, "duration must be positive"),
    ]
    if not channels:
        errors.append(F.lit("no signal channels"))
    for i, c in enumerate(channels):
        usable = F.col(f"n{i}") - F.col(f"nan{i}")
        errors += [
            F.when(usable == 0, f"channel {c} is entirely missing"),
            F.when((usable > 0) & (usable < F.col("n_samples")), f"channel {c} has missing/non-numeric values"),
            F.when(F.col(f"inf{i}") > 0, f"channel {c} has infinite values"),
        ]
    warnings = [
        F.when(fs < 10, "very low sampling rate"),
        F.when(F.col("dt_sd") > F.greatest(0.01 * F.col("dt_median"), F.lit(1e-12)), "irregular sampling"),
    ]
    given = lambda xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    return agg.select(
        *keys, given(errors).alias("errors"), given(warnings).alias("warnings"), F.lit(time_col).alias("time_col"), F.lit(channels).cast("array<string>").alias("signal_cols"), fs.alias("fs_hz"), "duration_s", "n_samples"
    ).withColumn("valid", F.size("errors") == 0)


def require_valid(report: DataFrame) -> None:
    """Eager: raise with the first errors found (reads one row per bad recording, ten at most)."""
    bad = report.where(~F.col("valid")).limit(10).collect()
    if bad:
        raise ValueError("; ".join(sorted({e for r in bad for e in r["errors"]})))


def annotation_errors(start_bound: Column | float | None = None, end_bound: Column | float | None = None) -> Column:
    """Array of the faults of an annotation row (empty: valid).

    The rules are a table of (fault, who it concerns, what must hold); a rule that
    cannot be decided because a value is null counts as broken.
    """
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v).cast("double")
    low, high = as_col(0.0 if start_bound is None else start_bound), as_col(end_bound)
    start, end, time = F.col("start"), F.col("end"), F.col("time")
    kind = F.coalesce(F.col("type"), F.lit(""))
    every, interval, point = F.lit(True), kind == "interval", kind == "point"
    spans, timed = interval & start.isNotNull() & end.isNotNull(), point & time.isNotNull()
    rules = (
        ("type is neither interval nor point", every, kind.isin("interval", "point")),
        ("bounds are no finite range", every, is_finite(low) & (high.isNull() | (is_finite(high) & (high >= low)))),
        ("confidence lies outside [0, 1]", every, is_finite("confidence") & F.col("confidence").between(0, 1)),
        ("status is not one of " + ", ".join(STATUSES), every, F.col("status").isin(*STATUSES)),
        ("label is blank", every, nonblank("label")),
        ("channel is blank", every, nonblank("channel")),
        ("interval has an open side", interval, spans),
        ("interval carries the time of a point", interval, time.isNull()),
        ("interval has a side that is not finite", spans, is_finite(start) & is_finite(end)),
        ("interval does not last", spans, start < end),
        ("interval leaves the recording", spans & high.isNotNull(), (low <= start) & (end <= high)),
        ("point has no time", point, timed),
        ("point carries sides of an interval", point, start.isNull() & end.isNull()),
        ("point has a time that is not finite", timed, is_finite(time)),
        ("point leaves the recording", timed & high.isNotNull(), time.between(low, high)),
    )
    found = [F.when(concerned & ~F.coalesce(holds, F.lit(False)), F.lit(fault)) for fault, concerned, holds in rules]
    return F.array_compact(F.array(*found))


def quality_report(phenotypes: DataFrame, keys: Sequence[str] = ("recording_id",), order: str = "row", required: Sequence[str] = ("r_index", "r_time_s", "heart_rate_bpm", "r_amplitude"), tolerance: float = 1e-6) -> DataFrame:
    """Counts of structural faults of beat phenotypes per recording; ``valid`` if there is none."""
    if not (tolerance >= 0 and math.isfinite(tolerance)):
        raise ValueError(f"tolerance {tolerance} is not usable")
    w = Window.partitionBy(*keys).orderBy(order)
    rr, hr, index = F.col("rr_prev_s"), F.col("heart_rate_bpm"), F.col("r_index").cast("double")
    good_index = is_finite(index) & (index >= 0) & (index == F.floor(index))
    expected = F.try_divide(F.lit(60.0), rr)
    usable_rr = is_finite(rr) & (rr > 0)
    before = F.max("r_time_s").over(w.rowsBetween(-1, -1))
    rows = phenotypes.withColumn("__back", F.col("r_time_s") <= before)
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n_rows"),
        sum((F.count_if(F.col(c).isNull()) for c in required), F.lit(0)).cast("long").alias("missing_total"),
        sum((F.count_if(F.col(c).isNotNull() & ~is_finite(F.col(c).cast("double"))) for c in required), F.lit(0)).cast("long").alias("nonfinite_total"),
        F.count_if(F.col("r_index").isNotNull() & ~good_index).alias("invalid_r_indices"),
        (F.count_if(good_index) - F.count_distinct(F.when(good_index, index))).alias("duplicate_r_indices"),
        F.max(F.coalesce(F.col("__back"), F.lit(False)).cast("int")).cast("long").alias("time_nonmonotonic"),
        F.count_if(rr.isNotNull() & ~usable_rr).alias("invalid_rr"),
        F.count_if(usable_rr & is_finite(hr) & (F.abs(expected - hr) > F.greatest(F.lit(tolerance), F.abs(expected) * tolerance))).alias("inconsistent_heart_rate"),
    )
    faults = ["missing_total", "nonfinite_total", "invalid_r_indices", "duplicate_r_indices", "time_nonmonotonic", "invalid_rr", "inconsistent_heart_rate"]
    return out.withColumn("valid", sum((F.col(c) for c in faults), F.lit(0)) == 0)


def strict_indices(values: DataFrame, column: str, keys: Sequence[str] = ("recording_id",), order: str = "row") -> DataFrame:
    """Per key: is the series of finite, whole, non-negative and strictly rising numbers?"""
    v = F.col(column).cast("double")
    w = Window.partitionBy(*keys).orderBy(order)
    checked = values.withColumn("__ok", is_finite(v) & (v >= 0) & (v == F.floor(v)) & F.coalesce(v > F.lag(v).over(w), F.lit(True)))
    return checked.groupBy(*keys).agg(F.count_if(~F.col("__ok")).alias("n_bad")).withColumn("valid", F.col("n_bad") == 0)


def check_window(start: int, stop: int) -> None:
    if not 0 <= start < stop:
        raise ValueError(f"window [{start}, {stop}) is empty or starts before 0")
    if stop - start > MAX_WINDOW:
        raise ValueError(f"window of {stop - start} samples is wider than {MAX_WINDOW}")


_PROJECT, _RECORDING = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,63}"), re.compile(r"[0-9a-f]{32}")


def is_project_name(name: Column) -> Column:
    return F.coalesce(name.rlike(f"^(?:{_PROJECT.pattern})$"), F.lit(False))


def check_project_name(name: str) -> str:
    if not _PROJECT.fullmatch(name):
        raise ValueError(f"{name!r} is no project name")
    return name


def check_recording_token(token: str) -> str:
    if not _RECORDING.fullmatch(token):
        raise ValueError(f"{token!r} is no recording token")
    return token
