"""Matching in time: three greedy rules, range exclusion, interval overlap.

Range conditions are planned as equi-joins on time buckets of the tolerance's
width (a row meets its own and the two neighbouring buckets), then exact.

Greedy matching runs on parts of a key's time line: where neighbours of both lists merged
lie farther apart than the tolerance, no rule can pair across, so what lies before and
behind is matched apart (``time_parts``).  A recording of any length spreads over tasks;
only a chain of events each within the tolerance of the next stays together.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

_PAIRS = ArrayType(StructType().add("d", LongType()).add("r", LongType()))


def _positive(value: float, name: str) -> float:
    if not (math.isfinite(value) and value > 0):
        raise ValueError(f"{name} must be positive and finite")
    return value


@F.pandas_udf(_PAIRS)
def _paired(detected: pd.Series, reference: pd.Series, tolerance: pd.Series) -> pd.Series:
    out = []
    for d, r, tol in zip(detected, reference, tolerance):
        d, r = list(map(int, d)), list(map(int, r))
        i, j, pairs = 0, 0, []
        while i < len(d) and j < len(r):
            gap = d[i] - r[j]
            if abs(gap) <= tol:
                pairs.append({"d": d[i], "r": r[j]})
            i, j = i + (abs(gap) <= tol or gap < 0), j + (abs(gap) <= tol or gap >= 0)
        out.append(pairs)
    return pd.Series(out)


def paired(detected: Column, reference: Column, tolerance: Column) -> Column:
    """Array of (detected, reference) pairs of two sorted arrays.

    The earlier of the two heads is dropped unless both are within the
    tolerance, then both are paired: linear in the lists of a recording (a fold
    in SQL would copy the pairs at every step).
    """
    return _paired(detected, reference, tolerance.cast("double"))


def time_parts(events: DataFrame, keys: Sequence[str], at: str, tolerance: Column, width: Column | float) -> DataFrame:
    """``events`` with ``part``: the time at which the event's part of its key begins.

    A part begins at an event whose predecessor is more than ``tolerance`` earlier.  Order
    is looked up within buckets of ``width``; from bucket to bucket only the ends of each
    and its last beginning are carried, so no task sorts a whole recording.
    """
    rows = events.withColumn("__b", F.floor(F.col(at) / width).cast("long"))
    inside = Window.partitionBy(*keys, "__b").orderBy(at)
    before = F.lag(at).over(inside)
    rows = rows.withColumns({"__tol": tolerance, "__s": F.when(F.col(at) - before > tolerance, F.col(at))})
    rows = rows.withColumn("__in", F.max("__s").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ends = rows.groupBy(*keys, "__b").agg(F.min(at).alias("__low"), F.max(at).alias("__high"), F.max("__s").alias("__last"), F.first("__tol").alias("__t"))
    along = Window.partitionBy(*keys).orderBy("__b")
    fresh = F.coalesce(F.col("__low") - F.lag("__high").over(along) > F.col("__t"), F.lit(True))
    ends = ends.withColumn("__own", F.when(fresh, F.col("__low")))
    carried = F.last(F.coalesce("__last", "__own"), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(*keys, "__b", F.coalesce("__own", carried).alias("__first"))
    return rows.join(ends, [*keys, "__b"]).withColumn("part", F.coalesce("__in", "__first")).drop("__b", "__s", "__in", "__first", "__tol")


#: Buckets of ``time_parts`` in tolerances.
_BUCKET = 65_536


def matched_parts(detected: DataFrame, reference: DataFrame, fs_hz: float | DataFrame, tolerance_ms: float = 75.0, keys: Sequence[str] = ("recording_id",), at: str = "sample_index") -> DataFrame:
    """keys, part, fs_hz, detected and reference arrays and their pairs, a row for each part of a key.

    ``fs_hz``: one rate, or a table of keys and ``fs_hz``."""
    _positive(tolerance_ms, "tolerance")
    one = lambda df, name: df.select(*keys, F.col(at).cast("bigint").alias("__at"), F.lit(name).alias("__side"))
    events = one(detected, "d").unionByName(one(reference, "r"))
    events = events.join(fs_hz.select(*keys, "fs_hz"), list(keys)) if isinstance(fs_hz, DataFrame) else events.withColumn("fs_hz", F.lit(float(fs_hz)))
    tolerance = F.lit(tolerance_ms) * F.col("fs_hz") / 1000.0
    side = lambda name: F.array_sort(F.collect_list(F.when(F.col("__side") == name, F.col("__at"))))
    parts = time_parts(events, keys, "__at", tolerance, tolerance * _BUCKET).groupBy(*keys, "part").agg(F.first("fs_hz").alias("fs_hz"), side("d").alias("detected"), side("r").alias("reference"))
    return parts.withColumn("pairs", paired(F.col("detected"), F.col("reference"), tolerance))


def pair_matches(detected: DataFrame, reference: DataFrame, fs_hz: float | DataFrame, tolerance_ms: float = 75.0, keys: Sequence[str] = ("recording_id",), at: str = "sample_index") -> DataFrame:
    """``matched_parts`` put together: one row per key on either side, for recordings that fit a row."""
    parts = matched_parts(detected, reference, fs_hz, tolerance_ms, keys, at)
    lists = ("detected", "reference", "pairs")
    rows = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("part", *lists))).alias("p"), F.first("fs_hz").alias("fs_hz"))
    return rows.select(*keys, *[F.flatten(F.col(f"p.{c}")).alias(c) for c in lists], "fs_hz")


def match_metrics(matched: DataFrame, keys: Sequence[str] = ("recording_id",)) -> DataFrame:
    """Counts, rates and timing errors (ms) of every key of ``matched_parts`` or ``pair_matches``."""
    whole = lambda c: F.sum(F.size(c)).cast("long")
    tp, det, ref = F.col("true_positive"), F.col("detected_count"), F.col("reference_count")
    rate = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    rows = matched.groupBy(*keys).agg(F.first("fs_hz").alias("fs_hz"), whole("reference").alias("reference_count"), whole("detected").alias("detected_count"), whole("pairs").alias("true_positive"))
    rows = rows.select(*keys, "fs_hz", "reference_count", "detected_count", "true_positive", (det - tp).alias("false_positive"), (ref - tp).alias("false_negative"), rate(tp, ref).alias("sensitivity"), rate(tp, det).alias("positive_predictive_value"))
    s, p = F.col("sensitivity"), F.col("positive_predictive_value")
    rows = rows.withColumn("f1", F.coalesce(F.try_divide(2 * s * p, s + p), F.lit(0.0)))
    errors = F.transform("pairs", lambda p: (p["d"] - p["r"]) * 1000.0 / F.col("fs_hz"))
    timing = matched.select(*keys, F.explode(errors).alias("x")).groupBy(*keys).agg(
        F.avg("x").alias("mean_timing_error_ms"), F.percentile("x", F.lit(0.5)).alias("median_timing_error_ms"), F.stddev_samp("x").alias("sd_timing_error_ms"),
        F.avg(F.abs("x")).alias("mean_absolute_timing_error_ms"), F.percentile(F.abs("x"), F.lit(0.5)).alias("median_absolute_timing_error_ms"),
        F.percentile(F.abs("x"), F.lit(0.95)).alias("p95_absolute_timing_error_ms"), F.max(F.abs("x")).alias("max_absolute_timing_error_ms"),
    )
    return rows.join(timing, list(keys), "left")


def match_peaks(detected: DataFrame, reference: DataFrame, fs_hz: float | DataFrame, tolerance_ms: float = 75.0, keys: Sequence[str] = ("recording_id",), at: str = "sample_index") -> DataFrame:
    return match_metrics(matched_parts(detected, reference, fs_hz, tolerance_ms, keys, at), keys)


def tolerance_sweep(detected: DataFrame, reference: DataFrame, fs_hz: float, tolerances_ms: Sequence[float] = (50, 75, 100, 150), keys: Sequence[str] = ("recording_id",), at: str = "sample_index") -> DataFrame:
    """``match_peaks`` at several tolerances; parts are cut once, at the widest, which holds for all."""
    matched = matched_parts(detected, reference, fs_hz, max(tolerances_ms), keys, at)
    swept = matched.withColumn("tolerance_ms", F.explode(F.lit([float(t) for t in tolerances_ms])))
    swept = swept.withColumn("pairs", paired(F.col("detected"), F.col("reference"), F.col("tolerance_ms") * F.col("fs_hz") / 1000.0))
    return match_metrics(swept, [*keys, "tolerance_ms"])


def nearest_labels(candidates: DataFrame, references: DataFrame, tolerance: float, keys: Sequence[str] = ("recording_id",), at: str = "at", ref_at: str = "at", label: str | None = None) -> DataFrame:
    """label 1 for a candidate whose nearest reference (ties: the later) is within
    ``tolerance`` and not taken by an earlier candidate; there is no second choice.

    Nearest is found by carrying the last and next reference over the union of
    both, so a key is sorted once and never joined by range.
    """
    _positive(tolerance, "tolerance")
    extra = F.col(label).cast("string") if label else F.lit(None).cast("string")
    c = candidates.select(*keys, F.col(at).cast("double").alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast("string").alias("__l"))
    r = references.select(*keys, F.col(ref_at).cast("double").alias("__at"), F.lit(0).alias("__kind"), extra.alias("__l"))
    ref = F.when(F.col("__kind") == 0, F.struct(F.col("__at"), F.col("__l")))
    before = Window.partitionBy(*keys).orderBy("__at", F.desc("__kind")).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys).orderBy("__at", F.desc("__kind")).rowsBetween(0, Window.unboundedFollowing)
    both = c.unionByName(r).withColumn("__p", F.last(ref, ignorenulls=True).over(before)).withColumn("__n", F.first(ref, ignorenulls=True).over(after)).where("__kind = 1")
    ahead = F.coalesce(F.col("__n.__at") - F.col("__at") <= F.col("__at") - F.col("__p.__at"), F.col("__n").isNotNull())
    near = both.withColumn("__r", F.when(ahead, F.col("__n")).otherwise(F.col("__p"))).withColumn("__in", F.coalesce(F.abs(F.col("__r.__at") - F.col("__at")) <= tolerance, F.lit(False)))
    first = F.row_number().over(Window.partitionBy(*keys, "__in", "__r.__at").orderBy("__at")) == 1
    won = F.col("__in") & first
    return near.select(*keys, F.col("__at").alias("at"), won.cast("int").alias("label"), F.when(won, F.col("__r.__at")).alias("reference_at"), F.when(won, F.col("__r.__l")).alias("reference_label"))


@F.pandas_udf(ArrayType(DoubleType()))
def _agreeing(left: pd.Series, right: pd.Series, tolerance: pd.Series) -> pd.Series:
    """Distances of the pairs: each left time, in its order, takes the nearest right time not
    yet used (of equals the earlier in its list).  Used times are skipped by links, so a
    step costs next to nothing however many are used."""
    out = []
    for a, b, tol in zip(left, right, tolerance):
        order = np.argsort(np.asarray(b, dtype=float), kind="stable")
        at = np.asarray(b, dtype=float)[order]
        levels, starts = np.unique(at, return_index=True)  # equal times are one level, taken in their order
        free = np.diff(np.append(starts, len(at)))
        up, down = list(range(len(levels) + 1)), list(range(len(levels) + 1))  # next level with a free time; down is shifted by one
        taken = np.zeros(len(levels), dtype=np.int64)

        def find(link: list[int], i: int) -> int:
            while link[i] != i:
                link[i] = link[link[i]]
                i = link[i]
            return i

        errors = []
        for t in map(float, a):
            k = int(np.searchsorted(levels, t))
            above, below = find(up, k), find(down, k) - 1
            choice = []
            for i in {above, below}:
                if 0 <= i < len(levels) and abs(levels[i] - t) <= tol:
                    choice.append((abs(levels[i] - t), int(order[starts[i] + taken[i]]), i))
            if choice:
                gap, _, i = min(choice)
                errors.append(float(gap))
                taken[i] += 1
                if taken[i] == free[i]:
                    up[i], down[i + 1] = i + 1, i
        out.append(errors)
    return pd.Series(out)


def point_agreement(left: DataFrame, right: DataFrame, tolerance_s: float = 0.04, keys: Sequence[str] = ("recording_id",)) -> DataFrame:
    """Greedy agreement of point annotations of equal label and channel, in the order of ``seq``.

    Each left point takes the nearest right point not yet used.  The rule runs per (keys,
    label, channel) and part of the time line; rates are over all points of the key.
    """
    _positive(tolerance_s, "tolerance")
    group = [*keys, "label", "channel"]
    one = lambda df, name: df.where("type = 'point'").select(*group, "seq", F.col("time").cast("double").alias("time"), F.lit(name).alias("__side"))
    events = one(left, "l").unionByName(one(right, "r"))
    timed = time_parts(events.where("time IS NOT NULL AND label IS NOT NULL AND channel IS NOT NULL"), group, "time", F.lit(float(tolerance_s)), float(tolerance_s) * _BUCKET)
    lone = events.where("time IS NULL OR label IS NULL OR channel IS NULL").withColumn("part", F.lit(None).cast("double"))  # counted, matched with nothing
    item = lambda name: F.sort_array(F.collect_list(F.when(F.col("__side") == name, F.struct("seq", "time"))))
    both = timed.select(*group, "part", "__side", "seq", "time").groupBy(*group, "part").agg(item("l").alias("l"), item("r").alias("r"))
    counts = timed.select(*keys, "__side").unionByName(lone.select(*keys, "__side")).groupBy(*keys).agg(F.count_if(F.col("__side") == "l").alias("nl"), F.count_if(F.col("__side") == "r").alias("nr"))
    times = lambda side: F.transform(side, lambda x: x["time"])
    folded = both.select(*keys, _agreeing(times("l"), times("r"), F.lit(float(tolerance_s))).alias("e"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    sums = folded.groupBy(*keys).agg(F.sum(F.size("e")).alias("m"), F.sum(total(F.col("e"))).alias("s"))
    agg = counts.join(sums, list(keys), "left").withColumn("matches", F.coalesce("m", F.lit(0).cast("long")))
    return agg.select(*keys, "matches", (F.col("matches") / F.greatest("nl", "nr", F.lit(1))).alias("agreement_rate"), F.try_divide(F.col("s"), F.col("matches")).alias("mean_absolute_error_s"))


def exclude_near(rows: DataFrame, times: DataFrame, tolerance: float, keys: Sequence[str] = ("recording_id",), at: str = "time_s", other: str = "time_s") -> DataFrame:
    """Rows with no entry of ``times`` within ``tolerance`` of the same key (anti join)."""
    _positive(tolerance, "tolerance")
    bucket = lambda c: F.floor(F.col(c) / tolerance).cast("long")
    near = times.select(*keys, F.col(other).alias("__x"), F.explode(F.array(*[bucket(other) + i for i in (-1, 0, 1)])).alias("__b"))
    left = rows.withColumn("__bucket", bucket(at))
    on = [left[k] == near[k] for k in keys] + [left["__bucket"] == near["__b"], F.abs(left[at] - near["__x"]) <= tolerance]
    return left.join(near, on, "left_anti").drop("__bucket")


def interval_iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Overlap over hull; 0 where the intervals do not meet."""
    shared = F.greatest(F.lit(0.0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    return F.coalesce(F.try_divide(shared, F.greatest(a_end, b_end) - F.least(a_start, b_start)), F.lit(0.0))


def overlapping(left: DataFrame, right: DataFrame, width: float, keys: Sequence[str] = ("recording_id",)) -> DataFrame:
    """Pairs of overlapping intervals with their IoU, joined on time buckets of ``width``.

    A pair is kept in the bucket where its overlap begins, so it comes once.
    """
    spans = lambda df, p: df.select(*keys, F.col("id").alias(f"{p}_id"), F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end"), F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))).alias("__b"))
    joined = spans(left, "a").join(spans(right, "b"), [*keys, "__b"])
    begin = F.greatest("a_start", "b_start")
    hit = joined.where((begin < F.least("a_end", "b_end")) & (F.floor(begin / width) == F.col("__b")))
    return hit.select(*keys, "a_id", "b_id", interval_iou(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end")).alias("iou"))


def split_leakage(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that occur on both sides of a split (must be empty)."""
    return a.select(key).distinct().join(b.select(key), key, "left_semi")


def match_boundaries(found: DataFrame, reference: DataFrame, keys: Sequence[str] = ("recording_id",)) -> DataFrame:
    """Found and reference onset and offset of each centre (one reference a centre)."""
    ref = reference.select(*keys, "center", F.col("onset").alias("reference_onset"), F.col("offset").alias("reference_offset"))
    return found.join(ref, [*keys, "center"])
