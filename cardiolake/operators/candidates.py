"""Candidate features, labels and thresholds of the second detection stage."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.prefix import running
from .detection import checked, per_signal
from .matching import nearest_labels

#: Window lengths, bands and the names of the features, which are the output's contract.
N_SHAPE, WINDOW_S, QRS_S = 64, 0.25, 0.08
BANDS = ((0.5, 5.0), (5.0, 15.0), (15.0, 40.0), (40.0, 100.0))
FEATURE_NAMES = (
    "amplitude_z", "prominence_z", "width_s", "max_abs_slope", "mean_abs_slope", "local_rms", "crest_factor", "low_band_fraction", "qrs_band_fraction", "high_band_fraction", "very_high_band_fraction",
    "left_right_energy_ratio", "left_right_amplitude_ratio", "rr_prev_s", "rr_next_s", "rr_prev_ratio", "rr_next_ratio", *(f"shape_{i:02d}" for i in range(N_SHAPE)),
)


def features_of(x: np.ndarray, fs: float, at: Sequence[int], prominence: Sequence[float] | None = None, window_s: float = WINDOW_S) -> np.ndarray:
    """One row of ``FEATURE_NAMES`` per candidate.

    Neighbour intervals are the true ones of the whole candidate list; the ends
    take the median interval.
    """
    at = np.asarray(at, dtype=np.int64)
    prominence = np.zeros(len(at)) if prominence is None else np.asarray(prominence, dtype=float)
    if (at < 0).any() or (at >= len(x)).any():
        raise ValueError("a candidate lies outside the signal")
    if len(prominence) != len(at) or not np.isfinite(prominence).all():
        raise ValueError("one finite prominence a candidate is needed")
    if not (math.isfinite(window_s) and window_s > 0):
        raise ValueError(f"feature window {window_s} s is not usable")
    if not len(at):
        return np.empty((0, len(FEATURE_NAMES)), dtype=np.float32)
    base = x - np.median(x)
    scale = float(np.std(base)) or 1.0
    z, top = base / scale, 0.9 * fs / 2
    reach, half = max(16, round(fs * window_s)), max(4, round(fs * QRS_S))
    padded = np.pad(z, reach, mode="edge")
    wide = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + 1)[at]
    core = wide[:, reach - half : reach + half + 1]
    size, left, right = np.abs(core), core[:, :half], core[:, half + 1 :]
    energy = np.empty((len(at), len(BANDS)))
    for k, (low, high) in enumerate(BANDS):
        band = K.bandpass(z, fs, low, min(high, top), short="zeros") if low < min(high, top) else np.zeros_like(z)
        energy[:, k] = np.mean(np.lib.stride_tricks.sliding_window_view(np.pad(band, half, mode="edge"), 2 * half + 1)[at] ** 2, axis=1)
    rr = np.diff(at) / fs
    typical = float(np.median(rr)) if len(rr) else 1.0
    prev, nxt = np.concatenate([[typical], rr]), np.concatenate([rr, [typical]])
    slope = np.abs(np.diff(wide, axis=1)) * fs
    peak = size.max(axis=1)
    places = np.linspace(0, 2 * reach, N_SHAPE)
    below = np.minimum(places.astype(int), 2 * reach)
    above, share = np.minimum(below + 1, 2 * reach), places - below
    out = np.column_stack([
        z[at], prominence / scale, (size >= 0.5 * peak[:, None]).sum(axis=1) / fs, slope.max(axis=1), slope.mean(axis=1), np.sqrt((core**2).mean(axis=1)), peak / np.maximum(size.mean(axis=1), 1e-6),
        energy / np.maximum(energy.sum(axis=1, keepdims=True), 1e-8),
        (left**2).mean(axis=1) / np.maximum((right**2).mean(axis=1), 1e-6), np.abs(left).max(axis=1) / np.maximum(np.abs(right).max(axis=1), 1e-6),
        prev, nxt, prev / max(typical, 1e-6), nxt / max(typical, 1e-6), wide[:, below] * (1 - share) + wide[:, above] * share,
    ]).astype(np.float32)
    if not np.isfinite(out).all():
        raise ValueError("a feature overflowed")
    return out


def candidate_features(signals: DataFrame, peaks: DataFrame, keys: Sequence[str] = ("recording_id", "channel")) -> DataFrame:
    """(keys, r_index, features) of every candidate of ``peaks`` (keys, r_index, prominence)."""
    lists = peaks.where(F.col("r_index").isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("r_index", "prominence"))).alias("cands"))

    def run(v, fs, row):
        at = [c["r_index"] for c in row["cands"]]
        f = features_of(checked(v, fs, 16), fs, at, [c["prominence"] or 0.0 for c in row["cands"]])
        return [{"r_index": int(i), "features": r.tolist()} for i, r in zip(at, f)]

    return per_signal(signals.join(lists, list(keys)), run, "r_index long, features array<float>", keys, ["cands"])


def label_candidates(peaks: DataFrame, references: DataFrame, fs_hz: float, tolerance_s: float = 0.075, keys: Sequence[str] = ("recording_id",), at: str = "r_index") -> DataFrame:
    if not (math.isfinite(tolerance_s) and tolerance_s > 0 and math.isfinite(fs_hz) and fs_hz > 0):
        raise ValueError(f"rate {fs_hz} or tolerance {tolerance_s} is not usable")
    return nearest_labels(peaks, references, tolerance_s * fs_hz, keys, at, at).select(*keys, F.col("at").cast("long").alias(at), "label")


def threshold_for_recall(scored: DataFrame, target: float = 0.995, keys: Sequence[str] = (), label: str = "label", probability: str = "probability", tie: str | None = None) -> DataFrame:
    """Largest probability at which the recall of the rows at or above it reaches ``target``; else 0.

    Rows of one probability are counted together, so ties do not matter.
    """
    if not 0 < target <= 1:
        raise ValueError(f"recall {target} is outside (0, 1]")
    levels = scored.groupBy(*keys, probability).agg(F.sum(label).alias("__n"))
    if keys:
        w = Window.partitionBy(*keys).orderBy(F.desc(probability)).rowsBetween(Window.unboundedPreceding, 0)
        upto, total = levels.withColumn("__u", F.sum("__n").over(w)), F.sum("__n").over(Window.partitionBy(*keys))
    else:
        upto, total = running(levels, probability, "__n", "__u", descending=True), F.lit(levels.agg(F.sum("__n")).first()[0]).cast("long")
    reached = upto.withColumn("recall", F.try_divide(F.col("__u").cast("double"), total))
    return reached.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("recall") >= target, F.col(probability))), F.lit(0.0)).alias("threshold"))
