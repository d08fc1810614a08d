"""Peak detection, polarity, gap recovery and QRS boundaries over packed signals.

A recording-channel is one row (keys, fs_hz, values); whole-signal kernels run
in Arrow batches of rows (``mapInArrow``), so there is no shuffle and a batch
holds as many signals as Spark gives it.  Decisions that need no signal are
column expressions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import kernels as K

#: Fixed values of the detectors.
NEGATIVE_RATIO, GAP_RATIO, STRICT, RELAXED, REFRACTORY_S = 0.70, 1.65, 0.5, 0.25, 0.25
VOTE_BAND, VOTE_SMOOTH_S, VOTE_WINDOW_S, VOTE_MARGIN, VOTE_EVENTS, AMBIGUOUS = (5.0, 20.0), 0.04, 0.20, 0.12, 8, 0.10
EDGE_BAND, EDGE_SMOOTH_S, EDGE_SEARCH_S, EDGE_ENERGY, EDGE_AMPLITUDE, EDGE_RUN = (5.0, 25.0), 0.012, 0.16, 0.15, 0.10, 3


def checked(values: Sequence[float], fs: float, least: int) -> np.ndarray:
    x = np.asarray(values, dtype=float)
    if x.ndim != 1 or len(x) < least:
        raise ValueError(f"signal of {x.size} samples in {x.ndim} dimensions; {least} or more in one are needed")
    if not np.isfinite(x).all():
        raise ValueError("signal has values that are not finite")
    if not (math.isfinite(fs) and fs > 0):
        raise ValueError(f"sampling rate {fs} is not usable")
    return x


def per_signal(signals: DataFrame, fn: Callable[[np.ndarray, float, dict], list[dict]], schema: str, keys: Sequence[str] = ("recording_id", "channel"), extra: Sequence[str] = ()) -> DataFrame:
    """Rows ``fn(values, fs_hz, other columns)`` of every signal, with its keys and an ``error`` column.

    A signal that ``fn`` refuses (ValueError) gives one row with the message
    instead of failing the job.
    """
    typed = signals.select(*keys, F.col("fs_hz").cast("double").alias("fs_hz"), F.col("values").cast("array<double>").alias("values"), *extra)
    key_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in typed.select(*keys).schema)
    full = f"{key_schema}, {schema}, error string"
    target = to_arrow_schema(StructType.fromDDL(full))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            lists = batch.column(batch.schema.get_field_index("values"))
            edges = lists.offsets.to_numpy()
            flat = lists.values.slice(edges[0], edges[-1] - edges[0]).to_numpy(zero_copy_only=False)  # missing values become NaN
            samples = [flat[a:b] if there else None for a, b, there in zip(edges[:-1] - edges[0], edges[1:] - edges[0], lists.is_valid().to_pylist())]
            for x, row in zip(samples, batch.drop_columns(["values"]).to_pylist()):
                key = {k: row[k] for k in keys}
                try:
                    rows += [{**key, **r} for r in fn(x, row["fs_hz"], row)]
                except (ValueError, TypeError) as e:
                    rows.append({**key, "error": str(e)})
            yield pa.RecordBatch.from_pylist(rows, schema=target)

    return typed.mapInArrow(run, full)


def candidates(z: np.ndarray, fs: float, scale: float, fraction: float = STRICT, distance_s: float = REFRACTORY_S) -> tuple[np.ndarray, np.ndarray]:
    return K.find_peaks(z, max(1, round(distance_s * fs)), fraction * scale)


def polarity_of(x: np.ndarray, fs: float) -> dict:
    """Polarity by the number of candidates on either side."""
    z = x - np.median(x)
    scale = float(np.std(z))
    out = {"polarity": "positive", "confidence": 0.0, "positive_score": 0.0, "negative_score": 0.0, "positive_candidates": 0, "negative_candidates": 0}
    if not (math.isfinite(scale) and scale > 0):
        return out
    counts = {}
    for name, signal in (("positive", z), ("negative", -z)):
        peaks, prom = candidates(signal, fs, scale)
        counts[name] = len(peaks)
        out[f"{name}_candidates"] = len(peaks)
        out[f"{name}_score"] = float(np.median(prom) / max(scale, 1e-8)) if len(prom) else 0.0
    up, down = counts["positive"], counts["negative"]
    out["confidence"] = abs(up - down) / max(up, down, 1)
    if up and down and down / up < NEGATIVE_RATIO:
        out["polarity"] = "negative"
    return out


def peaks_of(x: np.ndarray, fs: float, polarity: str = "positive", fraction: float = STRICT, distance_s: float = REFRACTORY_S, empty_scale: float = 0.0) -> tuple[np.ndarray, np.ndarray, str]:
    """(peaks, prominences, polarity used)."""
    if polarity not in ("positive", "negative", "adaptive"):
        raise ValueError(f"unknown polarity {polarity!r}")
    z = x - np.median(x)
    scale = float(np.std(z)) or empty_scale
    if not (math.isfinite(scale) and scale > 0):
        return np.empty(0, dtype=np.int64), np.empty(0), "positive" if polarity == "adaptive" else polarity
    if polarity == "adaptive":
        polarity = polarity_of(x, fs)["polarity"]
    return *candidates(z if polarity == "positive" else -z, fs, scale, fraction, distance_s), polarity


def recovered_of(x: np.ndarray, fs: float, peaks: np.ndarray, polarity: str = "positive", gap_ratio: float = GAP_RATIO, fraction: float = RELAXED) -> tuple[np.ndarray, np.ndarray]:
    """The most prominent relaxed candidate (the first of equals) strictly inside each long gap."""
    none = np.empty(0, dtype=np.int64), np.empty(0)
    peaks = np.asarray(peaks, dtype=np.int64)
    if len(peaks) < 2:
        return none
    if (np.diff(peaks) <= 0).any() or peaks[0] < 0 or peaks[-1] >= len(x):
        raise ValueError("peaks do not rise inside the signal")
    if not (math.isfinite(gap_ratio) and gap_ratio > 1):
        raise ValueError(f"gap ratio {gap_ratio} is not above 1")
    if not (math.isfinite(fraction) and fraction > 0):
        raise ValueError(f"prominence share {fraction} is not positive")
    relaxed, prom, _ = peaks_of(x, fs, polarity, fraction)
    gaps = np.diff(peaks)
    found = []
    for g in np.flatnonzero(gaps > gap_ratio * np.median(gaps)):
        low, high = np.searchsorted(relaxed, peaks[g], side="right"), np.searchsorted(relaxed, peaks[g + 1], side="left")
        if high > low:
            found.append(low + int(np.argmax(prom[low:high])))
    return (relaxed[found], prom[found]) if found else none


def vote_of(x: np.ndarray, fs: float) -> dict:
    """QRS-first polarity: steep events in the band, then a signed vote around each."""
    nyquist = fs / 2
    low, high = min(VOTE_BAND[0], 0.4 * nyquist), min(VOTE_BAND[1], 0.9 * nyquist)
    centred = x - np.median(x)
    band = K.bandpass(centred, fs, low, high, short="once") if 0 < low < high else centred
    env = K.envelope(band, fs, VOTE_SMOOTH_S)
    events, _ = K.find_peaks(env, max(1, round(REFRACTORY_S * fs)), 0.25 * K.robust_scale(env))
    out = {"polarity": "positive", "confidence": 0.0, "positive_score": 0.0, "negative_score": 0.0, "qrs_events": len(events), "positive_events": 0, "negative_events": 0, "ambiguous_events": 0, "rr_regularity": 0.0, "qrs_band_energy_ratio": 0.0}
    if not len(events):
        return out
    radius = max(8, round(VOTE_WINDOW_S * fs / 2))
    lean, energy = np.empty(len(events)), np.empty(len(events))
    for i, at in enumerate(events.tolist()):
        span = slice(max(0, at - radius), at + radius + 1)
        local = x[span] - np.median(x[span])
        up, down = np.maximum([local.max(), -local.min()], 0) / K.robust_scale(local)
        lean[i] = (up - down) / max(up + down, 1e-8)
        energy[i] = np.mean(band[span] ** 2)
    plus, minus = lean > VOTE_MARGIN, lean < -VOTE_MARGIN
    n_plus, n_minus = int(plus.sum()), int(minus.sum())
    out |= {"positive_events": n_plus, "negative_events": n_minus, "ambiguous_events": len(events) - n_plus - n_minus}
    w_plus, w_minus = float(np.maximum(lean, 0).mean()), float(np.maximum(-lean, 0).mean())
    if len(events) > 1:
        rr = np.diff(events) / fs
        out["rr_regularity"] = float(1 / (1 + np.std(rr) / max(np.mean(rr), 1e-8)))
    if n_plus + n_minus < VOTE_EVENTS:
        return out | {"positive_score": w_plus, "negative_score": w_minus}
    trust = 0.5 + 0.5 * out["rr_regularity"]
    s_plus = n_plus / (n_plus + n_minus) * trust + 0.5 * w_plus
    s_minus = n_minus / (n_plus + n_minus) * trust + 0.5 * w_minus
    margin = abs(s_plus - s_minus) / max(s_plus + s_minus, 1e-8)
    e_plus, e_minus = float(energy[plus].mean()) if n_plus else 0.0, float(energy[minus].mean()) if n_minus else 0.0
    return out | {
        "polarity": "positive" if s_plus >= s_minus else "negative",
        "confidence": float(margin if margin >= 0.08 and n_plus != n_minus else margin / 2),
        "positive_score": float(s_plus),
        "negative_score": float(s_minus),
        "qrs_band_energy_ratio": e_plus / max(e_minus, 1e-8) if e_plus and e_minus else 0.0,
    }


def boundaries_of(x: np.ndarray, fs: float, centres: Sequence[int], search_s: float = EDGE_SEARCH_S, energy: float = EDGE_ENERGY, amplitude: float = EDGE_AMPLITUDE, run: int = EDGE_RUN) -> list[dict]:
    """Onset and offset around every centre; the signal is filtered once."""
    if not (math.isfinite(search_s) and search_s > 0) or not 0 < energy < 1 or not 0 < amplitude < 1 or run < 1:
        raise ValueError("delineation: search time, shares or run length out of range")
    nyquist = fs / 2
    low, high = min(EDGE_BAND[0], 0.4 * nyquist), min(EDGE_BAND[1], 0.9 * nyquist)
    centred = x - np.median(x)
    band = K.bandpass(centred, fs, low, high) if 0 < low < high else centred
    env, size, half = K.envelope(band, fs, EDGE_SMOOTH_S), np.abs(band), max(4, round(search_s * fs))
    tiny, out = np.finfo(float).eps, []
    for c in map(int, centres):
        if not 0 <= c < len(x):
            raise ValueError(f"centre {c} lies outside the signal")
        a, b = max(0, c - half), min(len(x), c + half + 1)
        quiet = (env[a:b] < energy * max(env[a:b].max(), tiny)) | (size[a:b] < amplitude * max(size[a:b].max(), tiny))
        calm = np.convolve(quiet, np.ones(run), mode="valid") == run  # calm[i]: quiet from i to i + run - 1
        before = np.flatnonzero(calm[: max(0, c - a - run + 2)])
        after = np.flatnonzero(calm[c - a :])
        onset = a + int(before[-1]) + run - 1 if len(before) else a
        offset = c + int(after[0]) if len(after) else b - 1
        out.append({"onset": min(onset, c), "offset": max(offset, c), "center": c, "onset_found": bool(len(before)), "offset_found": bool(len(after))})
    return out


# --- DataFrame operators ----------------------------------------------------------------

POLARITY = "polarity string, confidence double, positive_score double, negative_score double, positive_candidates int, negative_candidates int"
VOTE = "polarity string, confidence double, positive_score double, negative_score double, qrs_events int, positive_events int, negative_events int, ambiguous_events int, rr_regularity double, qrs_band_energy_ratio double"
PEAKS = "r_index long, prominence double, polarity string"


def select_polarity(signals: DataFrame, keys: Sequence[str] = ("recording_id", "channel")) -> DataFrame:
    return per_signal(signals, lambda v, fs, _: [polarity_of(checked(v, fs, 8), fs)], POLARITY, keys)


def vote_polarity(signals: DataFrame, keys: Sequence[str] = ("recording_id", "channel")) -> DataFrame:
    return per_signal(signals, lambda v, fs, _: [vote_of(checked(v, fs, 32), fs)], VOTE, keys)


def hybrid_polarity(signals: DataFrame, ambiguity: float = AMBIGUOUS, keys: Sequence[str] = ("recording_id", "channel")) -> DataFrame:
    """The count-based polarity where it is confident, the QRS vote where it is not."""
    if not (math.isfinite(ambiguity) and 0 <= ambiguity <= 1):
        raise ValueError(f"ambiguity {ambiguity} is outside [0, 1]")
    counted = select_polarity(signals, keys)
    unsure = counted.where(F.col("error").isNull() & (F.col("confidence") < ambiguity)).select(*keys)
    voted = vote_polarity(signals.join(unsure, list(keys), "left_semi"), keys).select(*keys, F.struct("polarity", "confidence").alias("__v"))
    both = counted.select(*keys, F.struct("polarity", "confidence").alias("__c"), "error").join(voted, list(keys), "left")
    pick = F.coalesce("__v", "__c")
    return both.select(*keys, pick["polarity"].alias("polarity"), pick["confidence"].alias("confidence"), F.col("__v").isNull().alias("fallback_used"), "error")


def detect_peaks(signals: DataFrame, polarity: str = "positive", recovery: bool = False, gap_ratio: float = GAP_RATIO, min_distance_s: float = REFRACTORY_S, prominence_factor: float = STRICT, keys: Sequence[str] = ("recording_id", "channel")) -> DataFrame:
    """Stage-1 peaks of every signal, optionally with one more in each long gap."""

    def run(v, fs, _):
        x = checked(v, fs, 8)
        peaks, prom, used = peaks_of(x, fs, polarity, prominence_factor, min_distance_s)
        if recovery:
            more, more_prom = recovered_of(x, fs, peaks, used, gap_ratio)
            merged = dict(zip(peaks.tolist(), prom.tolist())) | dict(zip(more.tolist(), more_prom.tolist()))
            return [{"r_index": i, "prominence": merged[i], "polarity": used} for i in sorted(merged)]
        return [{"r_index": int(i), "prominence": float(p), "polarity": used} for i, p in zip(peaks, prom)]

    return per_signal(signals, run, PEAKS, keys)


def delineate(signals: DataFrame, centres: DataFrame, keys: Sequence[str] = ("recording_id", "channel"), at: str = "r_index", **settings) -> DataFrame:
    """QRS onset and offset of every centre."""
    lists = centres.groupBy(*keys).agg(F.array_sort(F.collect_list(F.col(at).cast("bigint"))).alias("centres"))
    joined = signals.join(lists, list(keys))
    return per_signal(joined, lambda v, fs, row: boundaries_of(checked(v, fs, 32), fs, row["centres"], **settings), "onset long, offset long, center long, onset_found boolean, offset_found boolean", keys, ["centres"])


def filter_kernel(baseline: bool = False, highpass_hz: float | None = None, lowpass_hz: float | None = None, notch_hz: float | None = None, notch_q: float = 30.0) -> Callable[[Sequence[float], float], np.ndarray]:
    """(values, fs) -> filtered values: baseline, high-pass, low-pass and notch in this order, zero phase."""
    if highpass_hz is not None and lowpass_hz is not None and highpass_hz >= lowpass_hz:
        raise ValueError(f"high-pass at {highpass_hz} Hz leaves nothing below the low-pass at {lowpass_hz} Hz")

    def run(v: Sequence[float], fs: float) -> np.ndarray:
        x = checked(v, fs, 16)
        for kind, cutoff in (("highpass", 0.5 if baseline else None), ("highpass", highpass_hz), ("lowpass", lowpass_hz), ("notch", notch_hz)):
            if cutoff is None:
                continue
            if not (math.isfinite(cutoff) and 0 < cutoff < fs / 2):
                raise ValueError(f"{kind} at {cutoff} Hz is outside (0, {fs / 2})")
            sections = K.notch(cutoff, notch_q, fs) if kind == "notch" else K.butterworth(4, kind, fs, cutoff)
            x = K.zero_phase(sections, x, 9 if kind == "notch" else 15)
        return x

    return run


def filter_signals(signals: DataFrame, baseline: bool = False, highpass_hz: float | None = None, lowpass_hz: float | None = None, notch_hz: float | None = None, notch_q: float = 30.0, keys: Sequence[str] = ("recording_id", "channel")) -> DataFrame:
    """keys and ``filtered``: baseline, high-pass, low-pass and notch in this order, zero phase; ``values`` stay as they are."""
    run = filter_kernel(baseline, highpass_hz, lowpass_hz, notch_hz, notch_q)
    return per_signal(signals, lambda v, fs, _: [{"filtered": run(v, fs)}], "filtered array<double>", keys)


_DETECTORS: dict[str, Callable[[np.ndarray, float], Sequence[int]]] = {}


def register_detector(name: str, fn: Callable[[np.ndarray, float], Sequence[int]]) -> None:
    """Name a user detector: (signal, fs) -> sample indices."""
    _DETECTORS[name] = fn


def run_detector(signals: DataFrame, name: str, keys: Sequence[str] = ("recording_id", "channel")) -> DataFrame:
    """Peaks of a registered detector, held to whole, non-negative, strictly rising indices."""
    fn = _DETECTORS[name]

    def run(v, fs, _):
        x = checked(v, fs, 8)
        got = np.asarray(fn(x, fs), dtype=float)
        if got.ndim != 1 or not np.isfinite(got).all() or (got != np.floor(got)).any() or (got < 0).any() or (np.diff(got) <= 0).any():
            raise ValueError(f"detector {name} gave indices that are not whole, non-negative and rising")
        return [{"r_index": int(i)} for i in got]

    return per_signal(signals, run, "r_index long", keys)


def local_maxima_rows(samples: DataFrame, keys: Sequence[str] = ("recording_id",), order: Sequence[str] = ("sample_index",), value: str = "value") -> DataFrame:
    """Samples above both neighbours, in the long layout (window functions only)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    v: Column = F.col(value)
    return samples.withColumn("__up", (v > F.lag(v).over(w)) & (v > F.lead(v).over(w))).where("__up").drop("__up")


def polarity_audit(signals: DataFrame, ambiguity: float = AMBIGUOUS, keys: Sequence[str] = ("recording_id", "channel")) -> DataFrame:
    """Per signal: the count-based and the voted polarity, whether they agree, and the guarded choice."""
    counted = select_polarity(signals, keys).select(*keys, F.col("polarity").alias("counted"), F.col("confidence").alias("counted_confidence"), "positive_candidates", "negative_candidates", "error")
    voted = vote_polarity(signals, keys).select(*keys, F.col("polarity").alias("voted"), F.col("confidence").alias("voted_confidence"), "qrs_events")
    both = counted.join(voted, list(keys), "left")
    chosen = F.when(F.col("counted_confidence") >= ambiguity, F.col("counted")).otherwise(F.col("voted"))
    return both.withColumn("agree", F.col("counted") == F.col("voted")).withColumn("chosen", chosen)
