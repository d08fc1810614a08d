"""Filters and peak detection over recordings longer than a row.

A recording-channel is many rows: keys, fs_hz, n (samples of the whole), start (sample of
the first value), values; every chunk but the last has ``size`` samples and begins at a
multiple of it.  Results are those of the whole-signal kernels of ``detection``, at any size.

* Filters (``filter_chunks``): overlap-save.  A chunk is filtered with ``halo`` samples of
  its neighbours on either side, so many that what the filters remember from farther away
  has fallen below 1e-16 of the signal; at the ends of the recording the true ends are used.
* Peaks (``detect_chunks``): the median comes from refined histograms, the deviation from
  sums.  Maxima are found chunk by chunk; plateaus that reach a cut are put together from
  the runs at the cuts.  Thinning by distance keeps what is highest among its undecided
  neighbours, in rounds, until all is decided, which is what taking the highest first
  gives.  Prominences look for higher ground in their own chunk, then, by the extremes of
  the chunks alone, for the first chunk that has some, and ask that chunk.

A task holds a chunk and its halo, or the maxima of a stretch that are not yet decided.  Extremes, two numbers a chunk, and the few peaks that are the highest
of their chunk on one side are gathered per recording.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import kernels as K
from ..functions.quantiles import exact_quantiles
from ..functions.spacing import spread
from ..functions.tables import by_group, written
from . import detection as D

KEYS = ("recording_id", "channel")
#: Share of a signal that a filter may still remember of what lies behind the halo.
FORGOTTEN = 1e-16


def to_chunks(signals: DataFrame, size: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Chunks of packed signals."""
    n = F.size("values").cast("long")
    rows = signals.where(F.size("values") > 0).select(*keys, F.col("fs_hz").cast("double").alias("fs_hz"), n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(size).cast("long"))).alias("start"), "values")
    return rows.select(*keys, "fs_hz", "n", "start", F.slice(F.col("values").cast("array<double>"), (F.col("start") + 1).cast("int"), F.lit(size)).alias("values"))


def samples_to_chunks(samples: DataFrame, rates: DataFrame | float, size: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Chunks of the long layout (keys, sample_index, value); sample indices are 0, 1, ..."""
    own = samples.groupBy(*keys, F.expr(f"sample_index div {int(size)} * {int(size)}").alias("start")).agg(F.sort_array(F.collect_list(F.struct("sample_index", F.col("value").cast("double").alias("value")))).alias("s"))
    n = samples.groupBy(*keys).agg((F.max("sample_index") + 1).alias("n"))
    rated = n.join(rates.select(*keys, "fs_hz"), list(keys)) if isinstance(rates, DataFrame) else n.withColumn("fs_hz", F.lit(float(rates)))
    return own.join(rated, list(keys)).select(*keys, "fs_hz", "n", "start", F.col("s.value").alias("values"))


def with_halo(chunks: DataFrame, size: int, halo: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Chunks with ``first`` and ``values`` widened by ``halo`` samples on either side, as far as the recording goes."""
    own, last = F.col("start") / size, F.floor((F.col("n") - 1) / size)
    reach = -(-halo // size)
    targets = F.sequence(F.greatest(F.lit(0), F.floor(own) - reach), F.least(last, F.floor(own) + reach))
    spread = chunks.select("*", F.explode(targets).alias("t"))
    low, high = F.greatest("start", F.col("t") * size - halo), F.least(F.col("start") + F.size("values"), (F.col("t") + 1) * size + halo)
    piece = F.struct(low.cast("long").alias("at"), F.slice("values", (low - F.col("start") + 1).cast("int"), (high - low).cast("int")).alias("v"))
    joined = spread.where(low < high).groupBy(*keys, "fs_hz", "n", (F.col("t") * size).cast("long").alias("start")).agg(F.array_sort(F.collect_list(piece)).alias("p"))
    return joined.select(*keys, "fs_hz", "n", "start", F.get("p", F.lit(0))["at"].alias("first"), F.flatten(F.col("p.v")).alias("values"))


# --- filters -----------------------------------------------------------------------------------------


def _memory(sections: np.ndarray) -> int:
    """Samples until a cascade, run forward and backward, has forgotten its past."""
    radius = max(max(abs(np.roots(s[3:]))) for s in sections)
    return 64 + 2 * math.ceil(math.log(FORGOTTEN) / math.log(min(max(radius, 1e-6), 1 - 1e-9)))


def filter_chunks(chunks: DataFrame, size: int, baseline: bool = False, highpass_hz: float | None = None, lowpass_hz: float | None = None, notch_hz: float | None = None, notch_q: float = 30.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """``detection.filter_signals`` of chunked recordings: chunks with filtered ``values`` and ``error``."""
    steps = [("highpass", 0.5 if baseline else None), ("highpass", highpass_hz), ("lowpass", lowpass_hz), ("notch", notch_hz)]
    steps = [(kind, cutoff) for kind, cutoff in steps if cutoff is not None]
    rates = chunks.agg(F.min("fs_hz"), F.max("fs_hz")).first()
    fits = rates[0] is not None and all(0 < c < rates[0] / 2 for _, c in steps)
    design = lambda kind, c, fs: K.notch(c, notch_q, fs) if kind == "notch" else K.butterworth(4, kind, fs, c)
    halo = sum(_memory(design(kind, c, rates[1])) for kind, c in steps) if fits else 0  # else every chunk that cannot be filtered says so
    wide = with_halo(chunks, size, halo, keys)
    run = D.filter_kernel(baseline, highpass_hz, lowpass_hz, notch_hz, notch_q)

    def one(v, fs, row):
        skip = row["start"] - row["first"]
        return [{"values": run(v, fs)[skip : skip + min(size, row["n"] - row["start"])]}]

    return D.per_signal(wide, one, "values array<double>", [*keys, "n", "start"], ["first"]).join(chunks.select(*keys, "fs_hz").distinct(), list(keys))


# --- peaks -------------------------------------------------------------------------------------------


def signal_scale(chunks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, fs_hz, n, median and deviation (population) of every recording; a recording with
    values that are missing or not finite, of fewer than 8 samples or without a rate has ``error``."""
    total = lambda f: F.aggregate("values", F.lit(0.0), f)
    ok = F.forall("values", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    sums = chunks.withColumn("ok", ok).groupBy(*keys, "fs_hz", "n").agg(F.min("ok").alias("ok"), F.sum(F.when(F.col("ok"), total(lambda a, v: a + v))).alias("s"), F.sum(F.size("values")).alias("there"))
    sums = sums.withColumn("mean", F.col("s") / F.col("n"))
    squares = chunks.join(sums.where("ok").select(*keys, "mean"), list(keys)).groupBy(*keys).agg(F.sum(F.aggregate(F.transform("values", lambda v: (v - F.col("mean")) * (v - F.col("mean"))), F.lit(0.0), lambda a, v: a + v)).alias("q"))
    medians = exact_quantiles(chunks, keys, "values").select(*keys, F.get("quantiles", F.lit(0)).alias("median"))
    error = F.when(~F.col("ok"), "signal has values that are not finite").when(F.col("n") < 8, "signal has fewer than 8 samples").when(F.col("there") != F.col("n"), "signal has gaps between its chunks")
    error = error.when(~F.coalesce((F.col("fs_hz") > 0) & (F.col("fs_hz") < float("inf")), F.lit(False)), "sampling rate is not usable")
    return sums.join(squares, list(keys), "left").join(medians, list(keys), "left").select(*keys, "fs_hz", "n", "median", F.sqrt(F.col("q") / F.col("n")).alias("scale"), error.alias("error"))


def _mapped(df: DataFrame, fn: Callable[[dict, np.ndarray], list[dict]], keys: Sequence[str], schema: str, extra: Sequence[str]) -> DataFrame:
    """Rows ``fn(row, values)`` of every chunk, with its keys."""
    kept = df.select(*keys, *extra, "values")
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.select(*keys).schema)
    full = f"{key_schema}, {schema}"
    target = to_arrow_schema(StructType.fromDDL(full))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("values")
            for i, row in enumerate(batch.drop_columns(["values"]).to_pylist()):
                own = {k: row[k] for k in keys}
                yield pa.RecordBatch.from_pylist([{**own, **r} for r in fn(row, values[i].values.to_numpy(zero_copy_only=False))], schema=target)

    return kept.mapInArrow(run, full)


_RUNS = "sign int, edge boolean, low long, high long, level double, before double, after double"


def _runs(row: dict, x: np.ndarray) -> list[dict]:
    """Maxima inside a chunk, and the runs of equal values at its two ends."""
    out = []
    for sign in row["signs"]:
        z = sign * (x - row["median"])
        change = np.flatnonzero(np.diff(z)) + 1
        starts, ends = np.concatenate([[0], change]), np.concatenate([change - 1, [len(z) - 1]])
        level, at, m = z[starts], row["start"], len(starts)
        if m > 2:
            top = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
            out += [{"sign": sign, "edge": False, "low": at + int(a), "high": at + int(b), "level": float(v)} for a, b, v in zip(starts[top], ends[top], level[top])]
        for i in sorted({0, m - 1}):
            out.append({"sign": sign, "edge": True, "low": at + int(starts[i]), "high": at + int(ends[i]), "level": float(level[i]), "before": float(level[i - 1]) if i else None, "after": float(level[i + 1]) if i < m - 1 else None})
    return out


def _maxima(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, sign, pos, height of all strict maxima; a plateau counts once, at its middle (rounded down)."""
    along = Window.partitionBy(*keys, "sign").orderBy("low")
    touches = F.lag("high").over(along) + 1 == F.col("low")
    edges = runs.where("edge").withColumn("fresh", F.when(touches & (F.lag("level").over(along) == F.col("level")), 0).otherwise(1))
    edges = edges.withColumn("run", F.sum("fresh").over(along)).groupBy(*keys, "sign", "run").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.first("level").alias("level"), F.min_by("before", "low").alias("before"), F.max_by("after", "low").alias("after"))
    earlier = F.when(F.lag("high").over(along) + 1 == F.col("low"), F.lag("level").over(along))
    later = F.when(F.lead("low").over(along) - 1 == F.col("high"), F.lead("level").over(along))
    edges = edges.withColumns({"before": F.coalesce("before", earlier), "after": F.coalesce("after", later)}).where("before < level AND after < level")
    point = lambda df: df.select(*keys, "sign", F.expr("(low + high) div 2").alias("pos"), F.col("level").alias("height"))
    return point(runs.where("NOT edge")).unionByName(point(edges))


def thin(maxima: DataFrame, size: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """The maxima (keys, sign, pos, height, distance) that thinning by distance keeps: the
    highest first, of equals the later."""
    points = maxima.withColumns({"tie": -F.col("pos"), "spacing": F.col("distance").cast("double")})
    return spread(points, [*keys, "sign"], size).drop("tie", "spacing")


def _bases(row: dict, x: np.ndarray) -> list[dict]:
    """Both sides of every peak of a chunk: the lowest value up to higher ground or the end of the chunk."""
    out = []
    for sign in {p["sign"] for p in row["peaks"]}:
        z = sign * (x - row["median"])
        at = np.array([p["pos"] - row["start"] for p in row["peaks"] if p["sign"] == sign])
        for side, values, own in ((-1, z, at), (1, z[::-1], len(z) - 1 - at)):
            low, unbounded = K.bases(values, own)
            out += [{"sign": sign, "pos": int(p) + row["start"], "height": float(z[p]), "side": side, "low": float(b), "open": bool(q)} for p, b, q in zip(at, low, unbounded)]
    return out


def _answers(row: dict, x: np.ndarray) -> list[dict]:
    """Lowest values between higher ground in this chunk and its near end, for peaks of other chunks."""
    out = []
    for q in row["asked"]:
        z = q["sign"] * (x - row["median"])
        z = z if q["side"] < 0 else z[::-1]
        behind = z[np.flatnonzero(z > q["height"])[-1] + 1 :]
        out.append({k: q[k] for k in ("sign", "pos", "height", "side")} | {"low": float(min(behind.min(), q["low"])) if len(behind) else q["low"]})
    return out


_SIDES = "sign int, pos long, height double, side int, low double"


def _skipped(size: int):
    """Of one recording's open sides: the first chunk with higher ground (-1: none) and the
    lowest value of those between; rows without a sign are the extremes of the chunks."""

    def run(rows: pa.Table) -> pa.Table | None:
        asks = rows.filter(pc.is_valid(rows.column("sign")))
        chunks = rows.filter(pc.is_null(rows.column("sign")))
        if not asks.num_rows:
            return None
        top, bottom, median = (chunks.column(c).to_numpy() for c in ("top", "bottom", "median"))
        sign, side, pos, height, low = (asks.column(c).to_numpy() for c in ("sign", "side", "pos", "height", "low"))
        target, lowest = np.empty(len(pos), dtype=np.int64), np.empty(len(pos))
        for s in (1, -1):
            high, deep = (top if s > 0 else -bottom) - s * median, (bottom if s > 0 else -top) - s * median
            for way in (-1, 1):
                own = np.flatnonzero((sign == s) & (side == way))
                at = pos[own] // size
                place, between = K.Extremes(high, deep).back(at, height[own]) if way < 0 else K.Extremes(high[::-1], deep[::-1]).back(len(high) - 1 - at, height[own])
                target[own] = np.where(place < 0, -1, (place if way < 0 else len(high) - 1 - place) * size)
                lowest[own] = np.minimum(low[own], between)
        return asks.set_column(asks.column_names.index("low"), "low", pa.array(lowest)).append_column("target", pa.array(target))

    return run


def prominences(chunks: DataFrame, peaks: DataFrame, scales: DataFrame, size: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """``peaks`` (keys, sign, pos, height) with their prominence over the whole recording."""
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in peaks.select(*keys).schema)
    medians = scales.select(*keys, "median")
    per_chunk = peaks.groupBy(*keys, F.expr(f"pos div {int(size)} * {int(size)}").alias("start")).agg(F.collect_list(F.struct("sign", "pos")).alias("peaks"))
    sides = written(_mapped(chunks.join(per_chunk, [*keys, "start"]).join(medians, list(keys)), _bases, keys, f"{_SIDES}, open boolean", ["start", "median", "peaks"]))
    extremes = chunks.join(medians, list(keys)).select(*keys, "start", "median", F.array_max("values").alias("top"), F.array_min("values").alias("bottom"))
    both = sides.where("open").drop("open").unionByName(extremes, allowMissingColumns=True)
    opened = by_group(both, keys, ["start", "pos"], _skipped(size), f"{key_schema}, {_SIDES}, target long")
    opened = written(opened)
    asked = opened.where("target >= 0").groupBy(*keys, F.col("target").alias("start")).agg(F.collect_list(F.struct("sign", "pos", "height", "side", "low")).alias("asked"))
    answered = _mapped(chunks.join(asked, [*keys, "start"]).join(medians, list(keys)), _answers, keys, _SIDES, ["start", "median", "asked"])
    done = sides.where("NOT open").drop("open").unionByName(opened.where("target < 0").drop("target")).unionByName(answered)
    return done.groupBy(*keys, "sign", "pos", "height").agg((F.first("height") - F.max("low")).alias("prominence"))


def _candidates(chunks: DataFrame, scales: DataFrame, signs: Column, size: int, distance_s: float, keys: Sequence[str]) -> DataFrame:
    """Thinned maxima of the asked signs with their prominences."""
    good = scales.where("error IS NULL AND scale > 0").withColumn("signs", signs)
    runs = written(_mapped(chunks.drop("fs_hz", "n").join(good, list(keys)), _runs, keys, _RUNS, ["start", "median", "signs"]))
    distance = F.greatest(F.lit(1), F.rint(F.lit(float(distance_s)) * F.col("fs_hz")).cast("int"))
    maxima = _maxima(runs, keys).join(good.select(*keys, distance.alias("distance")), list(keys))
    return written(prominences(chunks, thin(maxima, size, keys), scales, size, keys))


def chunk_polarity(candidates: DataFrame, scales: DataFrame, fraction: float = D.STRICT, keys: Sequence[str] = KEYS) -> DataFrame:
    """Polarity by the number of candidates on either side (``candidates`` of both signs)."""
    high = candidates.join(scales.select(*keys, "scale"), list(keys)).where(F.col("prominence") >= fraction * F.col("scale"))
    count = lambda s: F.count_if(F.col("sign") == s).cast("int")
    counts = high.groupBy(*keys).agg(count(1).alias("up"), count(-1).alias("down"))
    middle = exact_quantiles(high.select(*keys, "sign", F.array("prominence").alias("p")), [*keys, "sign"], "p").select(*keys, "sign", F.get("quantiles", F.lit(0)).alias("m"))
    score = lambda s: F.max(F.when(F.col("sign") == s, F.col("m")))
    rows = scales.where("error IS NULL").join(counts, list(keys), "left").join(middle.groupBy(*keys).agg(score(1).alias("mp"), score(-1).alias("mn")), list(keys), "left").fillna(0, ["up", "down"])
    negative = (F.col("up") > 0) & (F.col("down") > 0) & (F.col("down") / F.col("up") < D.NEGATIVE_RATIO)
    scaled = lambda m: F.coalesce(F.col(m) / F.greatest("scale", F.lit(1e-8)), F.lit(0.0))
    return rows.select(*keys, F.when(negative, "negative").otherwise("positive").alias("polarity"), (F.abs(F.col("up") - F.col("down")) / F.greatest("up", "down", F.lit(1))).alias("confidence"), scaled("mp").alias("positive_score"), scaled("mn").alias("negative_score"), F.col("up").alias("positive_candidates"), F.col("down").alias("negative_candidates"))


def select_polarity(chunks: DataFrame, size: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """``detection.select_polarity`` of chunked recordings; refused ones have no row."""
    scales = written(signal_scale(chunks, keys))
    return chunk_polarity(_candidates(chunks, scales, F.array(F.lit(1), F.lit(-1)), size, D.REFRACTORY_S, keys), scales, keys=keys)


def _recovered(candidates: DataFrame, peaks: DataFrame, gap_ratio: float, fraction: float, keys: Sequence[str]) -> DataFrame:
    """The most prominent relaxed candidate (the first of equals) strictly inside each long gap."""
    if not (math.isfinite(gap_ratio) and gap_ratio > 1):
        raise ValueError(f"gap ratio {gap_ratio} is not above 1")
    along = Window.partitionBy(*keys).orderBy("pos")
    steps = peaks.select(*keys, "pos", F.lead("pos").over(along).alias("next")).where("next IS NOT NULL")
    middle = exact_quantiles(steps.select(*keys, F.array((F.col("next") - F.col("pos")).cast("double")).alias("g")), keys, "g").select(*keys, F.get("quantiles", F.lit(0)).alias("m"))
    gaps = steps.join(middle, list(keys)).where((F.col("next") - F.col("pos")) > gap_ratio * F.col("m")).select(*keys, F.col("pos").alias("left"), "next")
    relaxed = candidates.where(F.col("prominence") >= fraction * F.col("scale"))
    marks = relaxed.select(*keys, "pos", F.col("prominence"), "sign", F.lit(None).cast("long").alias("left"), F.lit(None).cast("long").alias("next")).unionByName(gaps.select(*keys, F.col("left").alias("pos"), F.lit(None).cast("double").alias("prominence"), F.lit(None).cast("int").alias("sign"), "left", "next"))
    carried = F.last(F.when(F.col("left").isNotNull(), F.struct("left", "next")), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))
    inside = marks.withColumn("gap", carried).where("sign IS NOT NULL AND pos > gap.left AND pos < gap.next")
    best = F.row_number().over(Window.partitionBy(*keys, "gap.left").orderBy(F.desc("prominence"), "pos"))
    return inside.withColumn("r", best).where("r = 1").select(*keys, "pos", "prominence", "sign")


def detect_chunks(chunks: DataFrame, size: int, polarity: str = "positive", recovery: bool = False, gap_ratio: float = D.GAP_RATIO, min_distance_s: float = D.REFRACTORY_S, prominence_factor: float = D.STRICT, keys: Sequence[str] = KEYS) -> DataFrame:
    """``detection.detect_peaks`` of chunked recordings: keys, r_index, prominence, polarity, error."""
    if polarity not in ("positive", "negative", "adaptive"):
        raise ValueError(f"unknown polarity {polarity!r}")
    scales = written(signal_scale(chunks, keys))
    signs = {"positive": [1], "negative": [-1], "adaptive": [1, -1]}[polarity]
    found = _candidates(chunks, scales, F.array(*map(F.lit, signs)), size, min_distance_s, keys).join(scales.select(*keys, "scale"), list(keys))
    if polarity == "adaptive":
        known = D.REFRACTORY_S == min_distance_s
        counted = found.drop("scale") if known else _candidates(chunks, scales, F.array(F.lit(1), F.lit(-1)), size, D.REFRACTORY_S, keys)
        chosen = chunk_polarity(counted, scales, keys=keys).select(*keys, F.when(F.col("polarity") == "negative", -1).otherwise(1).alias("sign"))
        found = found.join(chosen, [*keys, "sign"])
    peaks = found.where(F.col("prominence") >= prominence_factor * F.col("scale")).select(*keys, "pos", "prominence", "sign")
    if recovery:
        source = found if min_distance_s == D.REFRACTORY_S else _candidates(chunks, scales, F.array(F.lit(1), F.lit(-1)), size, D.REFRACTORY_S, keys).join(scales.select(*keys, "scale"), list(keys)).join(peaks.select(*keys, "sign").distinct(), [*keys, "sign"])
        peaks = written(peaks)
        more = written(_recovered(source, peaks, gap_ratio, D.RELAXED, keys))
        peaks = peaks.join(more.select(*keys, "pos"), [*keys, "pos"], "left_anti").unionByName(more)
    rows = peaks.select(*keys, F.col("pos").alias("r_index"), "prominence", F.when(F.col("sign") > 0, "positive").otherwise("negative").alias("polarity"), F.lit(None).cast("string").alias("error"))
    failed = scales.where("error IS NOT NULL").select(*keys, F.lit(None).cast("long").alias("r_index"), F.lit(None).cast("double").alias("prominence"), F.lit(None).cast("string").alias("polarity"), "error")
    return rows.unionByName(failed)
