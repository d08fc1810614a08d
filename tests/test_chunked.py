"""Chunked recordings: equal to the whole-signal kernels, wherever the cuts fall."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardiolake.functions import kernels as K
from cardiolake.functions import spacing
from cardiolake.functions.quantiles import exact_quantiles, from_bits, ordered_bits
from cardiolake.operators import chunked, detection

SCHEMA = "recording_id string, channel string, fs_hz double, t0_s double, values array<double>"
RNG = np.random.default_rng(21)


def beats(n, fs, seed=0, step=0.8):
    """Spikes on a wandering, noisy line."""
    rng = np.random.default_rng(seed)
    t = np.arange(n) / fs
    x = 0.3 * np.sin(2 * np.pi * 0.2 * t) + 0.05 * rng.normal(size=n)
    at = np.cumsum(rng.uniform(0.7, 1.3, size=int(n / fs / step)) * step * fs).astype(int)
    for p in at[at < n - 5]:
        x[p - 2 : p + 3] += np.array([0.3, 0.9, 1.4, 0.9, 0.3]) * rng.uniform(0.6, 1.2)
    return x


def frame(spark, signals, fs=100.0):
    return spark.createDataFrame([(name, "c", fs, 0.0, [float(v) for v in x]) for name, x in signals.items()], SCHEMA)


SIGNALS = {
    "beats": beats(3000, 100),
    "down": -beats(3000, 100, 3),
    "steps": RNG.integers(0, 4, 2000).repeat(RNG.integers(1, 9, 2000))[:2500].astype(float),
    "plateau": np.concatenate([np.zeros(300), np.full(700, 2.0), np.zeros(100), np.full(50, 3.0), np.zeros(850)]),
    "ramp": np.arange(2000) / 10 + np.tile([0.0, 0.4], 1000),
    "fall": -np.arange(2000) / 10 + np.tile([0.0, 0.4], 1000),
    "flat": np.full(900, 4.0),
    "gaps": np.where(np.isin(np.arange(2500), [100, 180, 260, 340, 420, 640, 720, 800, 880, 1200, 1280]), 5.0, 0.0) + np.where(np.isin(np.arange(2500), [530, 1000, 1040]), 1.4, 0.0) + 0.001 * RNG.normal(size=2500),
}


def peaks(rows):
    out = {}
    for r in rows:
        assert r["error"] is None
        out.setdefault(r["recording_id"], []).append((r["r_index"], round(r["prominence"], 9), r["polarity"]))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("size,polarity,recovery", [(37, "positive", True), (250, "adaptive", True), (1000, "negative", False), (5000, "adaptive", False)])
def test_peaks_equal_whole_signals(spark, size, polarity, recovery):
    whole = frame(spark, SIGNALS)
    want = peaks(detection.detect_peaks(whole, polarity, recovery).collect())
    got = peaks(chunked.detect_chunks(chunked.to_chunks(whole, size), size, polarity, recovery).collect())
    assert got == want and {"beats", "steps"} <= set(got)


def test_other_distances_and_factors(spark):
    whole = frame(spark, {k: SIGNALS[k] for k in ("beats", "steps", "gaps")})
    settings = {"min_distance_s": 0.6, "prominence_factor": 0.2}
    want = peaks(detection.detect_peaks(whole, "adaptive", True, **settings).collect())
    assert peaks(chunked.detect_chunks(chunked.to_chunks(whole, 90), 90, "adaptive", True, **settings).collect()) == want


def test_polarity_equals_whole_signals(spark):
    whole = frame(spark, SIGNALS)
    chunks = chunked.to_chunks(whole, 111)
    scales = chunked.signal_scale(chunks)
    found = chunked._candidates(chunks, scales, F.array(F.lit(1), F.lit(-1)), 111, detection.REFRACTORY_S, chunked.KEYS)
    got = {r["recording_id"]: r for r in chunked.chunk_polarity(found, scales).collect()}
    for r in detection.select_polarity(whole).collect():
        g = got[r["recording_id"]]
        assert all(g[c] == (pytest.approx(r[c]) if isinstance(r[c], float) else r[c]) for c in ("polarity", "confidence", "positive_score", "negative_score", "positive_candidates", "negative_candidates"))


@pytest.mark.parametrize("size,settings", [(64, {"highpass_hz": 8.0}), (500, {"baseline": True, "lowpass_hz": 20.0}), (1500, {"baseline": True, "highpass_hz": 1.0, "lowpass_hz": 40.0, "notch_hz": 30.0})])
def test_filters_equal_whole_signals(spark, size, settings):
    n = 9000
    whole = frame(spark, {"a": beats(n, 100, 5) * 3 + 7, "b": np.cumsum(RNG.normal(size=n - 1234)), "short": beats(40, 100)})
    want = {r["recording_id"]: np.array(r["filtered"]) for r in detection.filter_signals(whole, **settings).collect()}
    rows = chunked.filter_chunks(chunked.to_chunks(whole, size), size, **settings).orderBy("recording_id", "start").collect()
    for name, x in want.items():
        own = [r for r in rows if r["recording_id"] == name]
        got = np.concatenate([r["values"] for r in own])
        assert [r["start"] for r in own] == list(range(0, len(x), size)) and len(got) == len(x)
        assert np.abs(got - x).max() <= 1e-9 * max(1, np.abs(x).max())


def test_filtered_chunks_are_chunks(spark):
    """Filter, then detect, without a row of the whole."""
    whole = frame(spark, {"a": beats(6000, 100, 6), "b": beats(5000, 100, 7)})
    smooth = detection.filter_signals(whole, highpass_hz=2.0)
    want = peaks(detection.detect_peaks(smooth.select("recording_id", "channel", F.lit(100.0).alias("fs_hz"), F.col("filtered").alias("values"))).collect())
    filtered = chunked.filter_chunks(chunked.to_chunks(whole, 800), 800, highpass_hz=2.0)
    got = peaks(chunked.detect_chunks(filtered.drop("error"), 800).collect())
    assert {k: [x[0] for x in v] for k, v in got.items()} == {k: [x[0] for x in v] for k, v in want.items()}


def test_refused_recordings_say_so(spark):
    bad = beats(500, 100)
    bad[333] = np.nan
    rows = chunked.detect_chunks(chunked.to_chunks(frame(spark, {"nan": bad, "tiny": np.arange(5.0), "ok": SIGNALS["beats"]}), 100), 100).collect()
    errors = {r["recording_id"]: r["error"] for r in rows if r["error"]}
    assert set(errors) == {"nan", "tiny"} and {r["recording_id"] for r in rows} == {"nan", "tiny", "ok"}
    rows = chunked.filter_chunks(chunked.to_chunks(frame(spark, {"ok": SIGNALS["beats"]}), 1000), 1000, lowpass_hz=70.0).collect()
    assert all("outside" in r["error"] for r in rows)
    with pytest.raises(ValueError):
        chunked.detect_chunks(chunked.to_chunks(frame(spark, {"ok": SIGNALS["beats"]}), 100), 100, "upward")


def test_long_layout_gives_the_same_chunks(spark):
    whole = frame(spark, {"a": SIGNALS["beats"]})
    samples = whole.select("recording_id", "channel", F.posexplode("values").alias("i", "value")).select("recording_id", "channel", F.col("i").cast("long").alias("sample_index"), "value")
    rows = lambda df: [(r["start"], r["n"], r["fs_hz"], list(r["values"])) for r in df.orderBy("start").collect()]
    assert rows(chunked.samples_to_chunks(samples.repartition(3), 100.0, 700)) == rows(chunked.to_chunks(whole, 700))


def test_decisions_do_not_depend_on_the_cut():
    """Partial knowledge, in any order of rounds, ends where taking the highest first does."""
    for seed in range(20):
        rng = np.random.default_rng(seed)
        pos = np.unique(rng.integers(0, 400, 150))
        height = rng.integers(0, 6, len(pos)).astype(float)
        want = set(K.thin_by_distance(pos, height, 9).tolist())
        rank = np.empty(len(pos), dtype=np.int64)
        rank[np.lexsort((-pos, -height))] = np.arange(len(pos))
        status = np.zeros(len(pos), dtype=np.int32)
        while (status == 0).any():
            part = (pos // 23) % 3 == rng.integers(0, 3)
            status = spacing.decide(pos, rank, status, part, 9)
        assert set(pos[status == 1].tolist()) == want


def test_extremes_look_back():
    for seed in range(10):
        rng = np.random.default_rng(seed)
        high = rng.integers(0, 9, 57).astype(float)
        low = high - rng.integers(0, 9, 57)
        at, height = rng.integers(0, 57, 40), rng.integers(0, 10, 40).astype(float)
        place, lowest = K.Extremes(high, low).back(at, height)
        for a, h, p, m in zip(at, height, place, lowest):
            above = np.flatnonzero(high[:a] > h)
            q = above[-1] if len(above) else -1
            assert p == q and m == (low[q + 1 : a].min() if q + 1 < a else np.inf)


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(4)
    lists = {"a": rng.normal(size=999), "b": rng.normal(size=1000) * 1e300, "c": np.array([0.0, -0.0, 5e-324, -1.0]), "d": rng.integers(-3, 3, 500).astype(float), "one": np.array([2.5])}
    rows = [(k, [float(v) for v in part]) for k, x in lists.items() for part in np.array_split(x, 7) if len(part)] + [("a", [float("nan"), None]), ("none", [float("inf")])]
    fractions = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = {r["k"]: r for r in exact_quantiles(spark.createDataFrame(rows, "k string, v array<double>"), ["k"], "v", fractions).collect()}
    assert set(got) == set(lists)
    for k, x in lists.items():
        assert got[k]["n"] == len(x) and got[k]["quantiles"][2] == np.median(x)
        assert np.allclose(got[k]["quantiles"], np.quantile(x, fractions), rtol=1e-12, atol=0)
    x = np.sort(rng.normal(size=1000) * 10.0 ** rng.integers(-300, 300, 1000))
    assert (np.diff(ordered_bits(x)) > 0).all() and (from_bits(ordered_bits(x)) == x).all()


def test_prominence_equals_a_walk():
    """Against walking to higher ground sample by sample, plateaus and equal heights included."""
    for seed in range(12):
        rng = np.random.default_rng(seed)
        x = rng.integers(0, 7, 300).astype(float) if seed % 2 else np.cumsum(rng.normal(size=300))
        peaks = K.local_maxima(x)
        for p, got in zip(peaks, K.prominences(x, peaks)):
            sides = []
            for step in (-1, 1):
                at, low = p, x[p]
                while 0 <= at < len(x) and x[at] <= x[p]:
                    low, at = min(low, x[at]), at + step
                sides.append(low)
            assert got == x[p] - max(sides)


def test_groups_are_cut_from_sorted_rows(spark):
    """Null keys, groups over several batches, groups that give nothing."""
    import pyarrow as pa

    from cardiolake.functions.tables import by_group

    rows = [(k, j, i) for i in range(1000) for k, j in [(None if i % 7 == 0 else f"k{i % 5}", None if i % 3 == 0 else i % 4)]]
    table = spark.createDataFrame(rows, "k string, j int, i long")

    def firsts(t: pa.Table):
        i = t.column("i").to_pylist()
        assert i == sorted(i)
        return None if i[0] == 1 else pa.table({"k": t.column("k").slice(0, 1), "j": t.column("j").slice(0, 1), "n": [len(i)]})

    want = {}
    for k, j, i in rows:
        want.setdefault((k, j), []).append(i)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = {(r["k"], r["j"]): r["n"] for r in by_group(table, ["k", "j"], ["i"], firsts, "k string, j int, n long").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {g: len(i) for g, i in want.items() if i[0] != 1}
