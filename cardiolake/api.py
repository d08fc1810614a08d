"""The engine's calls in one place: what a service or a notebook needs, by name.

Tables go in and come out as DataFrames; small results are dicts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import annotations, beats, candidates, detection, learning, matching, provenance, stats
from .operators.validation import check_window
from .sources import readers, seek


def analyze(spark: SparkSession, path: str, time_col: str | None = None) -> dict:
    """Validation report of a CSV recording as a dict (errors are listed, not raised)."""
    from .operators.validation import validate_series

    return validate_series(readers.read_csv(spark, path), time_col).first().asDict()


def recording(spark: SparkSession, path: str) -> DataFrame:
    return readers.read_recording(spark, path)


def window(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """Samples [start, stop) of a recording file, long layout; of native files only the window is read."""
    check_window(start, stop)
    if path.lower().endswith(seek.SUFFIXES):
        rows = seek.read_window(spark, path, start, stop)
        at = F.col("i").cast("long") + F.lit(start)
        placed = rows.where("error IS NULL").select("recording_id", "channel", "fs_hz", F.posexplode("values").alias("i", "value"))
        return placed.select("recording_id", "channel", at.alias("sample_index"), (at / F.col("fs_hz")).alias("time_s"), "value")
    return readers.window_scan(readers.to_samples(readers.read_recording(spark, path)), start, stop)


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """Rate, length, duration and channels: of native files from their headers, of CSV files from the time column."""
    if path.lower().endswith(".csv"):
        return readers.csv_metadata(readers.read_csv(spark, path))
    return seek.read_headers(spark, path)


def filtered(signals: DataFrame, **settings) -> DataFrame:
    return detection.filter_signals(signals, **settings)


def r_peaks(signals: DataFrame, min_distance_ms: float = 250.0, prominence_factor: float = 0.5, polarity: str = "positive") -> DataFrame:
    return detection.detect_peaks(signals, polarity, min_distance_s=min_distance_ms / 1000.0, prominence_factor=prominence_factor)


def segment(peaks: DataFrame, recordings: DataFrame, pre_s: float = 0.35, post_s: float = 0.55) -> DataFrame:
    return beats.segment_beats(peaks, recordings, pre_s, post_s)


def phenotype(signals: DataFrame, peaks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(phenotypes of beats, their summary per recording and channel)."""
    rows = beats.beat_phenotypes(signals, peaks)
    return rows, beats.summary(rows, ["recording_id", "channel"])


def compare(values: DataFrame, a: str, b: str, unit: str | None = "unit_id") -> dict:
    return stats.compare_groups(values, a, b, unit=unit).first().asDict()


def false_discovery(spark: SparkSession, p_values: list[float]) -> list[float]:
    if not p_values:
        return []
    tests = spark.createDataFrame(list(enumerate(map(float, p_values))), "test_id long, p_value double")
    return [r["p_adjusted"] for r in stats.benjamini_hochberg(tests).orderBy("test_id").collect()]


def benchmark(rows: DataFrame, n_folds: int = 5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    return learning.benchmark(rows, n_folds, seed=seed)


def train(signals: DataFrame, beats_at: DataFrame, notes: DataFrame, trees: int = 200):
    """(model, training rows) of the beat classifier."""
    rows = learning.training_set(learning.beat_features(signals, beats_at), beats_at, notes)
    return learning.train(rows, learning.forest(trees)), rows


def suggest(signals: DataFrame, beats_at: DataFrame, notes: DataFrame, top_n: int = 25, trees: int = 200) -> DataFrame:
    """Beats most worth a look, from a classifier trained on the accepted annotations."""
    model, rows = train(signals, beats_at, notes, trees)
    features = learning.beat_features(signals, beats_at).where(F.col("error").isNull()).drop("error")
    timed = features.join(beats_at.select("recording_id", "r_index", "time_s").distinct(), ["recording_id", "r_index"])
    return learning.rank_uncertain(learning.predict(model, timed), top_n, notes, rows)


def agreement(a: DataFrame, b: DataFrame, tolerance_s: float = 0.04) -> DataFrame:
    return annotations.point_agreement(a, b, tolerance_s)


def validate_detector(signals: DataFrame, references: DataFrame, manifest: provenance.Manifest, detector: str = "adaptive", tolerance_ms: float = 75.0, n_bootstrap: int = 2000) -> dict:
    """Detect, match and report in one call; ``references``: recording_id, sample_index.

    ``detector`` is a polarity of the built-in detector or a registered name.
    """
    if detector in ("positive", "negative", "adaptive"):
        peaks = detection.detect_peaks(signals, detector)
    else:
        peaks = detection.run_detector(signals, detector)
    rates = signals.groupBy("recording_id").agg(F.first("fs_hz").alias("fs_hz"))
    found = peaks.where("r_index IS NOT NULL").select("recording_id", F.col("r_index").alias("sample_index"))
    return provenance.validation_report(manifest, _record_metrics(found, references, rates, tolerance_ms), detector, {}, tolerance_ms, n_bootstrap=n_bootstrap)


def _record_metrics(found: DataFrame, references: DataFrame, rates: DataFrame, tolerance_ms: float) -> DataFrame:
    """Metrics of every record, each with its own sampling rate (``rates``: recording_id, fs_hz)."""
    return matching.match_peaks(found, references, rates, tolerance_ms)


def benchmark_two_stage(signals: DataFrame, references: DataFrame, tolerance_ms: float = 75.0, target_recall: float = 0.995, test: float = 0.25, calibration: float = 0.2, seed: int = 42, trees: int = 150, recovery: bool = False) -> dict:
    """From recordings to a report: whole records are split into train and test, the second
    stage is fitted on the training records less those that calibrate its threshold, and
    both stages are matched against the references of the test records alone.

    ``signals``: packed, one channel a recording; ``references``: recording_id, sample_index.
    Returns the split, the model and its metadata, metrics per stage and record, and pooled
    metrics per stage.
    """
    split = learning.record_split(signals.select("recording_id"), test=test, seed=seed)
    part = lambda df, name: df.join(split.where(F.col("part") == name).select("recording_id"), "recording_id", "left_semi")
    fit, held = part(signals, "train"), part(signals, "test")
    rates = signals.groupBy("recording_id").agg(F.first("fs_hz").alias("fs_hz"))
    stage1 = detection.detect_peaks(fit, recovery=recovery).where("r_index IS NOT NULL")
    seconds = lambda df, at: df.join(rates, "recording_id").select("recording_id", F.col(at).cast("long").alias("r_index"), (F.col(at) / F.col("fs_hz")).alias("at"))
    near = matching.nearest_labels(seconds(stage1, "r_index"), seconds(part(references, "train"), "sample_index"), tolerance_ms / 1000.0)
    labels = seconds(stage1, "r_index").join(near.select("recording_id", "at", "label"), ["recording_id", "at"]).drop("at")
    rows = candidates.candidate_features(fit, stage1).where("error IS NULL").drop("error").join(labels, ["recording_id", "r_index"]).persist()  # read by every step of the fit
    model, about = learning.fit_suppressor(rows, target_recall, trees=trees, seed=seed, split=learning.calibration_split(rows, calibration, seed=seed).drop("stratum"))
    rows.unpersist()
    both = learning.detect_two_stage(held, model, about["threshold"], recovery=recovery).persist()
    found = {"stage_1": both, "two_stage": both.where("retained")}
    refs = part(references, "test")
    metrics = [_record_metrics(df.select("recording_id", F.col("r_index").alias("sample_index")), refs, rates, tolerance_ms).withColumn("stage", F.lit(name)) for name, df in found.items()]
    every = metrics[0].unionByName(metrics[1])
    return {"split": split, "model": model, "metadata": about, "metrics": every, "pooled": stats.pooled_detection(every, ["stage"])}
