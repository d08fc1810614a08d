"""Beat features, training sets, classifiers, leakage-safe benchmarks, active learning."""

from __future__ import annotations

import functools
import hashlib
import json
import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.columns import argmax, entropy
from ..functions.prefix import running
from ..functions.quantiles import exact_quantiles
from ..functions.spacing import spread
from ..functions.tables import written
from .candidates import candidate_features, label_candidates, threshold_for_recall
from .detection import checked, detect_peaks, per_signal
from .forest import Forest
from .matching import exclude_near, nearest_labels
from .stats import classification_scores, mean_interval, one_vs_rest_auc, roc_auc

MIN_EXAMPLES, MIN_CLASSES = 4, 2
BEAT_BANDS = ((0.5, 5.0), (5.0, 15.0), (15.0, 40.0), (40.0, 100.0))
BEAT_FEATURES = ("mean", "std", "max", "min", "max_abs", "mean_abs_slope", "power_0", "power_1", "power_2", "power_3")


def beat_features_of(x: np.ndarray, fs: float, centre: int, window_s: float = 0.8) -> np.ndarray:
    if not 0 <= centre < len(x):
        raise ValueError(f"beat at {centre} lies outside the signal")
    reach = max(8, round(fs * window_s / 2))
    part = x[max(0, centre - reach) : centre + reach + 1]
    if len(part) < 8:
        part = np.pad(part, (0, 8 - len(part)), mode="edge")
    z = (part - np.median(part)) / (np.std(part) or 1.0)
    freqs, power = K.periodogram(z, fs)
    bands = [power[(freqs >= a) & (freqs < min(b, fs / 2))].sum() for a, b in BEAT_BANDS]
    return np.array([z.mean(), z.std(), z.max(), z.min(), np.abs(z).max(), np.abs(np.diff(z)).mean(), *bands])


def beat_features(signals: DataFrame, beats: DataFrame, keys: Sequence[str] = ("recording_id", "channel"), at: str = "r_index") -> DataFrame:
    """(keys, r_index, features) of every beat."""
    lists = beats.groupBy(*keys).agg(F.array_sort(F.collect_set(F.col(at).cast("bigint"))).alias("beats"))

    def run(v, fs, row):
        x = checked(v, fs, 8)
        return [{"r_index": i, "features": beat_features_of(x, fs, i).tolist()} for i in row["beats"]]

    return per_signal(signals.join(lists, list(keys)), run, "r_index long, features array<double>", keys, ["beats"])


def training_set(features: DataFrame, beats: DataFrame, annotations: DataFrame, tolerance_s: float = 0.08, keys: Sequence[str] = ("recording_id",)) -> DataFrame:
    """Features of beats next to an accepted, labelled point annotation, with its label.

    ``beats``: keys, r_index, time_s.  Raises if examples or labels are too few.
    """
    points = annotations.where("type = 'point' AND status = 'accepted' AND time IS NOT NULL AND length(label) > 0")
    if not points.limit(1).count():
        raise ValueError("training set: no accepted point annotation carries a label")
    won = nearest_labels(beats, points, tolerance_s, keys, "time_s", "time", "label").where("label = 1").select(*keys, F.col("at").alias("time_s"), F.col("reference_label").alias("label"))
    out = won.join(beats.select(*keys, "r_index", "time_s"), [*keys, "time_s"]).join(features.where("error IS NULL").select(*keys, "r_index", "features"), [*keys, "r_index"])
    n, k = out.agg(F.count("*"), F.count_distinct("label")).first()
    if k < MIN_CLASSES:
        raise ValueError(f"training set: {k} label(s) among the matched beats, {MIN_CLASSES} wanted")
    if n < MIN_EXAMPLES:
        raise ValueError(f"training set: {n} matched beats, {MIN_EXAMPLES} wanted")
    return out


def balanced(rows: DataFrame, label: str = "label") -> DataFrame:
    """Rows with weight n / (classes * rows of the class)."""
    counts = rows.groupBy(label).agg(F.count("*").alias("__c"))
    total = counts.agg(F.sum("__c").alias("__n"), F.count("*").alias("__k"))
    return rows.join(F.broadcast(counts.join(F.broadcast(total))), label).withColumn("weight", F.col("__n") / (F.col("__k") * F.col("__c"))).drop("__n", "__k", "__c")


def _assembled(rows: DataFrame) -> DataFrame:
    return rows.withColumn("__x", array_to_vector(F.col("features").cast("array<double>")))


def forest(trees: int = 200, depth: int = 14, seed: int = 42, least: int = 1, scale: bool = True) -> Pipeline:
    stages = [StringIndexer(inputCol="label", outputCol="__y", stringOrderType="alphabetAsc")]
    if scale:
        stages.append(StandardScaler(inputCol="__x", outputCol="__z", withMean=True))
    stages.append(Forest(trees, depth, least, seed, features="__z" if scale else "__x"))
    return Pipeline(stages=stages)


def logistic(iterations: int = 2000) -> Pipeline:
    return Pipeline(
        stages=[
            StringIndexer(inputCol="label", outputCol="__y", stringOrderType="alphabetAsc"),
            StandardScaler(inputCol="__x", outputCol="__z", withMean=True),
            LogisticRegression(labelCol="__y", featuresCol="__z", weightCol="weight", maxIter=iterations),
        ]
    )


def train(rows: DataFrame, pipeline: Pipeline | None = None) -> PipelineModel:
    """Fit on (features array, label), classes balanced by weights."""
    weighted = written(balanced(rows.withColumn("label", F.col("label").cast("string"))))  # the stages read it many times
    return (pipeline or forest()).fit(_assembled(weighted))


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` with probabilities (in the order of ``classes(model)``) and predicted label."""
    indexer = model.stages[0]
    bare = rows.drop("label") if "label" in rows.columns else rows
    tail = PipelineModel(model.stages[1:])
    out = tail.transform(_assembled(bare)).withColumn("probabilities", vector_to_array("probability"))
    labels = F.array(*[F.lit(x) for x in indexer.labels])
    return out.withColumn("predicted_label", F.get(labels, argmax("probabilities"))).drop("__x", "__z", "rawPrediction", "probability", "prediction")


def classes(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def spaced(rows: DataFrame, spacing: float, limit: int, keys: Sequence[str] = (), score: str = "uncertainty", at: str = "time_s") -> DataFrame:
    """Rows by falling score, skipping those closer than ``spacing`` to one taken, ``limit`` per key at most.

    Of equal scores the earlier row is first, then the one whose columns are smaller.  Rows
    are decided by stretches of the time line (``functions.spacing``), so no key is a list.
    """
    among = Window.partitionBy(*keys, score, at).orderBy(*rows.columns)
    held = rows.withColumn("__k", F.row_number().over(among))
    best = [F.desc(score), F.asc(at), F.asc("__k")]
    if spacing:
        held = held.where("__k = 1")  # of rows at one time only the first can be taken
        if limit < 1:
            return rows.limit(0)
        points = held.select(*keys, F.col(at).cast("double").alias("pos"), F.col(score).cast("double").alias("height"), F.col(at).cast("double").alias("tie"), F.lit(float(spacing)).alias("spacing"))
        taken = spread(points, list(keys), 256.0 * spacing).select(*keys, F.col("pos").alias("__pos"), F.col("height").alias("__height"))
        same = [held[k].eqNullSafe(taken[k]) for k in keys] + [held[at].cast("double") == taken["__pos"], held[score].cast("double") == taken["__height"]]
        held = held.join(taken, same, "left_semi")
    if not keys:
        return held.orderBy(*best).limit(limit).drop("__k")
    return held.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).where(F.col("__r") <= limit).drop("__r", "__k")


def rank_uncertain(predicted: DataFrame, top_n: int = 25, annotations: DataFrame | None = None, trained: DataFrame | None = None, exclude_s: float = 0.08, spacing_s: float = 0.25, keys: Sequence[str] = ("recording_id",)) -> DataFrame:
    """Most uncertain beats per recording, away from annotated and trained ones and from each other."""
    if not (math.isfinite(spacing_s) and spacing_s >= 0):
        raise ValueError(f"spacing {spacing_s} is no length of time")
    rows = predicted.withColumn("uncertainty", entropy("probabilities")).withColumn("confidence", F.array_max("probabilities"))
    if annotations is not None:
        rows = exclude_near(rows, annotations.where("type = 'point' AND time IS NOT NULL"), exclude_s, keys, "time_s", "time")
    if trained is not None:
        rows = exclude_near(rows, trained, exclude_s, keys)
    if top_n <= 0:
        return rows.limit(0)
    return spaced(rows.select(*keys, "r_index", "time_s", "predicted_label", "confidence", "uncertainty"), spacing_s, int(top_n), keys)


# --- splits -------------------------------------------------------------------------------


def groups_per_class(rows: DataFrame, group: str = "group_id", label: str = "label") -> DataFrame:
    """(label, n_groups): in how many groups each class occurs."""
    return rows.groupBy(label).agg(F.count_distinct(group).alias("n_groups"))


def _hashed(record: str, seed: int) -> Column:
    """60 bits of the MD5 of seed and record: an order that any engine can repeat."""
    text = F.concat_ws("|", F.lit(seed).cast("string"), F.col(record).cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def group_folds(rows: DataFrame, n_folds: int, group: str = "group_id", label: str = "label", seed: int = 42) -> DataFrame:
    """(group, fold): whole groups, each put where it keeps class counts most even.

    Groups with the same count of every class are one profile; the driver sees each profile
    once, with the number of its groups, and says how many of them each fold gets.  Which
    ones is decided by the seeded hash of their names.
    """
    text = F.col(label).cast("string")
    per_class = {r["l"]: (r["n"], r["t"]) for r in rows.groupBy(text.alias("l")).agg(F.count_distinct(group).alias("n"), F.count("*").alias("t")).collect()}
    each = rows.groupBy(group, text.alias("l")).count().groupBy(group).agg(F.array_sort(F.collect_list(F.struct("l", "count"))).alias("profile"))
    each = each.withColumn("profile", F.to_json("profile", {"ignoreNullFields": "false"}))
    profiles = {r["profile"]: r["count"] for r in each.groupBy("profile").count().collect()}
    n_folds = min([n_folds, sum(profiles.values()), *(n for n, _ in per_class.values())]) if per_class else 0
    if n_folds < 2:
        raise ValueError("folds: every class must occur in two groups or more")
    column = {name: i for i, name in enumerate(per_class)}
    totals = np.array([t for _, t in per_class.values()], dtype=float)
    shares = {}
    for p in profiles:
        shares[p] = np.zeros(len(column))
        for x in json.loads(p):
            shares[p][column[x["l"]]] = x["count"]
    order = sorted(profiles, key=lambda p: (-shares[p].std(), hashlib.md5(f"{seed}|{p}".encode()).hexdigest()))
    held, bounds = np.zeros((n_folds, len(column))), []
    for p in order:
        given, share = np.zeros(n_folds, dtype=int), shares[p] / totals
        for _ in range(profiles[p]):
            spread = [np.where(np.arange(n_folds)[:, None] == f, held + share, held).std(axis=0).mean() for f in range(n_folds)]
            best = min(range(n_folds), key=lambda f: (round(spread[f], 12), held[f].sum()))
            held[best] += share
            given[best] += 1
        ends = np.cumsum(given).tolist()
        bounds += [(p, f, end - int(n), end) for f, (n, end) in enumerate(zip(given, ends)) if n]
    table = rows.sparkSession.createDataFrame(bounds, "profile string, fold int, first long, past long")
    place = F.row_number().over(Window.partitionBy("profile").orderBy(_hashed(group, seed), group)) - 1
    return each.withColumn("__k", place).join(table, "profile").where((F.col("__k") >= F.col("first")) & (F.col("__k") < F.col("past"))).select(group, "fold")


def benchmark(rows: DataFrame, n_folds: int = 5, group: str = "group_id", seed: int = 42, models: dict[str, Pipeline] | None = None) -> tuple[DataFrame, DataFrame]:
    """(metrics per model and fold, mean with a descriptive t interval per model and metric).

    Train and test never share a group.
    """
    models = models or {"logistic_regression": logistic(), "random_forest": forest(300, seed=seed)}
    rows = written(rows.select(group, "label", "features"))
    folded = written(rows.join(group_folds(rows, n_folds, group, "label", seed), group))
    spark, said, known, run = rows.sparkSession, [], {}, ["model", "fold"]
    sizes = {r["fold"]: r["count"] for r in folded.groupBy("fold").count().collect()}
    binary = rows.select("label").distinct().count() == 2
    for f in sorted(sizes):
        fit, test = folded.where(F.col("fold") != f), folded.where(F.col("fold") == f)
        told = []
        for name, pipeline in models.items():
            model = train(fit.select("features", "label"), pipeline)
            known.setdefault(tuple(classes(model)), []).append((name, f))
            told.append(predict(model, test.withColumn("truth", F.col("label").cast("string"))).select(F.lit(name).alias("model"), "fold", "truth", "predicted_label", "probabilities"))
        said.append(written(functools.reduce(DataFrame.unionByName, told)))  # a fold's models are not needed any more
    every = functools.reduce(DataFrame.unionByName, said)  # scores of all runs are counted together
    scores = {(s["model"], s["fold"]): s for s in classification_scores(every, "truth", "predicted_label", run).collect()}
    areas = {}
    for labels, runs in known.items():  # runs whose models know the same classes
        own = every.join(F.broadcast(spark.createDataFrame(runs, "model string, fold int")), run)
        if binary:
            auc = roc_auc(own.select(*run, (F.col("truth") == labels[-1]).cast("int").alias("label"), F.get("probabilities", F.lit(1)).alias("score")), keys=run)
        else:
            auc = one_vs_rest_auc(own, labels, "truth", keys=run)
        areas |= {(r["model"], r["fold"]): r["roc_auc"] for r in auc.collect()}
    total = sum(sizes.values())
    out = []
    for name, f in ((name, f) for f in sorted(sizes) for name in models):
        s = scores[name, f]
        out.append((name, f, total - sizes[f], sizes[f], s["accuracy"], s["balanced_accuracy"], s["macro_f1"], s["weighted_f1"], areas[name, f]))
    per_fold = spark.createDataFrame(out, "model string, fold int, n_train long, n_test long, accuracy double, balanced_accuracy double, macro_f1 double, weighted_f1 double, roc_auc double")
    long = per_fold.select("model", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("accuracy", "balanced_accuracy", "macro_f1", "weighted_f1", "roc_auc")])).alias("x")).select("model", "x.*")
    return per_fold, mean_interval(long, "value", ["model", "metric"])


def record_strata(rows: DataFrame, record: str = "recording_id", label: str = "label", n: int = 3) -> DataFrame:
    """Records in ``n`` strata of rising label rate (ties by record).

    Ranks are running counts of the distinct rates, and a row number among records of one rate.
    """
    rates = rows.groupBy(record).agg(F.avg(label).alias("rate"))
    levels = running(rates.groupBy(F.col("rate").alias("__rate")).agg(F.count("*").alias("__c")), "__rate", "__c", "__upto")
    total = rates.count()
    among = F.row_number().over(Window.partitionBy("rate").orderBy(record))
    ranked = rates.withColumn("__among", among).join(levels, F.col("rate") == F.col("__rate"))
    rank = F.col("__upto") - F.col("__c") + F.col("__among") - 1
    return ranked.select(record, "rate", F.least(F.lit(n - 1), F.floor(rank * n / F.lit(max(1, total)))).cast("int").alias("stratum"))


def calibration_split(rows: DataFrame, fraction: float = 0.2, record: str = "recording_id", seed: int = 42) -> DataFrame:
    """(record, part): whole records, about ``fraction`` of each stratum for calibration."""
    strata = record_strata(rows, record)
    if strata.limit(3).count() < 3:
        raise ValueError("calibration split: fewer than three records")
    strata = strata.select(record, "stratum", F.struct("stratum", _hashed(record, seed).alias("h")).alias("__k"))
    levels = running(strata.groupBy("__k").agg(F.count("*").alias("__c")), "__k", "__c", "__upto")
    bound, before = F.lit(0), 0  # counts run over all strata, one after the other
    for stratum, n in sorted(strata.groupBy("stratum").count().collect()):  # one row a stratum
        take = 0 if n == 1 and stratum > 0 else max(1, round(n * fraction))
        bound = F.when(F.col("__k")["stratum"] == stratum, F.lit(before + take)).otherwise(bound)
        before += n
    chosen = levels.where(F.col("__upto") - F.col("__c") < bound).select("__k", F.lit(True).alias("__in"))
    return strata.join(chosen, "__k", "left").select(record, "stratum", F.when(F.col("__in"), "calibration").otherwise("fit").alias("part"))


def _first_by_hash(rows: DataFrame, take: int, h: str = "__h") -> DataFrame:
    """(hash, true) of the ``take`` smallest hashes, by running counts."""
    levels = running(rows.groupBy(h).agg(F.count("*").alias("__c")), h, "__c", "__upto")
    return levels.where(F.col("__upto") - F.col("__c") < take).select(h, F.lit(True).alias("__in"))


def record_split(records: DataFrame, record: str = "recording_id", test: float = 0.25, seed: int = 42) -> DataFrame:
    """(record, part) by a seeded hash order; ``test`` of the records, one at least."""
    distinct = records.select(record).distinct().withColumn("__h", _hashed(record, seed))
    chosen = _first_by_hash(distinct, max(1, round(distinct.count() * test)))
    return distinct.join(chosen, "__h", "left").select(record, F.when(F.col("__in"), "test").otherwise("train").alias("part"))


def hash_part(group: str) -> Column:
    """'test' for a quarter of the groups, by the first hex digit of the MD5 of their name, else 'train';
    no pass over the data is needed, and a group keeps its part when others come."""
    return F.when(F.substring(F.md5(F.col(group).cast("string").cast("binary")), 1, 1) < "4", "test").otherwise("train")


def stratified_holdout(rows: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """``rows`` with ``__held``: of each label those whose hash is below its share ``fraction``.

    The bound of a label is the exact quantile of its hashes, found by refined histograms,
    so no task sees a whole class."""
    number = F.shiftrightunsigned(F.xxhash64(F.to_json(F.struct("features")), F.lit(seed)), 11)  # 53 bits, which a double holds
    hashed = rows.withColumn("__h", number.cast("double"))
    bounds = exact_quantiles(hashed.select("label", F.array("__h").alias("h")), ["label"], "h", [fraction])
    return hashed.join(bounds.select("label", F.get("quantiles", F.lit(0)).alias("__bound")), "label").withColumn("__held", F.col("__h") < F.col("__bound")).drop("__h", "__bound")


def fit_suppressor(rows: DataFrame, target_recall: float = 0.995, fraction: float = 0.2, trees: int = 150, seed: int = 42, split: DataFrame | None = None, record: str = "recording_id") -> tuple[PipelineModel, dict]:
    """(model, metadata) of the second stage; label 0/1.

    Without ``split`` a stratified share of rows calibrates the threshold and the
    model is fitted again on all; with one (record, part) the calibration
    records are never fitted on.
    """
    if not (math.isfinite(fraction) and 0 <= fraction < 0.5):
        raise ValueError(f"suppressor: share {fraction} to calibrate on is outside [0, 0.5)")
    rows = written(rows)  # features are made once, however often they are read
    counts = {int(r["label"]): r["count"] for r in rows.groupBy("label").count().collect()}
    if set(counts) != {0, 1}:
        raise ValueError("suppressor: candidates of both classes 0 and 1 are needed")
    if split is None and fraction > 0 and (sum(counts.values()) < 10 or min(counts.values()) < 2):
        raise ValueError("suppressor: too few candidates to set some aside (ten, and two a class); use a share of 0")
    pipeline = forest(trees, 14, seed, 2, scale=False)
    if split is not None:
        marked = rows.join(split, record)
        fit, held, method = marked.where("part = 'fit'"), marked.where("part = 'calibration'"), "held_out_records"
    elif fraction > 0:
        marked = stratified_holdout(rows, fraction, seed)
        fit, held, method = marked.where("NOT __held"), marked.where("__held"), "held_out_stratified"
    else:
        fit = held = rows
        method = "training_resubstitution"
    model = train(fit.select("features", "label"), pipeline)
    scored = predict(model, held.withColumn("truth", F.col("label").cast("int"))).select(F.col("truth").alias("label"), F.get("probabilities", F.lit(1)).alias("probability"))
    threshold = float(threshold_for_recall(scored, target_recall).first()["threshold"])
    if method == "held_out_stratified":
        model = train(rows.select("features", "label"), pipeline)
    meta = {"target_recall": target_recall, "threshold": threshold, "n_training_candidates": sum(counts.values()), "n_positive_candidates": counts[1], "n_negative_candidates": counts[0], "random_seed": seed, "n_estimators": trees, "calibration_fraction": fraction, "calibration_candidates": 0 if method == "training_resubstitution" else held.count(), "calibration_method": method}
    return model, meta


def filter_candidates(model: PipelineModel, rows: DataFrame, threshold: float) -> DataFrame:
    """Every candidate with its probability and whether it is retained."""
    if not 0 <= threshold <= 1:
        raise ValueError(f"threshold {threshold} is no probability")
    return predict(model, rows).withColumn("probability", F.get("probabilities", F.lit(1))).withColumn("retained", F.col("probability") >= threshold).drop("probabilities", "predicted_label")




def detect_two_stage(signals: DataFrame, model: PipelineModel, threshold: float, polarity: str = "positive", recovery: bool = False, keys: Sequence[str] = ("recording_id", "channel")) -> DataFrame:
    """Every stage-1 candidate with its probability and whether the second stage retains it."""
    stage1 = detect_peaks(signals, polarity, recovery, keys=keys).where("r_index IS NOT NULL")
    features = candidate_features(signals, stage1, keys)
    return filter_candidates(model, features.where("error IS NULL").drop("error"), threshold).drop("features")


def candidate_training_rows(signals: DataFrame, references: DataFrame, fs_hz: float, tolerance_s: float = 0.075, polarity: str = "positive", keys: Sequence[str] = ("recording_id", "channel")) -> DataFrame:
    """Features and 0/1 labels of stage-1 candidates against reference peaks (keys, r_index)."""
    stage1 = detect_peaks(signals, polarity, keys=keys).where("r_index IS NOT NULL")
    labels = label_candidates(stage1, references, fs_hz, tolerance_s, keys)
    return candidate_features(signals, stage1, keys).where("error IS NULL").drop("error").join(labels, [*keys, "r_index"])


def save_model(model: PipelineModel, path: str) -> None:
    """Written by Spark ML (no pickles)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
