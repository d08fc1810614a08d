"""Group statistics on experimental units, multiple testing, intervals, bootstrap."""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite_or_null, is_finite
from ..functions.distributions import mann_whitney_p, t_quantile, t_two_sided
from ..functions.prefix import running


def unit_means(values: DataFrame, group: str = "grp", unit: str | None = "unit_id", value: str = "value") -> DataFrame:
    """One row per unit (its mean) if a unit is given, else the finite observations."""
    finite = values.where(is_finite(value))
    if unit is None:
        return finite.select(group, F.col(value).cast("double").alias("value"))
    return finite.groupBy(group, unit).agg(F.avg(value).alias("value"))


def group_moments(reduced: DataFrame, group: str = "grp") -> DataFrame:
    return reduced.groupBy(group).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.percentile("value", F.lit(0.5)).alias("median"), F.var_samp("value").alias("variance"))


def rank_sums(reduced: DataFrame, a, b, group: str = "grp") -> DataFrame:
    """U of group ``a`` against ``b`` with the tie term, from one count per distinct value.

    Ranks come from running counts of distinct values, range by range.
    """
    counts = reduced.where(F.col(group).isin(a, b)).groupBy("value").agg(F.count_if(F.col(group) == a).alias("na"), F.count("*").alias("t"))
    ranked = running(counts, "value", "t", "upto").withColumn("rank", F.col("upto") - (F.col("t") - 1) / 2.0)
    sums = ranked.agg(F.sum(F.col("na") * F.col("rank")).alias("ra"), F.sum("na").alias("n_a"), (F.sum("t") - F.sum("na")).alias("n_b"), F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("tie_term"))
    return sums.select((F.col("ra") - F.col("n_a") * (F.col("n_a") + 1) / 2.0).alias("mann_whitney_u"), "n_a", "n_b", "tie_term")


def compare_groups(values: DataFrame, a, b, group: str = "grp", unit: str | None = "unit_id", value: str = "value") -> DataFrame:
    """One row: Welch's t, Mann-Whitney's U, Cohen's d, moments; raises if a group has fewer than two units.

    The sums are distributed; p-values come from the one-row result.
    """
    seen = values.where(F.col(group).isin(a, b))
    reduced = unit_means(seen, group, unit, value)
    m = {r[group]: r for r in group_moments(reduced, group).where(F.col(group).isin(a, b)).collect()}
    if any(g not in m or m[g]["n"] < 2 for g in (a, b)):
        raise ValueError(f"groups {a!r} and {b!r}: two units with finite values are needed on either side")
    counted = {r[group]: r["c"] for r in seen.groupBy(group).agg(F.count("*").alias("c")).collect()}
    u = rank_sums(reduced, a, b, group).first()
    x, y = m[a], m[b]
    va, vb = x["variance"] / x["n"], y["variance"] / y["n"]
    t = df = p = None
    if va + vb > 0:
        t = (x["mean"] - y["mean"]) / (va + vb) ** 0.5
        df = (va + vb) ** 2 / (va**2 / (x["n"] - 1) + vb**2 / (y["n"] - 1))
        p = t_two_sided(t, df)
    pooled = (((x["n"] - 1) * x["variance"] + (y["n"] - 1) * y["variance"]) / (x["n"] + y["n"] - 2)) ** 0.5
    row = {
        "n_a": x["n"], "n_b": y["n"], "n_observations_a": counted[a], "n_observations_b": counted[b], "unit_of_analysis": "observation" if unit is None else "experimental_unit_mean", "pseudoreplication_warning": unit is None,
        "mean_a": x["mean"], "mean_b": y["mean"], "median_a": x["median"], "median_b": y["median"], "welch_t": t, "welch_df": df, "welch_p": p,
        "mann_whitney_u": u["mann_whitney_u"], "mann_whitney_p": mann_whitney_p(u["mann_whitney_u"], u["n_a"], u["n_b"], u["tie_term"]), "cohens_d": (x["mean"] - y["mean"]) / pooled if pooled > 0 else None,
    }
    schema = "n_a long, n_b long, n_observations_a long, n_observations_b long, unit_of_analysis string, pseudoreplication_warning boolean, mean_a double, mean_b double, median_a double, median_b double, welch_t double, welch_df double, welch_p double, mann_whitney_u double, mann_whitney_p double, cohens_d double"
    return values.sparkSession.createDataFrame([row], schema)


def benjamini_hochberg(tests: DataFrame, p: str = "p_value", order: str = "test_id", keys: Sequence[str] = ()) -> DataFrame:
    """Adjusted p-values: p n / rank, running minimum from the largest p, at most 1."""
    bad = tests.where(~is_finite(p) | (F.col(p) < 0) | (F.col(p) > 1)).limit(1).count()
    if bad:
        raise ValueError("a p-value is missing or lies outside [0, 1]")
    if keys:
        up = Window.partitionBy(*keys).orderBy(p, order)
        n = F.count("*").over(Window.partitionBy(*keys))
        ranked = tests.withColumn("__r", F.row_number().over(up)).withColumn("__q", F.col(p) * n / F.col("__r"))
        down = Window.partitionBy(*keys).orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, 0)
        return ranked.withColumn("p_adjusted", F.least(F.min("__q").over(down), F.lit(1.0))).drop("__r", "__q")
    # One family of tests: equal p-values share the rank of their last, so distinct values suffice.
    levels = running(tests.groupBy(p).agg(F.count("*").alias("__c")), p, "__c", "__r")
    n = tests.count()
    adjusted = running(levels.withColumn("__q", F.col(p) * n / F.col("__r")), p, "__q", "__m", "min", descending=True)
    return tests.join(adjusted.select(F.col(p).alias("__p"), F.least("__m", F.lit(1.0)).alias("p_adjusted")), F.col(p) == F.col("__p")).drop("__p")


def mean_interval(values: DataFrame, value: str = "value", keys: Sequence[str] = (), level: float = 0.95) -> DataFrame:
    """n, mean, sd and the t interval of the mean; sd and interval are null for n = 1."""
    v = finite_or_null(value)
    agg = values.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"))

    @F.pandas_udf("double")
    def critical(n: pd.Series) -> pd.Series:
        return n.map({k: t_quantile(0.5 + level / 2, int(k) - 1) if k > 1 else None for k in n.unique()}).astype(float)

    margin = critical("n") * F.col("sd") / F.sqrt("n")
    return agg.select(*keys, "n", "mean", "sd", (F.col("mean") - margin).alias("ci_low"), (F.col("mean") + margin).alias("ci_high"))


#: Records of a block of the bootstrap, the most blocks, and the most records of an index matrix.
BLOCK_RECORDS, MAX_BLOCKS, MATRIX_RECORDS = 1024, 4096, 20_000


def block_draws(sizes: Sequence[int], block: int, n_bootstrap: int, seed: int) -> np.ndarray:
    """How many of a replicate's draws fall on ``block``, for every replicate.

    All draws of a replicate, as many as there are records, go down a binary tree over the
    blocks; at a node a binomial number, drawn by a generator of the node's own, goes to the
    left half.  So the numbers of all blocks add up exactly, and a task needs its path only.
    """
    upto = np.cumsum([0, *sizes])
    low, high, node, draws = 0, len(sizes), 1, np.full(n_bootstrap, upto[-1])
    while high - low > 1:
        middle, inside = (low + high) // 2, upto[high] - upto[low]
        left = np.random.default_rng([seed, node]).binomial(draws, (upto[middle] - upto[low]) / inside if inside else 0.0)
        if block < middle:
            draws, high, node = left, middle, 2 * node
        else:
            draws, low, node = draws - left, middle, 2 * node + 1
    return draws


def block_sums(values: np.ndarray, block: int, draws: np.ndarray, seed: int) -> np.ndarray:
    """Sum of ``draws`` values drawn with replacement from a block, for every replicate."""
    rng = np.random.default_rng([seed, 1 << 40, block])
    return np.array([values[rng.integers(0, len(values), k)].sum() if k else 0.0 for k in draws.tolist()])


def record_bootstrap(records: DataFrame, value: str, order: str = "recording_id", n_bootstrap: int = 2000, seed: int = 42, method: str = "tree", block_records: int = BLOCK_RECORDS) -> DataFrame:
    """Percentile interval of the mean over records, resampled with replacement; ``method``
    does not depend on their number.

    ``tree``: every replicate has exactly as many draws as there are records (``block_draws``).
    Records are dealt over blocks by the hash of ``order`` and sorted by it there, so a seed
    gives the same interval in any plan; each block is resampled in a task of its own, and a
    sum a replicate and block is all that goes on.  The driver sees the blocks' sizes and
    the replicates' means.

    ``matrix``: the index matrix of NumPy's default generator in the order of ``order``, for
    comparison with reports that were made so; the driver holds the records, of which it
    takes ``MATRIX_RECORDS`` at most.
    """
    if method not in ("tree", "matrix"):
        raise ValueError(f"unknown method {method!r}")
    if n_bootstrap < 100:
        raise ValueError(f"{n_bootstrap} replicates are too few (100)")
    rows = records.select(F.col(order).alias("o"), F.col(value).cast("double").alias("v"))
    facts = rows.agg(F.count("*").alias("n"), F.count_if(~is_finite("v")).alias("bad"), F.avg("v").alias("mean")).first()
    if not facts["n"]:
        raise ValueError("no record to resample")
    if facts["bad"]:
        raise ValueError(f"a record has no finite {value}")
    means = _matrix_interval(rows, facts["n"], n_bootstrap, seed) if method == "matrix" else _tree_interval(rows, facts["n"], n_bootstrap, seed, block_records)
    row = (value, "macro_record_mean", "record", facts["n"], n_bootstrap, seed, float(facts["mean"]), float(means[0]), float(means[1]))
    return records.sparkSession.createDataFrame([row], "metric string, estimand string, unit string, n_records long, n_bootstrap long, seed long, mean double, ci95_low double, ci95_high double")


def _matrix_interval(rows: DataFrame, n: int, n_bootstrap: int, seed: int) -> list[float]:
    if n > MATRIX_RECORDS:
        raise ValueError(f"the index matrix of {n} records is too large ({MATRIX_RECORDS}); use the tree")
    v = np.array([r["v"] for r in rows.orderBy("o").collect()], dtype=float)
    rng = np.random.default_rng(seed)
    parts = [min(256, n_bootstrap - k) for k in range(0, n_bootstrap, 256)]  # replicates drawn at a time, each part going on where the one before ended
    return np.percentile(np.concatenate([v[rng.integers(0, n, size=(k, n))].mean(axis=1) for k in parts]), [2.5, 97.5]).tolist()


def _tree_interval(rows: DataFrame, n: int, n_bootstrap: int, seed: int, block_records: int) -> list[float]:
    blocks = min(MAX_BLOCKS, -(-n // block_records))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.col("o").cast("string")), F.lit(blocks)).cast("int"))
    sizes = [0] * blocks
    for r in dealt.groupBy("block").count().collect():
        sizes[r["block"]] = r["count"]

    def resample(df: pd.DataFrame) -> pd.DataFrame:
        block = int(df["block"].iloc[0])
        values = df.sort_values(["o", "v"])["v"].to_numpy()
        return pd.DataFrame({"rep": np.arange(n_bootstrap), "block": block, "s": block_sums(values, block, block_draws(sizes, block, n_bootstrap, seed), seed)})

    sums = dealt.groupBy("block").applyInPandas(resample, "rep int, block int, s double")
    total = F.aggregate(F.array_sort(F.collect_list(F.struct("block", "s"))), F.lit(0.0), lambda a, x: a + x["s"])  # in the order of blocks, so that sums round alike
    means = sums.groupBy("rep").agg((total / n).alias("mean"))
    return means.agg(F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975))).alias("ci")).first()["ci"]


def pooled_detection(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sums over records, pooled rates, mean and median of the records' timing errors."""
    total = ["reference_count", "detected_count", "true_positive", "false_positive", "false_negative"]
    agg = metrics.groupBy(*keys).agg(F.count("*").alias("records"), *[F.sum(c).alias(c) for c in total], F.avg("mean_timing_error_ms").alias("mean_timing_error_ms"), F.percentile("median_absolute_timing_error_ms", F.lit(0.5)).alias("median_absolute_timing_error_ms"))
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    agg = agg.withColumn("sensitivity", rate("true_positive", "reference_count")).withColumn("positive_predictive_value", rate("true_positive", "detected_count"))
    s, p = F.col("sensitivity"), F.col("positive_predictive_value")
    return agg.withColumn("f1", F.coalesce(F.try_divide(2 * s * p, s + p), F.lit(0.0)))


def boundary_errors(pairs: DataFrame, found: str, reference: str, fs: str = "fs_hz", keys: Sequence[str] = ()) -> DataFrame:
    """Signed and absolute boundary errors in ms."""
    e = (F.col(found) - F.col(reference)) * 1000.0 / F.col(fs)
    rows = pairs.select(*keys, e.alias("e"))
    half = F.lit(0.5)
    return rows.groupBy(*keys).agg(
        F.count("e").alias("n"), F.avg("e").alias("signed_mean_ms"), F.percentile("e", half).alias("signed_median_ms"), F.stddev_samp("e").alias("signed_sd_ms"),
        F.avg(F.abs("e")).alias("absolute_mean_ms"), F.percentile(F.abs("e"), half).alias("absolute_median_ms"), F.percentile(F.abs("e"), F.lit(0.95)).alias("absolute_p95_ms"), F.max(F.abs("e")).alias("absolute_max_ms"),
    )


# --- classification scores --------------------------------------------------------------


def confusion(predictions: DataFrame, truth: str = "label", predicted: str = "prediction", keys: Sequence[str] = ()) -> DataFrame:
    return predictions.groupBy(*keys, truth, predicted).agg(F.count("*").alias("n"))


def classification_scores(predictions: DataFrame, truth: str = "label", predicted: str = "prediction", keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy, balanced accuracy, macro and weighted F1 (nil where undefined), from the confusion matrix."""
    m = confusion(predictions, truth, predicted, keys)
    per = (
        m.select(*keys, F.col(truth).alias("c"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said"), F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0).alias("hit"))
        .unionByName(m.select(*keys, F.col(predicted).alias("c"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said"), F.lit(0).cast("long").alias("hit")))
        .groupBy(*keys, "c")
        .agg(F.sum("support").alias("support"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    )
    f1 = F.coalesce(F.try_divide(2.0 * F.col("hit"), F.col("support") + F.col("said")), F.lit(0.0))
    total = F.sum("support")
    return per.groupBy(*keys).agg(
        F.try_divide(F.sum("hit").cast("double"), total).alias("accuracy"),
        F.avg(F.try_divide(F.col("hit").cast("double"), F.col("support"))).alias("balanced_accuracy"),
        F.avg(f1).alias("macro_f1"),
        F.try_divide(F.sum(f1 * F.col("support")), total).alias("weighted_f1"),
    )


def roc_auc(scored: DataFrame, truth: str = "label", score: str = "score", keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by average ranks; null if a class is missing.

    Counts run over all keys, one after the other; what came before a key is taken off its ranks.
    """
    counts = scored.groupBy(*keys, score).agg(F.sum(F.col(truth).cast("long")).alias("pos"), F.count("*").alias("t"))
    at = "__at" if keys else score
    levels = counts.withColumn(at, F.struct(*keys, score)) if keys else counts
    ranked = running(levels, at, "t", "upto").withColumn("r", F.col("upto") - (F.col("t") - 1) / 2.0)
    s = ranked.groupBy(*keys).agg(F.sum(F.col("pos") * F.col("r")).alias("rs"), F.sum("pos").alias("p"), (F.sum("t") - F.sum("pos")).alias("q"), F.min(F.col("upto") - F.col("t")).alias("before"))
    area = F.col("rs") - F.col("before") * F.col("p") - F.col("p") * (F.col("p") + 1) / 2.0
    return s.select(*keys, F.try_divide(area, (F.col("p") * F.col("q")).cast("double")).alias("roc_auc"))


def one_vs_rest_auc(scored: DataFrame, labels: Sequence[str], truth: str = "label", probabilities: str = "probabilities", keys: Sequence[str] = ()) -> DataFrame:
    """Mean over the classes of the area of each against the others; null if a class is missing.

    ``probabilities``: array in the order of ``labels``.
    """
    parts = [roc_auc(scored.select(*keys, (F.col(truth) == c).cast("int").alias("label"), F.get(probabilities, F.lit(i)).alias("score")), keys=keys) for i, c in enumerate(labels)]
    every = functools.reduce(DataFrame.unionByName, parts)
    return every.groupBy(*keys).agg(F.when(F.count("roc_auc") == len(labels), F.avg("roc_auc")).alias("roc_auc"))
