"""Forests: both ways of growing, a tree by plain recursion, few passes, saving."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cardiolake.operators import forest, learning, stats


def table(spark, n=600, seed=0, width=5):
    """Two classes told apart by two features, one noise label in ten, many equal rows."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, width)), 1)
    y = ((x[:, 0] + x[:, 1] > 0) ^ (rng.random(n) < 0.1)).astype(int)
    x[: n // 4], y[: n // 4] = x[0], y[0]
    rows = [(f"g{i % 12}", str(c), v) for i, (c, v) in enumerate(zip(y.tolist(), x.tolist()))]
    return spark.createDataFrame(rows, "group_id string, label string, features array<double>")


def fitted(rows, **how):
    data = rows.select(array_to_vector("features").alias("__x"), F.col("label").cast("double").alias("__y"), F.when(F.col("label") == "1", 0.7).otherwise(1.6).alias("weight"))
    return forest.Forest(**how).fit(data), data


def jobs(spark):
    return spark.sparkContext._jsc.sc().dagScheduler().nextJobId()


def test_both_ways_give_the_same_trees(spark, monkeypatch):
    monkeypatch.setattr(forest, "CHUNK_NODES", 3)  # the counts of a level go to several tasks
    rows, how = table(spark), {"trees": 4, "depth": 5, "least": 2, "block_rows": 90}
    whole, data = fitted(rows, **how)
    levels, _ = fitted(rows.repartition(7), task_rows=10, **how)
    assert {k: v.tolist() for k, v in whole.nodes.items()} == {k: v.tolist() for k, v in levels.nodes.items()}
    said = whole.transform(data).select("prediction", F.col("__y")).collect()
    assert np.mean([r["prediction"] == r["__y"] for r in said]) > 0.85


def test_a_tree_is_that_of_plain_recursion(spark):
    rng = np.random.default_rng(3)
    bins, y, number = rng.integers(0, 6, (200, 3)).astype(np.uint8), rng.integers(0, 2, 200), rng.integers(1, 4, 200)
    plan = forest._Plan(3, np.array([1.5, 0.8]), 1, 4, 3, 9)
    got = forest.grow_whole(plan, [(0, bins, y, number)], 0)
    draws = forest.draws_of(number, 9, 0, 0)

    def weight(rows):
        return np.array([draws[rows & (y == c)].sum() for c in (0, 1)]) * plan.weights

    def gini(rows):
        w = weight(rows)
        return w.sum() - (w**2).sum() / w.sum() if w.sum() else 0.0

    def leaves(rows, depth):
        found = []
        for f in range(3):
            for cut in range(5):
                left = bins[:, f] <= cut
                a, b = rows & left, rows & ~left
                if min(draws[a].sum(), draws[b].sum()) >= 3:
                    found.append((gini(a) + gini(b), f, cut, a, b))
        best = min(found, key=lambda r: (round(r[0], 9), r[1], r[2]), default=None)
        if depth == 0 or best is None or gini(rows) - best[0] <= 1e-9 or (weight(rows) > 0).sum() < 2:
            return [(frozenset(np.flatnonzero(rows & (draws > 0)).tolist()), round(float(weight(rows)[1] / weight(rows).sum()), 5))]
        return leaves(best[3], depth - 1) + leaves(best[4], depth - 1)

    at, shares = forest.descend(bins, got, 4), got["shares"][:, 1]
    mine = {(frozenset(np.flatnonzero((at == k) & (draws > 0)).tolist()), round(float(shares[k]), 5)) for k in set(at[draws > 0].tolist())}
    assert mine == set(leaves(np.ones(200, dtype=bool), 4))


def test_rare_and_odd_values_have_bins(spark):
    values = [0.0] * 950 + [float(i) for i in range(1, 51)]
    rows = spark.createDataFrame([([v, 7.0, float("nan") if i % 2 else 1.0],) for i, v in enumerate(values)], "x array<double>")
    many, one, odd = forest.cuts(rows, 3)
    assert len(many) == 31 and many[0] == 0.5 and np.diff(many).max() <= 2.5
    assert len(one) == 0 and len(odd) == 0
    assert forest.binned(np.array([[0.0, 7.0, np.nan], [0.5, 7.0, np.inf], [99.0, 8.0, 0.0]]), [many, np.array([7.0]), np.array([0.5])]).tolist() == [[0, 0, 1], [0, 0, 1], [31, 1, 0]]


def test_weights_are_those_of_classes(spark):
    rows = table(spark, 40)
    with pytest.raises(ValueError):
        forest.Forest(2).fit(rows.select(array_to_vector("features").alias("__x"), F.col("label").cast("double").alias("__y"), F.rand(1).alias("weight")))


def test_a_benchmark_is_a_bounded_number_of_jobs(spark):
    """Forests of the default size on few rows; the scores of all runs are counted together."""
    rows = table(spark)
    before = jobs(spark)
    per_fold, summary = learning.benchmark(rows, 3, models={"forest": learning.forest(300)})
    assert jobs(spark) - before < 180
    assert per_fold.count() == 3 and summary.count() == 5
    assert all(r["accuracy"] > 0.8 and r["roc_auc"] > 0.8 for r in per_fold.collect())


def test_scores_by_key_are_those_of_each_key(spark):
    rng = np.random.default_rng(5)
    rows = [(k, str(int(rng.integers(0, 3))), str(int(rng.integers(0, 3))), rng.integers(0, 6, 3).astype(float).tolist()) for k in ("a", "b", "c") for _ in range(40)]
    said = spark.createDataFrame([*rows, ("d", "0", "1", [1.0, 2.0, 3.0])], "run string, truth string, predicted string, p array<double>")
    scores = {r["run"]: r.asDict() for r in stats.classification_scores(said, "truth", "predicted", ["run"]).collect()}
    areas = {r["run"]: r["roc_auc"] for r in stats.one_vs_rest_auc(said, ["0", "1", "2"], "truth", "p", ["run"]).collect()}
    for k in ("a", "b", "c", "d"):
        own = said.where(F.col("run") == k)
        assert {**stats.classification_scores(own, "truth", "predicted").first().asDict(), "run": k} == pytest.approx(scores[k])
        alone = stats.one_vs_rest_auc(own, ["0", "1", "2"], "truth", "p").first()[0]
        assert areas[k] == (None if alone is None else pytest.approx(alone))
    assert areas["d"] is None


def test_the_suppressor_makes_its_rows_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def counted(x):
        made.add(1)
        return x

    rows = table(spark, 200).select(F.col("label").cast("int").alias("label"), counted("features").alias("features"))
    model, about = learning.fit_suppressor(rows, 0.9, trees=10)
    assert made.value == 200 and about["n_training_candidates"] == 200 and 0 < about["threshold"] <= 1


def test_a_saved_forest_is_the_same(spark, tmp_path):
    rows = table(spark, 120)
    model = learning.train(rows, learning.forest(5, 4))
    learning.save_model(model, f"file://{tmp_path}/m")
    again = learning.load_model(f"file://{tmp_path}/m")
    said = [sorted((r["features"], r["probabilities"]) for r in learning.predict(m, rows).collect()) for m in (model, again)]
    assert said[0] == said[1] and learning.classes(again) == ["0", "1"]
