"""Random forests grown from counts of binned rows, as stages of Spark ML's pipelines.

Every feature is cut into at most ``BINS`` bins at quantiles of all its values.  Rows that
fall into the same bins with the same label are one row with a number (Spark's own
aggregation), so what is grown from is at most as large as the input.  A tree draws
Poisson(number) copies of each row, which is what its copies would draw together.  Nodes
are split by the weighted Gini gain of ``ceil(sqrt(features))`` features, chosen anew for
each node; a node is a leaf if it is pure, too small, too deep or has no gain.  A forest's
probability is the mean of its leaves' shares.

Distinct rows are dealt by their hash into blocks of about ``BLOCK_ROWS``, each with draws
of its own.  Up to ``TASK_ROWS`` distinct rows, tasks hold all blocks and grow some of the
trees each, with no exchange.  Beyond that all trees grow together, level by level: every
block's counts go to the tasks that sum them for some nodes of a tree and find the splits,
and the driver sees the splits only (a forest has at most 2 ** depth leaves a tree, whatever
the input).  Both ways give the same trees.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import argmax
from ..functions.tables import written

#: Bins of a feature; quantiles asked for; distinct rows of a block, and of a task; nodes whose counts are summed together.
BINS, QUANTILES, BLOCK_ROWS, TASK_ROWS, CHUNK_NODES = 32, 1024, 1 << 16, 1 << 18, 64


def cuts(rows: DataFrame, n_features: int, features: str = "x") -> list[np.ndarray]:
    """Rising bounds of every feature's bins; bin b holds the values above bound b - 1 and up to bound b.

    Equal quantiles count once, so a value that most rows have leaves the other bins to the rest.
    """
    columns = rows.select(*[F.get(features, F.lit(i)).alias(f"f{i}") for i in range(n_features)])
    asked = (np.arange(QUANTILES + 1) / QUANTILES).tolist()
    out = []
    for found in columns.approxQuantile(columns.columns, asked, 0.25 / QUANTILES):
        values = np.unique(np.asarray(found, dtype=float))
        gaps = np.arange(len(values) - 1)
        if len(gaps) >= BINS:
            gaps = np.linspace(0, len(gaps) - 1, BINS - 1).round().astype(int)
        low, high = values[gaps], values[gaps + 1]
        middle = low + (high - low) / 2
        out.append(np.unique(np.where(np.isfinite(middle), middle, low)))
    return out


def binned(x: np.ndarray, bounds: list[np.ndarray]) -> np.ndarray:
    """Bin of every value (rows, features); what is no number is above all bounds."""
    return np.column_stack([np.searchsorted(b, x[:, i], side="left") for i, b in enumerate(bounds)]).astype(np.uint8)


def chosen(seed: int, tree: int, names: np.ndarray, n_features: int, tried: int) -> np.ndarray:
    """The features tried at nodes ``names`` (1 the root, 2n and 2n + 1 the children of n), rising."""
    if tried >= n_features:
        return np.tile(np.arange(n_features), (len(names), 1))
    start = np.random.default_rng([seed, tree, 1 << 40]).integers(0, 1 << 63, dtype=np.uint64)
    with np.errstate(over="ignore"):
        h = start + names.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(n_features, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
        h ^= h >> np.uint64(31)
    return np.sort(np.argpartition(h, tried - 1, axis=1)[:, :tried], axis=1)


def level_counts(bins: np.ndarray, y: np.ndarray, draws: np.ndarray, at: np.ndarray, features: np.ndarray, n_classes: int) -> Iterator[np.ndarray]:
    """For each of the features tried: the draws by (node, bin, class); ``at`` is the node of every row."""
    m, row, flat = len(features), np.arange(len(at)) * bins.shape[1], bins.ravel()
    for j in range(features.shape[1]):
        cell = (at * BINS + flat[row + features[at, j]]) * n_classes + y
        yield np.bincount(cell, weights=draws, minlength=m * BINS * n_classes).reshape(m, BINS, n_classes)


def best_splits(counts: Iterable[np.ndarray], features: np.ndarray, weights: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Per node: draws by class, whether a split gains, its feature, its last bin on the left, draws by class there."""
    m, nodes = len(features), np.arange(len(features))
    score = np.full(m, -np.inf)
    feature, cut, whole, kept = np.zeros(m, dtype=np.int64), np.zeros(m, dtype=np.int64), None, None
    for j, c in enumerate(counts):
        if whole is None:
            whole, kept = c.sum(axis=1), np.zeros((m, c.shape[2]))
        left = np.cumsum(c, axis=1)[:, :-1]
        n_left, n = left.sum(axis=2), whole.sum(axis=1)
        lw, tw = left * weights, (whole * weights)[:, None]
        rw = tw - lw
        with np.errstate(invalid="ignore", divide="ignore"):
            gini = (lw**2).sum(axis=2) / lw.sum(axis=2) + (rw**2).sum(axis=2) / rw.sum(axis=2)
        gini = np.where((n_left >= least) & (n[:, None] - n_left >= least), gini, -np.inf)
        at = gini.argmax(axis=1)
        better = gini[nodes, at] > score
        score = np.where(better, gini[nodes, at], score)
        feature, cut = np.where(better, features[:, j], feature), np.where(better, at, cut)
        kept = np.where(better[:, None], left[nodes, at], kept)
    w = whole * weights
    total = np.maximum(w.sum(axis=1), 1e-300)
    return whole, score - (w**2).sum(axis=1) / total > 1e-9 * total, feature, cut, kept


class Tree:
    """A tree while it grows: nodes in levels, of which some in the last are open."""

    def __init__(self, depth: int, least: int, n_classes: int):
        self.depth, self.least = depth, least
        self.levels = [self._level(np.zeros((1, n_classes)), 0)]
        self.open, self.names = np.array([0]), np.array([1])  # places in the last level

    @staticmethod
    def _level(totals: np.ndarray, first: int) -> dict[str, np.ndarray | int]:
        n = len(totals)
        return {"first": first, "totals": totals, "feature": np.zeros(n, dtype=np.int64), "cut": np.full(n, BINS - 1), "left": first + np.arange(n)}

    def split(self, whole: np.ndarray, gains: np.ndarray, feature: np.ndarray, cut: np.ndarray, kept: np.ndarray) -> np.ndarray:
        """Split the open nodes that gain.  Of both children of every open node: its place among the nodes then open, or -1."""
        last, go = self.levels[-1], np.flatnonzero(gains)
        last["totals"][self.open] = whole
        first = last["first"] + len(last["totals"])
        place = self.open[go]
        last["feature"][place], last["cut"][place], last["left"][place] = feature[go], cut[go], first + 2 * np.arange(len(go))
        totals = np.stack([kept[go], whole[go] - kept[go]], axis=1).reshape(2 * len(go), whole.shape[1])
        names = (2 * self.names[go][:, None] + np.arange(2)).ravel()
        goes_on = ((totals > 0).sum(axis=1) > 1) & (totals.sum(axis=1) >= 2 * self.least) & (len(self.levels) < self.depth)
        self.open, self.names = np.flatnonzero(goes_on), names[goes_on]
        if len(go):
            self.levels.append(self._level(totals, first))
        slots = np.full((len(gains), 2), -1)
        slots[go] = np.where(goes_on, np.cumsum(goes_on) - 1, -1).reshape(-1, 2)
        return slots

    def nodes(self, weights: np.ndarray) -> dict[str, np.ndarray]:
        """feature, cut, left (a leaf is its own left child; the right one follows the left) and shares of the classes."""
        out = {k: np.concatenate([v[k] for v in self.levels]).astype(kind) for k, kind in (("feature", np.int32), ("cut", np.uint8), ("left", np.int32))}
        w = np.concatenate([v["totals"] for v in self.levels]) * weights
        return {**out, "shares": (w / np.maximum(w.sum(axis=1, keepdims=True), 1e-300)).astype(np.float32)}


def draws_of(number: np.ndarray, seed: int, tree: int, block: int) -> np.ndarray:
    return np.random.default_rng([seed, tree, block]).poisson(number)


def descend(bins: np.ndarray, nodes: dict[str, np.ndarray], steps: int) -> np.ndarray:
    at, row = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
    for _ in range(steps):
        at = nodes["left"][at] + (bins[row, nodes["feature"][at]] > nodes["cut"][at])
    return at


def _blocks(table: pa.Table, n_features: int) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(block, bins, y, number) of rows made by ``deal``, in the order of blocks."""
    out = []
    for r in sorted(table.to_pylist(), key=lambda r: r["block"]):
        out.append((r["block"], np.frombuffer(r["bins"], np.uint8).reshape(-1, n_features), np.frombuffer(r["y"], np.int64), np.frombuffer(r["number"], np.int64)))
    return out


def _packed(arrays: dict[str, np.ndarray]) -> bytes:
    held = io.BytesIO()
    np.savez(held, **arrays)
    return held.getvalue()


def _unpacked(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw), allow_pickle=False) as z:
        return {k: z[k] for k in z.files}


def deal(rows: DataFrame, bounds: list[np.ndarray], block_rows: int) -> tuple[DataFrame, int]:
    """``rows`` (x, y) binned, equal ones as one with their number, in blocks by their hash; how many distinct ones there are."""

    def to_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bins = binned(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), bounds)
                yield pa.RecordBatch.from_arrays([pa.array([b.tobytes() for b in bins], pa.binary()), batch.column(1)], names=["bins", "y"])

    distinct = written(rows.select("x", "y").mapInArrow(to_bins, "bins binary, y long").groupBy("bins", "y").agg(F.count("*").alias("number")))
    n = distinct.count()
    n_blocks = max(1, -(-n // block_rows))
    share = F.shiftrightunsigned(F.xxhash64("bins", "y"), 11) / float(1 << 53)

    def to_block(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["bins", "y"])
        return pd.DataFrame([{"block": df["block"].iloc[0], "bins": b"".join(df["bins"]), "y": df["y"].to_numpy(np.int64).tobytes(), "number": df["number"].to_numpy(np.int64).tobytes()}])

    placed = distinct.withColumn("block", F.floor(share * n_blocks).cast("int"))
    return written(placed.groupBy("block").applyInPandas(to_block, "block int, bins binary, y binary, number binary")), n


class _Plan:
    """What all tasks of a fit know."""

    def __init__(self, n_features: int, weights: np.ndarray, trees: int, depth: int, least: int, seed: int):
        self.n_features, self.weights, self.trees, self.depth, self.least, self.seed = n_features, weights, trees, depth, least, seed
        self.chunk = CHUNK_NODES
        self.tried = n_features if trees == 1 else math.ceil(math.sqrt(n_features))

    def features(self, tree: int, names: np.ndarray) -> np.ndarray:
        return chosen(self.seed, tree, names, self.n_features, self.tried)


def grow_whole(plan: _Plan, blocks: list[tuple], tree: int) -> dict[str, np.ndarray]:
    """One tree of rows that a task holds."""
    bins, y = np.concatenate([b[1] for b in blocks]), np.concatenate([b[2] for b in blocks])
    draws = np.concatenate([draws_of(number, plan.seed, tree, b) for b, _, _, number in blocks])
    grown = Tree(plan.depth, plan.least, len(plan.weights))
    rows = np.flatnonzero(draws)
    bins, y, draws, at = bins[rows], y[rows], draws[rows], np.zeros(len(rows), dtype=np.int64)
    while len(grown.open) and plan.depth:
        features = plan.features(tree, grown.names)
        found = best_splits(level_counts(bins, y, draws, at, features, len(plan.weights)), features, plan.weights, plan.least)
        right = bins[np.arange(len(at)), found[2][at]] > found[3][at]
        at = grown.split(*found)[at, right.astype(np.int64)]
        rows = np.flatnonzero(at >= 0)
        bins, y, draws, at = bins[rows], y[rows], draws[rows], at[rows]
    return grown.nodes(plan.weights)


def grow_in_tasks(plan: _Plan, blocks: DataFrame) -> list[dict[str, np.ndarray]]:
    """All trees, some in each task, which holds all blocks."""
    spark = blocks.sparkSession
    tasks = min(plan.trees, max(24, 3 * spark.sparkContext.defaultParallelism))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if parts := [b for b in batches if b.num_rows]:
            table = pa.Table.from_batches(parts)
            held = _blocks(table, plan.n_features)
            for tree in range(table.column("id")[0].as_py(), plan.trees, tasks):
                yield pa.RecordBatch.from_pylist([{"tree": tree, "nodes": _packed(grow_whole(plan, held, tree))}])

    grown = spark.range(0, tasks, 1, tasks).crossJoin(F.broadcast(blocks)).mapInArrow(run, "tree long, nodes binary")
    nodes: list = [None] * plan.trees
    for r in grown.collect():
        nodes[r["tree"]] = _unpacked(bytes(r["nodes"]))
    return nodes


def grow_by_levels(plan: _Plan, blocks: DataFrame) -> list[dict[str, np.ndarray]]:
    """All trees together, one level after the other; a task counts a block or sums some nodes."""
    spark, k = blocks.sparkSession, len(plan.weights)
    trees = [Tree(plan.depth, plan.least, k) for _ in range(plan.trees)]
    result = "tree long, chunk long, found binary"
    for level in range(plan.depth):
        growing = {t: {**x.nodes(plan.weights), "names": x.names, "open": x.levels[-1]["first"] + x.open} for t, x in enumerate(trees) if len(x.open)}
        if not growing:
            break
        known = spark.sparkContext.broadcast(growing)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, bins, y, number in _blocks(pa.Table.from_batches([batch]), plan.n_features):
                    for t, nodes in known.value.items():
                        draws = draws_of(number, plan.seed, t, block)
                        slot = np.full(len(nodes["left"]), -1)
                        slot[nodes["open"]] = np.arange(len(nodes["open"]))
                        at = slot[descend(bins, nodes, level)]
                        rows = np.flatnonzero((at >= 0) & (draws > 0))
                        rows = rows[np.argsort(at[rows], kind="stable")]
                        bounds = np.arange(0, len(nodes["open"]) + plan.chunk, plan.chunk)
                        edges = np.searchsorted(at[rows], bounds)
                        for chunk, (a, b) in enumerate(zip(edges, edges[1:])):
                            part, names = rows[a:b], nodes["names"][bounds[chunk] : bounds[chunk + 1]]
                            counts = np.stack(list(level_counts(bins[part], y[part], draws[part], at[part] - bounds[chunk], plan.features(t, names), k))).ravel()
                            cell = np.flatnonzero(counts)
                            yield pa.RecordBatch.from_pylist([{"tree": t, "chunk": chunk, "cell": cell.tobytes(), "n": counts[cell].tobytes()}])

        def decide(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
            t, chunk = int(key[0]), int(key[1])
            features = plan.features(t, known.value[t]["names"][chunk * plan.chunk : (chunk + 1) * plan.chunk])
            counts = np.zeros(features.size * BINS * k)
            for cell, n in zip(df["cell"], df["n"]):
                counts[np.frombuffer(cell, np.int64)] += np.frombuffer(n, float)
            found = best_splits(counts.reshape(plan.tried, len(features), BINS, k), features, plan.weights, plan.least)
            return pd.DataFrame([{"tree": t, "chunk": chunk, "found": _packed({str(i): x for i, x in enumerate(found)})}])

        said = blocks.mapInArrow(count, "tree long, chunk long, cell binary, n binary").groupBy("tree", "chunk").applyInPandas(decide, result).collect()
        by_tree: dict[int, list] = {}
        for r in sorted(said, key=lambda r: (r["tree"], r["chunk"])):
            by_tree.setdefault(r["tree"], []).append(_unpacked(bytes(r["found"])))
        for t, parts in by_tree.items():
            trees[t].split(*[np.concatenate([p[str(i)] for p in parts]) for i in range(5)])
        known.destroy()
    return [x.nodes(plan.weights) for x in trees]


class Forest(Estimator):
    """Estimator of a random forest; columns as Spark ML names them.  Weights are those of classes."""

    def __init__(self, trees: int = 200, depth: int = 14, least: int = 1, seed: int = 42, features: str = "__x", label: str = "__y", weight: str = "weight", block_rows: int = BLOCK_ROWS, task_rows: int = TASK_ROWS):
        super().__init__()
        if trees < 1 or depth < 1:
            raise ValueError("forest: one tree and one level of splits at least")
        self.trees, self.depth, self.least, self.seed = trees, depth, least, seed
        self.features, self.label, self.weight = features, label, weight
        self.block_rows, self.task_rows = block_rows, task_rows

    def _fit(self, dataset: DataFrame) -> ForestModel:
        rows = written(dataset.select(vector_to_array(self.features).alias("x"), F.col(self.label).cast("long").alias("y"), F.col(self.weight).alias("w")))
        facts = rows.groupBy("y").agg(F.min("w").alias("low"), F.max("w").alias("high"), F.max(F.size("x")).alias("n")).collect()
        if not facts:
            raise ValueError("forest: no row to grow from")
        if any(r["low"] != r["high"] for r in facts):
            raise ValueError("forest: rows of one class must have one weight")
        weights = np.zeros(1 + max(r["y"] for r in facts))
        for r in facts:
            weights[r["y"]] = r["low"]
        n_features = max(r["n"] for r in facts)
        bounds = cuts(rows, n_features)
        blocks, n = deal(rows, bounds, self.block_rows)
        plan = _Plan(n_features, weights, self.trees, self.depth, self.least, self.seed)
        grown = (grow_in_tasks if n <= self.task_rows else grow_by_levels)(plan, blocks)
        first = np.cumsum([0, *(len(t["left"]) for t in grown[:-1])])
        nodes = {k: np.concatenate([t[k] for t in grown]) for k in ("feature", "cut", "shares")}
        nodes["left"] = np.concatenate([t["left"] + np.int32(a) for t, a in zip(grown, first)])
        del grown
        padded = np.full((n_features, BINS), np.inf)
        for i, b in enumerate(bounds):
            padded[i, : len(b)] = b
        leaf = nodes["left"] == np.arange(len(nodes["left"]))
        threshold = np.where(leaf, np.inf, padded[nodes["feature"], nodes.pop("cut")])
        return ForestModel({**nodes, "threshold": threshold, "first": first, "depth": np.array(self.depth)}, self.features)


class ForestModel(Model, MLWritable, MLReadable):
    """Adds ``probability`` (a vector) and ``prediction``, as Spark ML's classifiers do."""

    def __init__(self, nodes: dict[str, np.ndarray] | None = None, features: str = "__x"):
        super().__init__()
        self.nodes, self.features = nodes, features

    def _transform(self, dataset: DataFrame) -> DataFrame:
        held = dataset.sparkSession.sparkContext.broadcast(self.nodes)

        def scored(x: pa.Array) -> pa.Array:
            p = probabilities(held.value, x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)) if len(x) else np.empty((0, 1))
            return pa.ListArray.from_arrays(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32), p.ravel())

        out = dataset.withColumn("__p", F.arrow_udf(scored, "array<double>")(vector_to_array(self.features)))
        return out.withColumn("probability", array_to_vector("__p")).withColumn("prediction", argmax("__p").cast("double")).drop("__p")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


def probabilities(nodes: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Mean of the leaves' shares (rows, classes); what is no number goes right."""
    x = np.where(np.isnan(x), np.inf, x)
    flat, row = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
    out = np.zeros((len(x), nodes["shares"].shape[1]))
    for first in nodes["first"]:
        at = np.full(len(x), first)
        for _ in range(int(nodes["depth"])):
            to = nodes["left"][at] + (flat[row + nodes["feature"][at]] > nodes["threshold"][at])
            if np.array_equal(to, at):
                break
            at = to
        out += nodes["shares"][at]
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1e-300)  # a tree that drew no row has no say


class _Writer(MLWriter):
    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={"features": self.model.features})
        self.sparkSession.createDataFrame([(_packed(self.model.nodes),)], "nodes binary").write.parquet(f"{path}/data")


class _Reader(MLReader):
    def load(self, path: str) -> ForestModel:
        about = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = ForestModel(_unpacked(bytes(self.sparkSession.read.parquet(f"{path}/data").first()["nodes"])), about["features"])
        model._resetUid(about["uid"])
        return model
