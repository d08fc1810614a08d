"""Operator 11 - centroid clustering: ball trees filter the candidates of whole balls.

Vectors become whole numbers.  Each task builds metric trees over the vectors of its own
partition, ``BLOCK`` at a time; a node stores its radius about the mean of its vectors,
their count, their sum and the sum of their squared norms.  A tree is a row of a written
table and is built once.  In a round the centroids travel with the tasks and each tree is
walked level by level: a centroid farther from a ball's middle than the nearest one plus
two radii is farther from each of its vectors (triangle inequality), so it leaves the
ball's candidates; a ball with one candidate left goes to it whole, with its count and
sum, and all others are opened down to leaves, whose vectors are compared exactly.
Roundings only ever keep a candidate longer, ties always reach the leaves, and all sums
and distances are whole numbers, so the result is that of comparing everything.

Scale: the vectors are read once and the trees once a round, without a shuffle of vectors;
a task sends ``k`` sums, and k x 66 numbers a round reach the driver, however many vectors
there are.  Equal vectors make balls of radius 0, so a vector repeated very often costs
nothing more.  A lost executor costs the tasks it ran: trees are in the shared folder.

Defined results: vectors that are null, of another length, or with a null or non-finite
component have no row; with fewer than ``k`` vectors each is a centroid at first; the
first centroids are ordered by hash, then by components (repeated vec_ids), a null vec_id
comes last; repeated rows count again; a vector as near to two centroids goes to the
smaller number; an empty cluster keeps its centroid; an empty table gives no rows; further
columns are not read.  A component of 2**27 / ``SCALE`` or more is an error, as a
distance would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_batches

DIM, SCALE, K, ROUNDS, SEED = 64, 256, 40, 5, 2
#: Vectors of a tree, and of a leaf at most.
BLOCK, LEAF = 1024, 32
LIMIT = 1 << 27
#: Below this size of components all steps are exact in float64, which has fast products.
_FAST = 1 << 20
TREES = "ids array<long>, points binary, nodes binary"
_NODE = lambda d: np.dtype([("start", "i4"), ("end", "i4"), ("left", "i4"), ("right", "i4"), ("radius", "f8"), ("mean", "i4", (d,)), ("sum", "i8", (d,)), ("square", "i8")])


def quantised(vectors: DataFrame, column: str, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, q): whole components of the vectors that count."""
    v = F.col(column)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    whole = vectors.select("vec_id", v.cast("array<double>").alias("v")).where((F.size("v") == dim) & F.forall("v", finite))
    return whole.select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("q"))


def first_centroids(q: DataFrame, k: int, seed: int) -> list[list[int]]:
    name: Column = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r["q"]) for r in q.orderBy(F.asc_nulls_last(name), "q").limit(k).collect()]


def tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, nodes) of whole vectors: every node's vectors are ``order[start:end]``."""
    order, nodes, todo = np.arange(len(points)), [], [(0, len(points), -1, "")]
    while todo:
        start, end, parent, side = todo.pop()
        own = points[order[start:end]].astype(np.int64)
        total = own.sum(axis=0)
        mean = total // len(own)
        radius = np.sqrt(float(((own - mean) ** 2).sum(axis=1).max())) * (1 + 1e-12)
        node = np.zeros((), dtype=_NODE(points.shape[1]))
        node["start"], node["end"], node["left"], node["right"], node["radius"], node["mean"], node["sum"] = start, end, -1, -1, radius, mean, total
        node["square"] = (own * own).sum()
        if parent >= 0:
            nodes[parent][side] = len(nodes)
        if end - start > LEAF and radius > 0:
            axis, middle = int(np.argmax(own.max(axis=0) - own.min(axis=0))), (end - start) // 2
            order[start:end] = order[start:end][np.argpartition(own[:, axis], middle)]
            todo += [(start, start + middle, len(nodes), "left"), (start + middle, end, len(nodes), "right")]
        nodes.append(node)
    return order, np.array(nodes)


def _trees(dim: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        held: list[np.ndarray] = []

        def row(n: int) -> pa.RecordBatch:
            nonlocal ids, held
            points = np.concatenate(held)
            block, rest = points[:n], points[n:]
            order, nodes = tree(block)
            out = pa.RecordBatch.from_arrays([pa.array([[ids[i] for i in order]], pa.list_(pa.int64())), pa.array([block[order].astype("<i4").tobytes()], pa.binary()), pa.array([nodes.tobytes()], pa.binary())], names=["ids", "points", "nodes"])
            ids, held = ids[n:], [rest] if len(rest) else []
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            ids += batch.column("vec_id").to_pylist()
            held.append(batch.column("q").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
            if np.abs(held[-1]).max(initial=0) >= LIMIT:
                raise ValueError("a component is too large: distances would not fit a long")
            while len(ids) >= BLOCK:
                yield row(BLOCK)
        if ids:
            yield row(len(ids))

    return build


class Walk:
    """Assignment of the vectors of one tree to the nearest of ``centroids``."""

    def __init__(self, centroids: list[list[int]]):
        self.small = all(abs(x) < _FAST for c in centroids for x in c)
        self.centroids = np.array(centroids, dtype=np.int64)

    def _distances(self, points: np.ndarray, kind) -> np.ndarray:
        p, c = points.astype(kind), self.centroids.astype(kind)
        return (p * p).sum(axis=1)[:, None] - 2 * (p @ c.T) + (c * c).sum(axis=1)[None, :]

    def nearest(self, points: np.ndarray, nodes: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray, np.ndarray]:
        """Whole balls as (node, centroid); positions, centroids and distances of the vectors compared in leaves."""
        kind = np.float64 if self.small and np.abs(points).max(initial=0) < _FAST else object
        balls, leaves = [], []
        active, open_ = np.array([0]), np.ones((1, len(self.centroids)), dtype=bool)
        while len(active):
            far = np.sqrt(self._distances(nodes["mean"][active], kind).astype(np.float64))
            far[~open_] = np.inf
            best = far.argmin(axis=1)
            reach = far[np.arange(len(active)), best] + 2 * nodes["radius"][active]
            open_ &= far <= (reach * (1 + 1e-12) + 1e-6)[:, None]
            whole = open_.sum(axis=1) == 1
            leaf = ~whole & (nodes["left"][active] < 0)
            balls += zip(active[whole].tolist(), best[whole].tolist())
            leaves += active[leaf].tolist()
            inner = ~whole & ~leaf
            active, open_ = np.concatenate([nodes["left"][active[inner]], nodes["right"][active[inner]]]), np.concatenate([open_[inner], open_[inner]])
        at = np.concatenate([np.arange(nodes["start"][n], nodes["end"][n]) for n in leaves]) if leaves else np.empty(0, dtype=np.int64)
        if not len(at):
            return balls, at, np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        d = self._distances(points[at], kind)
        best = d.argmin(axis=1)  # the first of equals
        return balls, at, best, d[np.arange(len(at)), best].astype(np.int64)

    def sums(self, points: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Whole numbers by centroid: component sums, count, sum of squared distances."""
        k, dim = self.centroids.shape
        out = np.zeros((k, dim + 2), dtype=object)
        balls, at, best, d = self.nearest(points, nodes)
        for n, c in balls:
            node, count = nodes[n], int(nodes["end"][n] - nodes["start"][n])
            total, centre = [int(x) for x in node["sum"]], [int(x) for x in self.centroids[c]]
            out[c, :dim] += total
            out[c, dim] += count
            out[c, dim + 1] += int(node["square"]) - 2 * sum(a * b for a, b in zip(total, centre)) + count * sum(x * x for x in centre)
        for c in np.unique(best):
            own = best == c
            out[c, :dim] += [int(x) for x in points[at[own]].astype(np.int64).sum(axis=0)]
            out[c, dim] += int(own.sum())
            out[c, dim + 1] += sum(d[own].tolist())
        return out

    def rows(self, points: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centroid and squared distance of every vector."""
        balls, at, best, d = self.nearest(points, nodes)
        cluster, distance = np.empty(len(points), dtype=np.int64), np.empty(len(points), dtype=np.int64)
        cluster[at], distance[at] = best, d
        for n, c in balls:
            s, e = nodes["start"][n], nodes["end"][n]
            cluster[s:e], distance[s:e] = c, ((points[s:e].astype(np.int64) - self.centroids[c]) ** 2).sum(axis=1)
        return cluster, distance


def _blocks(batches: Iterator[pa.RecordBatch], dim: int):
    for batch in batches:
        for ids, points, nodes in zip(batch.column("ids"), batch.column("points"), batch.column("nodes")):
            yield ids.values, np.frombuffer(points.as_py(), dtype="<i4").reshape(-1, dim), np.frombuffer(nodes.as_py(), dtype=_NODE(dim))


def _totals(trees: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """One pass: sums by centroid, added within a task, then by Spark; k x (dim + 2) numbers come back."""
    dim = len(centroids[0])

    def task(batches):
        walk, out = Walk(centroids), 0
        for _, points, nodes in _blocks(batches, dim):
            out = out + walk.sums(points, nodes)
        if not isinstance(out, int):
            c, j = np.nonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(x) for x in out[c, j]], pa.decimal128(38, 0))], names=["cluster", "part", "total"])

    found = trees.mapInArrow(task, "cluster int, part int, total decimal(38,0)").groupBy("cluster", "part").agg(F.sum("total").alias("total")).collect()
    out = [[0] * (dim + 2) for _ in centroids]
    for r in found:
        out[r["cluster"]][r["part"]] = int(r["total"])
    return out


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, column: str = "embedding", dim: int = DIM) -> tuple[DataFrame, list[list[int]]]:
    """Assignment (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every
    vector that counts, and the final centroids."""
    spark = vectors.sparkSession
    q = quantised(vectors, column, dim)
    scratch = Scratch(spark, "clusters", vectors)
    empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    centroids = first_centroids(q, k, seed)
    if not centroids:
        return spark.createDataFrame([], empty), []
    with arrow_batches(spark, BLOCK):
        trees = scratch.save(q.mapInArrow(_trees(dim), TREES), "trees")
    with arrow_batches(spark, 16):
        for _ in range(rounds):
            sums = _totals(trees, centroids)
            centroids = [[x // s[dim] for x in s[:dim]] if s[dim] else c for c, s in zip(centroids, sums)]
        inertia = [s[dim + 1] for s in _totals(trees, centroids)]
        named = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

        def task(batches):
            walk = Walk(centroids)
            for ids, points, nodes in _blocks(batches, dim):
                c, d = walk.rows(points, nodes)
                own = [pa.array(np.array(inertia, dtype=np.int64)[c]), pa.array([sum(inertia)] * len(c), pa.int64()), pa.array([named[x] for x in c])]
                yield pa.RecordBatch.from_arrays([ids, pa.array(c, pa.int32()), pa.array(d), *own], names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

        out = scratch.save(trees.mapInArrow(task, empty), "assigned")
    scratch.drop(trees)
    return out, centroids


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of the table with its cluster."""
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))[0]


def _sql() -> str:
    down = "(s - ((s % n) + n) % n) // n"
    steps = [
        f"""q AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
WHERE len(embedding) = {DIM} AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding]))""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, q) - 1 AS cluster, q AS c FROM (SELECT q, sha256('{SEED}:' || vec_id) AS h FROM q ORDER BY h, q LIMIT {K}))",
    ]
    for r in range(ROUNDS + 1):
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT id, any_value(vec_id) AS vec_id, any_value(q) AS q, min(d * {K} + cluster) % {K} AS cluster, min(d * {K} + cluster) // {K} AS d FROM "
            f"(SELECT id, vec_id, q, cluster, CAST(list_sum(list_transform(list_zip(q, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM q, c{r}) GROUP BY id)"
        )
        if r < ROUNDS:
            steps.append(
                f"c{r + 1} AS MATERIALIZED (SELECT c{r}.cluster, coalesce(m.c, c{r}.c) AS c FROM c{r} LEFT JOIN (SELECT cluster, list(CAST({down} AS BIGINT) ORDER BY i) AS c FROM "
                f"(SELECT cluster, i, sum(q[i]) AS s, count(*) AS n FROM a{r}, range(1, {DIM + 1}) t(i) GROUP BY cluster, i) GROUP BY cluster) m ON m.cluster = c{r}.cluster)"
            )
    return (
        "WITH " + ",\n".join(steps) + f"\nSELECT vec_id, CAST(a.cluster AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, "
        f"sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN c{ROUNDS} USING (cluster)"
    )


OP11_SQL = _sql()
