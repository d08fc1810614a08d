"""Operator 2 - quality classifier by importance resampling.

Two hashed n-gram models (words and word pairs into ``BUCKETS`` buckets) are
counted: one of the raw corpus, over every document, and one of the target,
over labelled good documents.  A document's log importance ratio is the sum
over its n-grams of log p_target - log p_raw.  Documents are drawn without
replacement by Gumbel top-k: the key of a document is its logit plus a standard
Gumbel variate, and the k documents of the largest keys are kept, the others
rejected; that is the same as drawing k documents one after another, each with
probability in proportion to exp(logit) among those left.

The logit is the tempered log ratio, ``sharpness`` times the log ratio per n-gram
(``SHRINK`` n-grams of ratio 0 added): the plain sum grows with the length, and a
long text's sum would drown a short one's.  With the default of 100 the draw
decides near the cutoff, where about one document in a hundred lies; the smaller
the sharpness, the more the draw decides.  k is the number of documents whose ratio
per n-gram reaches a cutoff, set on labelled documents that the target model
has not seen: the highest one at which at most ``false_reject`` of the good ones
stay below, no higher than where good and bad are best told apart.

Scale: two scans.  The first makes one partial count vector a task, summed by
bucket in Spark; the models are ``BUCKETS`` numbers each on the driver, however
large the corpus.  Labelled rows for the target and the cutoff are a sample,
the ``fit_rows`` (20,000) smallest by hash of their id; all else covers all
documents.  The k-th key is found by refining a histogram of keys, so no key is
sorted or collected.  The variate is a hash of id, text and seed: retried tasks
draw the same.

Defined results: null and empty texts have no n-grams, weight 0 and are
rejected; very long texts count whole; repeated rows get the same key and fall or
stay together (k may be exceeded by such ties only); null ids are allowed; without
usable labels nothing but empty texts is rejected; empty tables give empty results;
columns of other names are ignored (``keep_quality`` passes them through).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, Scratch, mix64, word_hashes

BUCKETS = 1 << 15
FIT_ROWS = 20_000
SHARPNESS = 100.0
#: n-grams of weight 0 added to every document, so that very short texts are not judged by a word or two.
SHRINK = 20
_WORDS = re.compile(WORD)


def ngram_buckets(text: str | None, cache: dict) -> np.ndarray:
    """Bucket of every word and word pair of a whole text."""
    words = _WORDS.findall(text) if text else []
    if not words:
        return np.empty(0, dtype=np.int64)
    h = word_hashes(words, cache)
    with np.errstate(over="ignore"):
        pairs = mix64((h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ h[1:])
    return (np.concatenate([h, pairs]) & np.uint64(BUCKETS - 1)).astype(np.int64)


def gumbel(doc_id: int | None, text: str | None, seed: int) -> float:
    """Standard Gumbel variate from a hash."""
    u = xxhash.xxh3_64_intdigest(f"{seed}|{doc_id}|".encode() + (text or "").encode("utf-8", "surrogatepass"))
    return float(-np.log(-np.log(((u >> 11) + 0.5) / 2**53)))


def count_ngrams(docs: DataFrame, target_ids: set[int]) -> tuple[np.ndarray, np.ndarray]:
    """(raw counts over all documents, counts over the target documents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        counts = np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = np.bincount(ngram_buckets(text, cache), minlength=BUCKETS)
                counts[0] += got
                if doc_id in target_ids:
                    counts[1] += got
        at = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0, at]), pa.array(counts[1, at])], names=["bucket", "raw", "target"])

    partial = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "bucket long, raw long, target long")
    total = partial.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    out = np.zeros((2, BUCKETS), dtype=np.int64)
    out[0, total["bucket"]], out[1, total["bucket"]] = total["raw"], total["target"]
    return out[0], out[1]


def log_ratio(raw: np.ndarray, target: np.ndarray, pseudo: float = 1.0) -> np.ndarray:
    """log p_target - log p_raw per bucket; the raw model is the target's prior."""
    if not target.sum():
        return np.zeros(BUCKETS)
    p_raw = (raw + pseudo) / (raw.sum() + pseudo * BUCKETS)
    p_target = (target + BUCKETS * pseudo * p_raw) / (target.sum() + BUCKETS * pseudo)
    return np.log(p_target) - np.log(p_raw)


def _scored(batch_ids, batch_texts, ratio: np.ndarray, seed: int, sharpness: float, cache: dict):
    """Rows of (n-grams, log weight, key); the key is null without n-grams."""
    out = []
    for doc_id, text in zip(batch_ids, batch_texts):
        b = ngram_buckets(text, cache)
        w = float(ratio[b].sum()) if len(b) else 0.0
        out.append((len(b), w, sharpness * w / (len(b) + SHRINK) + gumbel(doc_id, text, seed) if len(b) else None))
    return out


def score_documents(docs: DataFrame, ratio: np.ndarray, seed: int, sharpness: float) -> DataFrame:
    """(doc_id, n_ngrams, log_weight, key) of every row."""
    schema = "doc_id long, n_ngrams long, log_weight double, key double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for batch in batches:
            rows = _scored(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ratio, seed, sharpness, cache)
            n, w, k = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(w, pa.float64()), pa.array(k, pa.float64())], names=["doc_id", "n_ngrams", "log_weight", "key"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def choose_cutoff(good: np.ndarray, bad: np.ndarray, false_reject: float) -> float | None:
    """Weight per n-gram below which a document counts as unlike the target."""
    if not len(good) or not len(bad):
        return None
    good, bad = np.sort(good), np.sort(bad)
    safe = good[int(false_reject * len(good))]  # at most that share lies strictly below
    grid = np.unique(np.concatenate([good, bad]))
    gain = np.searchsorted(bad, grid) / len(bad) - np.searchsorted(good, grid) / len(good)
    best = grid[gain.argmax()]
    below = bad[np.searchsorted(bad, best) - 1] if np.searchsorted(bad, best) else best
    return float(min(safe, (best + below) / 2))


def kth_largest(scored: DataFrame, k: int) -> float:
    """A key t with as few keys >= t as possible, but at least ``k``."""
    low, high = scored.agg(F.min("key"), F.max("key")).first()
    above, bins = 0, 1024  # keys >= high that are known to be taken
    for _ in range(6):
        width = (high - low) / bins
        if k <= above or width <= abs(high) * 1e-15:
            break
        number = F.least(F.floor((F.col("key") - low) / width), F.lit(bins - 1))
        counts = np.zeros(bins, dtype=np.int64)
        for r in scored.where((F.col("key") >= low) & (F.col("key") <= high)).groupBy(number.alias("b")).count().collect():
            counts[int(r["b"])] = r["count"]
        from_top = above + np.cumsum(counts[::-1])
        i = int(np.searchsorted(from_top, k))  # first bin from the top at which k are reached
        if i >= bins:
            break
        b = bins - 1 - i
        above = int(from_top[i - 1]) if i else above
        low, high = low + b * width, low + (b + 1) * width
        if counts[b] == 1:
            break
    return float(low)


class Selection:
    """What the fit leaves: the ratio per bucket and the smallest kept key."""

    def __init__(self, ratio: np.ndarray, least: float | None, seed: int, sharpness: float):
        self.ratio, self.least, self.seed, self.sharpness = ratio, least, seed, sharpness


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, false_reject: float = 0.003, sharpness: float = SHARPNESS, seed: int = 1) -> tuple[Selection, DataFrame]:
    """(selection, scores of all rows)."""
    usable = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("q2")).where("q = q2")
    sample = usable.select("doc_id", (F.col("q") > 0).alias("good"), F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(fit_rows).collect()
    target = {r["doc_id"] for r in sample if r["good"] and r["h"] % 4}
    held = {r["doc_id"]: r["good"] for r in sample if r["doc_id"] not in target}
    ratio = log_ratio(*count_ngrams(docs, target))
    scored = Scratch(docs.sparkSession, "quality").save(score_documents(docs, ratio, seed, sharpness), "scored", wide=True)
    seen = scored.where(F.col("n_ngrams") > 0).select("doc_id", (F.col("log_weight") / (F.col("n_ngrams") + SHRINK)).alias("w"))
    spark = docs.sparkSession
    held_rows = spark.createDataFrame(list(held.items()), "doc_id long, good boolean")  # at most fit_rows
    known = seen.join(F.broadcast(held_rows), "doc_id").dropDuplicates(["doc_id"]).toPandas()
    cutoff = choose_cutoff(known.loc[known["good"].astype(bool), "w"].to_numpy(float), known.loc[~known["good"].astype(bool), "w"].to_numpy(float), false_reject)
    if cutoff is None:
        return Selection(ratio, None, seed, sharpness), scored
    k = seen.where(F.col("w") >= cutoff).count()
    return Selection(ratio, kth_largest(scored.where(F.col("key").isNotNull()), k) if k else float("inf"), seed, sharpness), scored


def keep_quality(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that the resampling keeps."""
    chosen, _ = fit(docs, labels, **settings)
    id_at, text_at = docs.columns.index("doc_id"), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for batch in batches:
            rows = _scored(batch.column(id_at).to_pylist(), batch.column(text_at).to_pylist(), chosen.ratio, chosen.seed, chosen.sharpness, cache)
            yield batch.filter(pa.array([k is not None and (chosen.least is None or k >= chosen.least) for _, _, k in rows], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Weights, keys and verdict of every document."""
    chosen, scored = fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = F.col("key").isNotNull() if chosen.least is None else F.coalesce(F.col("key") >= chosen.least, F.lit(False))
    return scored.select("doc_id", "n_ngrams", "log_weight", "key", kept.alias("kept"))
