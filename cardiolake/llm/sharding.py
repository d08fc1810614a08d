"""Operator 7 - sharding by minimax contiguous partition.

All rows of equal text form one atomic group.  Groups stand in the order of
their content key.  The smallest capacity for which a greedy left-to-right fill
needs at most ``n_shards`` shards is found by binary search, and the groups are
cut there, so the largest shard is as small as any contiguous cut allows.

Scale: groups are pre-aggregated (partial sums, so a hot text costs one row per
task) and written in the order of their keys.  The driver holds one sum per *bucket*
of about ``bucket_groups`` groups; the sizes inside a bucket are fetched only when a
cut falls into it, by a filter on the key's range that Parquet's statistics answer
from the few row groups that have it.  So driver memory is ``n_groups /
bucket_groups`` numbers plus a few buckets, and the search reads a few buckets.

Defined results: very long texts count by their whole length; a null text has size 1, crc 0 and forms one group with the
other null texts; empty text likewise has size 1 but its own group; repeated
rows each get their own slot; null doc_id is allowed; an empty table gives an
empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, text_key


class _Prefix:
    """Prefix sums over ordered groups, detailed bucket by bucket on demand."""

    def __init__(self, sums: np.ndarray, largest: np.ndarray, fetch, keep: int = 32):
        self.ends = np.cumsum(sums)
        self.starts = self.ends - sums
        self.largest = int(largest.max()) if len(largest) else 0
        self.total = int(self.ends[-1]) if len(sums) else 0
        self.fetch, self.keep, self.cache = fetch, keep, {}

    def bucket(self, b: int):
        """(keys, cumulative ends) of bucket ``b``; at most ``keep`` are held."""
        if b not in self.cache:
            if len(self.cache) >= self.keep:
                self.cache.pop(next(iter(self.cache)))
            keys, sizes = self.fetch(b)
            self.cache[b] = (keys, self.starts[b] + np.cumsum(np.asarray(sizes, dtype=np.int64)))
        return self.cache[b]

    def reach(self, target: int) -> tuple[int, str | None]:
        """Largest group end <= target, and the key of the first group after it."""
        b = int(np.searchsorted(self.ends, target, side="right"))
        if b >= len(self.ends):
            return self.total, None
        keys, ends = self.bucket(b)
        i = int(np.searchsorted(ends, target, side="right"))
        return (int(ends[i - 1]) if i else int(self.starts[b])), keys[i]


def _cuts(prefix: _Prefix, capacity: int, n_shards: int) -> list[str] | None:
    """Keys at which shards 1.. begin under a greedy fill, None if it needs more."""
    at, cuts = 0, []
    for _ in range(n_shards):
        at, key = prefix.reach(at + capacity)
        if key is None:
            return cuts
        cuts.append(key)
    return None


def minimax_cuts(prefix: _Prefix, n_shards: int) -> tuple[int, list[str]]:
    """(capacity, cut keys) of the smallest feasible capacity."""
    if prefix.total == 0:
        return 0, []
    low = max(prefix.largest, -(-prefix.total // n_shards))
    high = -(-prefix.total // n_shards) + prefix.largest  # a greedy fill always fits here
    while low < high:
        mid = (low + high) // 2
        if _cuts(prefix, mid, n_shards) is None:
            low = mid + 1
        else:
            high = mid
    return low, _cuts(prefix, low, n_shards)


def shard_documents(docs: DataFrame, n_shards: int = 8, bucket_groups: int = 20_000) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding", docs)
    text = F.col("text")
    rows = scratch.save(
        docs.select(
            F.col("doc_id"),
            text_key(text).alias("key"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        ),
        "rows",
        wide=True,
    )
    summed = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    groups = scratch.save(summed.repartitionByRange(parts, "key").sortWithinPartitions("key"), "groups", wide=True)
    n_buckets = max(1, -(-groups.count() // bucket_groups))
    # A bucket is a range of the key's first 28 bits; the key of null texts stands after all others.
    bucket = F.when(F.col("key") == "null", F.lit(n_buckets - 1)).otherwise(
        F.floor(F.conv(F.substring("key", 1, 7), 16, 10).cast("long") * n_buckets / F.lit(1 << 28))
    )
    grouped = groups.withColumn("bucket", bucket.cast("int"))
    sums, largest = np.zeros(n_buckets, dtype=np.int64), np.zeros(n_buckets, dtype=np.int64)
    for r in grouped.groupBy("bucket").agg(F.sum("bytes").alias("s"), F.max("bytes").alias("m")).toLocalIterator():
        sums[r["bucket"]], largest[r["bucket"]] = r["s"], r["m"]

    def fetch(b: int):
        first = lambda b: f"{-(-(b << 28) // n_buckets):07x}"  # noqa: E731  smallest prefix in bucket b
        inside = F.col("key") >= first(b)
        if b + 1 < n_buckets:
            inside = inside & (F.col("key") < first(b + 1))
        got = groups.where(inside).toPandas().sort_values("key")
        return got["key"].tolist(), got["bytes"].tolist()

    _, cuts = minimax_cuts(_Prefix(sums, largest, fetch), n_shards)
    shard = F.lit(0)
    for key in cuts:
        shard = shard + (F.col("key") >= key).cast("int")
    placed = scratch.save(
        rows.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), F.monotonically_increasing_id().alias("at")),
        "placed",
    )
    # Slots: rows are counted per (scan task, shard); each task's rows then follow those of the tasks before.
    cell = F.shiftright("at", 33)
    counts = placed.groupBy("shard", cell.alias("cell")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "cell").orderBy("at")
    return (
        placed.withColumn("cell", cell)
        .join(base, ["shard", "cell"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.row_number().over(inside) - 1).cast("long").alias("slot"))
    )


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    """Contract query: all documents into shards 0 to 7, law ``bytes``."""
    out = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
