"""Shared helpers: scratch tables in the shared folder, row keys, array kernels."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word pattern of the shingle operators: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: str) -> str:
    """A-Z to lower case, nothing else (what ``lower`` does on bytes)."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where the session names none, a temporary folder is made and set as the
    checkpoint folder on one machine (tests); on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master or ""):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: Bytes of the input for each partition of a table derived from it.
PART_BYTES = 64 << 20


def width(spark: SparkSession, source: DataFrame | None, cores: int = 1) -> int:
    """Partitions for tables derived from ``source``: one for each ``PART_BYTES`` of its
    files, and ``cores`` a core at least, however many cores there are just now."""
    least = cores * spark.sparkContext.defaultParallelism
    if source is None:
        return least
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, -(-size // PART_BYTES)) if size < 1 << 58 else least  # Spark's mark for "not known" is above


class Scratch:
    """Written tables under one fresh sub-folder of the shared folder.

    ``save`` cuts lineage: the table is written as Parquet and read back, so a
    lost executor costs at most the tasks of the step that is running.
    """

    def __init__(self, spark: SparkSession, label: str, source: DataFrame | None = None):
        self.spark = spark
        self.width = width(spark, source)
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def save(self, df: DataFrame, name: str, wide: bool = False) -> DataFrame:
        """Write and reread.  Tables derived from the source (not ``wide``) come in at most
        ``width`` files, sized by the bytes of the source, however many partitions their
        last shuffle had; row groups are small, so that a writer buffers little."""
        self._n += 1
        if not wide:
            df = df.coalesce(self.width)
        path = f"{self.root}/{self._n:03d}-{name}"
        df.write.mode("overwrite").option("parquet.block.size", 16 << 20).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that no later step reads."""
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, rows: int):
    """Smaller Arrow batches for the eager steps inside: wide rows, bounded memory per worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def text_key(text: Column) -> Column:
    """128-bit content key (32 hex digits) of a text; null keeps its own key."""
    return F.when(text.isNull(), F.lit("null")).otherwise(F.md5(text.cast("binary")))


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser of the public SplitMix64 generator, on uint64 arrays."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(30))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(27))
        h = h * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def word_hashes(words: list[str], cache: dict[str, int], limit: int = 150_000) -> np.ndarray:
    """uint64 hash of every word; ``cache`` is emptied when it grows past ``limit``."""
    if len(cache) > limit:
        cache.clear()
    for w in set(words).difference(cache):
        cache[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
    return np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-sensitive hash of two neighbouring runs from their hashes."""
    with np.errstate(over="ignore"):
        c = a * np.uint64(0x9E3779B97F4A7C15)
        c += b
        c ^= c >> np.uint64(29)
        c *= np.uint64(0xBF58476D1CE4E5B9)
        c ^= c >> np.uint64(32)
    return c


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Order-sensitive 64-bit hash of every run of ``n`` consecutive hashes.

    Runs of 1, 2, 4, ... are joined as the binary digits of ``n`` ask for.
    """
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    power, size, out, done = h, 1, None, 0
    while True:
        if n & size:
            part = power[done : done + m]
            out = part if out is None else _joined(out, part)
            done += size
        if size * 2 > n:
            break
        power = _joined(power[:-size], power[size:])
        size *= 2
    return mix64(out)
