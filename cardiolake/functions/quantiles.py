"""Exact quantiles of groups of any size: the rank is found by refining histograms.

Doubles are mapped to whole numbers of the same order.  Four rounds fix 16 of their 64
bits each: a round counts, in the tasks, the next 16 bits of the values that share the
bits found so far, and Spark adds the counts.  A group sends at most 65,536 counters a
task and round, and only its ranks and bits go on; ``percentile`` holds all distinct
values of a group in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .tables import written


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """int64 in the order of the doubles; both zeros are one."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def from_bits(bits: np.ndarray) -> np.ndarray:
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits).view(np.float64)


def exact_quantiles(rows: DataFrame, keys: Sequence[str], values: str, fractions: Sequence[float] = (0.5,)) -> DataFrame:
    """keys, ``n`` and ``quantiles`` (linear between neighbours) over the arrays of doubles
    ``values`` of all rows of a key.

    Nulls and values that are not finite are left out; a key without values has no row.
    """
    if any(not 0 <= f <= 1 for f in fractions):
        raise ValueError("fractions lie between 0 and 1")
    data = rows.select(*keys, F.filter(F.col(values).cast("array<double>"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).alias("__v")).where(F.size("__v") > 0)
    sizes = data.groupBy(*keys).agg(F.sum(F.size("__v").cast("long")).alias("n"))
    place = lambda f: F.lit(float(f)) * (F.col("n") - 1)
    ranks = F.array_distinct(F.array(*[x.cast("long") for f in fractions for x in (F.floor(place(f)), F.ceil(place(f)))]))
    state = sizes.select(*keys, F.explode(ranks).alias("rank")).withColumns({"left": F.col("rank"), "bits": F.lit(0).cast("long")})
    for turn in range(4):
        found = _counted(data, state, keys, turn)
        upto = F.sum("count").over(Window.partitionBy(*keys, "bits").orderBy("bucket"))
        steps = found.withColumn("upto", upto)
        asked = state.alias("s").join(steps.alias("c"), [*keys, "bits"]).where((F.col("left") < F.col("upto")) & (F.col("left") >= F.col("upto") - F.col("count")))
        state = written(asked.select(*keys, "rank", (F.col("left") - F.col("upto") + F.col("count")).alias("left"), F.col("bucket").alias("bits")))
    value = F.pandas_udf(lambda b: pd.Series(from_bits(b.to_numpy())), "double")
    known = state.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", value("bits")))).alias("__at"))
    at = lambda x: F.element_at("__at", x.cast("long"))

    def one(f: float):
        low, high, part = at(F.floor(place(f))), at(F.ceil(place(f))), place(f) - F.floor(place(f))
        return F.when(part == 0.5, (low + high) / 2).otherwise(low + part * (high - low))

    return sizes.join(known, list(keys)).select(*keys, "n", F.array(*[one(f) for f in fractions]).alias("quantiles"))


def _counted(data: DataFrame, state: DataFrame, keys: Sequence[str], turn: int) -> DataFrame:
    """keys, bits so far, next bits and their count, over the values that share the bits so far."""
    shift = 48 - 16 * turn
    asked = data.join(state.groupBy(*keys).agg(F.collect_set("bits").alias("__asked")), list(keys))
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.select(*keys).schema)
    schema = f"{key_schema}, bits long, bucket long, count long"
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[tuple, dict[tuple[int, int], int]] = {}
            names = [batch.column(k).to_pylist() for k in keys]
            for i, (v, prefixes) in enumerate(zip(batch.column("__v"), batch.column("__asked").to_pylist())):
                bits = ordered_bits(v.values.to_numpy(zero_copy_only=False))
                own = held.setdefault(tuple(x[i] for x in names), {})
                above = bits >> (shift + 16) if turn else np.zeros(len(bits), dtype=np.int64)
                for p in prefixes:
                    for b, c in zip(*(a.tolist() for a in np.unique(bits[above == p] >> shift, return_counts=True))):
                        own[p, b] = own.get((p, b), 0) + c
            out = [(*k, p, b, c) for k, counts in held.items() for (p, b), c in counts.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], f.type) for j, f in enumerate(target)], schema=target)

    return asked.mapInArrow(run, schema).groupBy(*keys, "bits", "bucket").agg(F.sum("count").alias("count"))
