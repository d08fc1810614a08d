"""Running sums and minima over a whole table without putting it into one task.

Keys are cut into ranges by Spark's range partitioner, and the table is written with
the number of each row's range, so that the cut is the same for every later step.
Totals per range are a small table (one row for ``RANGE_ROWS`` keys) whose running
values are broadcast back; inside a range an ordinary window does the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

#: Keys of one range.
RANGE_ROWS = 100_000


def running(levels: DataFrame, key: str, value: str, out: str, fn: str = "sum", descending: bool = False, ranges: int | None = None) -> DataFrame:
    """``levels`` (one row a key) with ``out``: sum or min of ``value`` over all keys up to the row's.

    The number of ranges follows the number of keys.
    """
    agg = {"sum": F.sum, "min": F.min}[fn]
    order = F.desc(key) if descending else F.asc(key)
    if ranges is None:
        ranges = max(1, -(-levels.count() // RANGE_ROWS))
    if ranges == 1:  # at most RANGE_ROWS keys
        whole = Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return levels.withColumn(out, agg(value).over(whole))
    cut = written(levels.repartitionByRange(ranges, order).withColumn("__range", F.spark_partition_id()))
    totals = cut.groupBy("__range").agg(agg(value).alias("__t"))  # at most ``ranges`` rows
    before = totals.select("__range", agg("__t").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    inside = agg(value).over(Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    rows = cut.withColumn("__in", inside).join(F.broadcast(before), "__range")
    total = F.col("__in") + F.coalesce("__before", F.lit(0)) if fn == "sum" else F.least("__in", "__before")
    return rows.withColumn(out, total).drop("__range", "__in", "__before")
