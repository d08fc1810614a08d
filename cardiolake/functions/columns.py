"""Column expressions shared by the operators (JVM-side, no UDFs)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

INF = float("inf")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: Column | str) -> Column:
    """True for numbers that are neither null, NaN nor infinite; never null."""
    c = col(c)
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(INF)), F.lit(False))


def finite_or_null(c: Column | str) -> Column:
    return F.when(is_finite(c), col(c))


def to_samples(seconds: Column, fs: Column | float) -> Column:
    """Seconds to a sample count, halves to even."""
    return F.bround(seconds * fs).cast("long")


def heart_rate(rr_prev: Column | str, rr_next: Column | str) -> Column:
    """60 / previous interval if it is positive, else 60 / next interval."""
    prev, nxt = col(rr_prev), col(rr_next)
    return F.try_divide(F.lit(60.0), F.coalesce(F.when(prev > 0, prev), F.when(nxt > 0, nxt)))


def safe_ratio(a: Column, b: Column, floor: float = 1e-6) -> Column:
    return a / F.greatest(b, F.lit(floor))


def entropy(probabilities: Column | str) -> Column:
    """-sum p ln clip(p, 1e-9, 1) of an array of probabilities."""
    terms = F.transform(col(probabilities), lambda p: p * F.log(F.least(F.greatest(p, F.lit(1e-9)), F.lit(1.0))))
    return -F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def argmax(values: Column | str) -> Column:
    """Zero-based position of the first largest element."""
    return (F.array_position(col(values), F.array_max(col(values))) - 1).cast("int")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row.

    Projections are collapsed by the optimizer, so a column used inside a lambda
    would be computed again for every element; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def softmax(values: Column | str) -> Column:
    v = F.transform(col(values), lambda x: x.cast("double"))
    powers = let(v, lambda a: let(F.array_max(a), lambda m: F.transform(a, lambda x: F.exp(x - m))))
    return let(powers, lambda e: let(total(e), lambda t: F.transform(e, lambda x: x / t)))


def median_of(values: Column) -> Column:
    """Median of an array of numbers."""

    def middle(a: Column) -> Column:
        half = F.floor(F.size(a) / 2).cast("int")
        return F.when(F.size(a) % 2 == 1, F.get(a, half)).otherwise((F.get(a, half - 1) + F.get(a, half)) / 2)

    return let(F.array_sort(values), middle)


def deviation_of(values: Column) -> Column:
    """Population standard deviation of an array of numbers."""
    mean = lambda a: total(a) / F.size(a)
    return let(values, lambda a: let(mean(a), lambda m: F.sqrt(mean(F.transform(a, lambda x: (x - m) * (x - m))))))


def z_scores(values: Column | str) -> Column:
    """Array less its median, over its standard deviation (1 where that is nil)."""
    return let(col(values), lambda a: let(median_of(a), lambda m: let(deviation_of(a), lambda s: F.transform(a, lambda x: (x - m) / F.when(s == 0, F.lit(1.0)).otherwise(s)))))


def robust_scale_of(values: Column | str) -> Column:
    """1.4826 times the median deviation from the median of an array, its standard deviation
    where that is nil, at least 1e-8."""
    mad = lambda a: let(median_of(a), lambda m: 1.4826 * median_of(F.transform(a, lambda x: F.abs(x - m))))
    return let(col(values), lambda a: let(mad(a), lambda d: F.greatest(F.when(d > 1e-8, d).otherwise(deviation_of(a)), F.lit(1e-8))))


def nonblank(c: Column | str) -> Column:
    return F.coalesce(F.length(F.trim(col(c))) > 0, F.lit(False))


def file_id(content: Column | str) -> Column:
    """First 16 hex digits of the SHA-256 of the content."""
    return F.substring(F.sha2(col(content).cast("binary"), 256), 1, 16)


def average_rank(value: Column | str, *partition: Column | str) -> Column:
    """Rank with ties averaged (what rank-sum statistics need)."""
    ordered = Window.partitionBy(*partition).orderBy(col(value)) if partition else Window.orderBy(col(value))
    peers = Window.partitionBy(*partition, col(value))
    return F.rank().over(ordered) + (F.count(F.lit(1)).over(peers) - 1) / 2.0


def ordered_window(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)
