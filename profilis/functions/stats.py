"""Numeric expressions over groups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Distinct values (with their counts) that may come to the driver: about 2 MB.
AT_ONCE = 100_000
#: Steps that approximate percentiles are off by at most: one in this many.
ACCURACY = 10_000


def guarded(n: Column, d: Column, otherwise: float | None = None) -> Column:
    """n / d where d is above 0."""
    return F.when(d > 0, n / d).otherwise(F.lit(otherwise).cast("double"))


def r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


def shares(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """Adds ``share``: n over its total within keys."""
    return counts.withColumn("share", F.col(n) / F.sum(n).over(W.partitionBy(*keys)))


def entropy(counts: DataFrame, keys: list[str], out: str, n: str = "n") -> DataFrame:
    """Shannon entropy in bits per key, from one row per value."""
    # H = log2(N) - sum(n log2 n) / N needs only one aggregation
    return counts.groupBy(*keys).agg((F.log2(F.sum(n)) - F.sum(F.col(n) * F.log2(F.col(n).cast("double"))) / F.sum(n)).alias(out))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key by a total order."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def summed_in_order(rows: DataFrame, keys: list[str], order: str, value: Column, out: str) -> DataFrame:
    """Adds ``out``: the sum of each key's values so far, added one by one by a total order.

    The last one over the number of rows is a mean that doesn't hang on how rows are dealt out, which
    decides the last bit of ``avg`` and so to which side a mean between two printed numbers goes.
    """
    return rows.withColumn(out, F.sum(value).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def quantiles(rows: DataFrame, column: str, qs: list[float]) -> list[float | None]:
    """Exact quantiles of a whole column, linear between neighbours; null without values.

    Up to AT_ONCE distinct values are counted and looked at together. With more, approximate
    percentiles bracket each wanted rank, values below the bracket are counted, and the
    bracket is narrowed until few values are left, so that no task holds all of them.
    """
    v = rows.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    few = _counted(v)
    if few is not None:
        n = sum(c for _, c in few)
        return [None if not n else _between(q, n, lambda k: _at(few, k)) for q in qs]
    n = v.count()
    return [_between(q, n, lambda k: _by_brackets(v, k, n)) for q in qs]


def _between(q: float, n: int, at) -> float:
    place = q * (n - 1)
    low = math.floor(place)
    a = at(low)
    return a if place == low else a + (at(low + 1) - a) * (place - low)


def _counted(v: DataFrame) -> list[tuple[float, int]] | None:
    """Distinct values and their counts in order, if there aren't too many."""
    found = v.groupBy("v").agg(F.count("*").alias("c")).limit(AT_ONCE + 1).collect()
    return sorted((r["v"], r["c"]) for r in found) if len(found) <= AT_ONCE else None


def _at(counts: list[tuple[float, int]], k: int) -> float:
    for value, c in counts:
        if k < c:
            return value
        k -= c
    raise IndexError(k)


def _by_brackets(v: DataFrame, k: int, n: int) -> float:
    """The k-th value (from 0) of n."""
    width = 2 / ACCURACY
    while True:
        ends = [max(0.0, k / n - width), min(1.0, k / n + width)]
        low, high = v.agg(F.percentile_approx("v", ends, ACCURACY)).first()[0]
        below, upto = v.agg(F.count_if(F.col("v") < low), F.count_if(F.col("v") <= high)).first()
        if low == high and below <= k < upto:
            return low
        inside = v.where(F.col("v").between(low, high))
        if below <= k < upto and upto - below < n:
            few = _counted(inside)
            return _at(few, k - below) if few is not None else _by_brackets(inside, k - below, upto - below)
        width *= 4  # the bracket missed the rank, or is as wide as before
        if width > 2:
            raise ArithmeticError("approximate percentiles don't narrow the values down")
