"""Mergeable, exact moments of whole-number columns.

Count, sum and sum of squares are kept as exact integers, so mean and deviation do
not depend on the order in which partitions are merged. That matters because the
reports cut or round both to whole numbers: a deviation of exactly 7 must not come
out as 6.999... and be cut to 6.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def collect_moments(value: str) -> list[Column]:
    """Partial moments `n`, `s`, `q` (count, sum, sum of squares), NULLs ignored."""
    exact = F.col(value).cast("decimal(19,0)")
    return [
        F.count(value).alias("n"),
        F.sum(F.col(value).cast("bigint")).alias("s"),
        F.sum(exact * exact).alias("q"),
    ]


def merge_moments() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("n", "s", "q")]


def mean() -> Column:
    return F.try_divide(F.col("s").cast("double"), F.col("n"))


def stddev_pop() -> Column:
    """sqrt(n*q - s*s) / n; in double arithmetic only if 38 digits do not hold n*q."""
    n = F.col("n").cast("decimal(19,0)")
    s = F.col("s").cast("decimal(19,0)")
    exact = F.try_subtract(F.try_multiply(n, F.col("q")), s * s).cast("double")
    size = F.col("n").cast("double")
    rough = size * F.col("q").cast("double") - F.pow(F.col("s").cast("double"), 2)
    return F.try_divide(F.sqrt(F.coalesce(exact, F.greatest(rough, F.lit(0.0)))), size)
