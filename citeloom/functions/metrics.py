"""Metric formulas as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom import fixed


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def wilson(numerator: Column, denominator: Column, z: float = fixed.WILSON_Z_95) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson score interval; (0, 0) without trials."""
    n = denominator.cast("double")
    p = numerator / n
    z2 = z * z
    scale = 1.0 + F.lit(z2) / n
    centre = (p + F.lit(z2) / (2.0 * n)) / scale
    margin = z * F.sqrt((p * (1.0 - p) + F.lit(z2) / (4.0 * n)) / n) / scale
    low = F.when(denominator > 0, F.greatest(F.lit(0.0), centre - margin)).otherwise(F.lit(0.0))
    high = F.when(denominator > 0, F.least(F.lit(1.0), centre + margin)).otherwise(F.lit(0.0))
    return low, high


def rate(numerator: Column, denominator: Column) -> Column:
    """struct<numerator, denominator, value, ci95_low, ci95_high>."""
    low, high = wilson(numerator, denominator)
    return F.struct(
        numerator.cast("double").alias("numerator"),
        denominator.cast("bigint").alias("denominator"),
        ratio(numerator, denominator).cast("double").alias("value"),
        low.alias("ci95_low"),
        high.alias("ci95_high"),
    )


def mean(total: Column, count: Column) -> Column:
    """A macro mean in the shape of :func:`rate`, without an interval."""
    none = F.lit(None).cast("double")
    return F.struct(
        total.cast("double").alias("numerator"),
        count.cast("bigint").alias("denominator"),
        ratio(total, count).cast("double").alias("value"),
        none.alias("ci95_low"),
        none.alias("ci95_high"),
    )


def gain(relevance: Column) -> Column:
    return F.pow(F.lit(2.0), relevance) - 1.0


def discount(rank: Column) -> Column:
    return F.log2(rank + 1)


def ideal_dcg(relevant: Column, k: int) -> Column:
    """Best possible binary DCG at k for a number of relevant ids."""
    total = F.lit(0.0)
    for rank in range(1, k + 1):
        total = total + F.when(relevant >= rank, 1.0 / F.log2(F.lit(rank + 1.0))).otherwise(F.lit(0.0))
    return total


def long_form(**metrics: Column) -> Column:
    """Named rate structs as an array for explode: struct<metric, rate>."""
    return F.array(*[F.struct(F.lit(n).alias("metric"), m.alias("r")) for n, m in metrics.items()])
