"""Latency percentiles and counts per interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.position import running_total

# The percentiles that latency reports list.
PERCENTILES = [70.0, 75.0, 80.0, 85.0, 90.0, 95.0, 99.0, 99.9, 99.99, 99.9999, 100.0]


def percentiles(df: DataFrame, value: str, keys: list[str] | None = None, at: list[float] | None = None) -> DataFrame:
    """keys, p, value: nearest rank, the value at place ceil(p / 100 * n) of n sorted values. Nulls are not values.

    Equal values are counted first and the counts summed in pieces of the value's range, so neither a hot key nor many
    values gather in one task; then each rank is the value whose counts reach over it.
    """
    keys, at = keys or [], at or PERCENTILES
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    known = running_total(counts, value, keys, F.col("_n"), "_before")
    if keys:
        totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_all")).select(*[F.col(k).alias(f"_t_{k}") for k in keys], "_all")
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_t_{k}"))
        known = known.join(totals, same)
    else:
        known = known.withColumn("_all", F.lit(counts.agg(F.sum("_n")).first()[0] or 0))
    ranks = F.filter(F.array(*[F.struct(F.lit(p).alias("p"), F.greatest(F.ceil(F.lit(p) / 100 * F.col("_all")), F.lit(1)).alias("r")) for p in at]), lambda x: (x["r"] > F.col("_before")) & (x["r"] <= F.col("_before") + F.col("_n")))
    return known.withColumn("_hit", F.explode(ranks)).select(*keys, F.col("_hit.p").alias("p"), value)


def percentiles_of_arrays(df: DataFrame, values: str, keys: list[str] | None = None, at: list[float] | None = None) -> DataFrame:
    """percentiles of all elements of the array column `values`, flattened over the rows; null and empty arrays have none."""
    keys = keys or []
    return percentiles(df.select(*keys, F.explode(values).alias("value")), "value", keys, at)


def per_interval(df: DataFrame, at: Column, unit: str, keys: list[str] | None = None) -> DataFrame:
    """keys, interval, n and delta to the interval before (null for the first)."""
    keys = keys or []
    counts = df.groupBy(*keys, F.date_trunc(unit, at).alias("interval")).agg(F.count("*").alias("n"))
    return counts.withColumn("delta", F.col("n") - F.lag("n").over(Window.partitionBy(*keys).orderBy("interval")))
