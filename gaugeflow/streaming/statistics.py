"""Sufficient statistics of values per group, the same for tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_statistics(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``key, n, mean, std`` so far, from mergeable sums; for streams use the update or complete mode.

    Null values do not count; a deviation below 1e-6 is given as 1, as the normalizers do.
    """
    v = F.col(value).cast("double")
    sums = rows.where(v.isNotNull()).groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("ss"))
    mean = F.col("s") / F.col("n")
    std = F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0)))
    return sums.select("key", "n", mean.alias("mean"), F.when(std < 1e-6, 1.0).otherwise(std).alias("std"))
