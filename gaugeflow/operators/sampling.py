"""Samples and capped scans that are the same in every run: by hash or by order, never by which task comes first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.operators.splits import ranked_by_hash


def sample_exactly(rows: DataFrame, name: str, n: int, seed: int = 42, keys: Sequence[str] = ()) -> DataFrame:
    """``n`` of the rows (of each key, if there are any), all if there are fewer: those first by md5(seed:name), then name.

    ``name`` tells the rows of a key apart. Ranges of the hash are ranked by tasks of their own.
    """
    ranked = ranked_by_hash(rows.select(*keys, name), seed, name, *keys).where(F.col("rank") <= n)
    return rows.join(ranked.select(*keys, name), [*keys, name], "left_semi")


def first_rows(rows: DataFrame, keys: int, per_key: int, order: str, key: str = "key") -> DataFrame:
    """The first ``per_key`` rows by ``order`` of each of the first ``keys`` keys."""
    some = rows.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key).limit(keys)
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))  # the limit is applied before and after the shuffle
    return rows.join(F.broadcast(some), key, "left_semi").withColumn("_place", place).where(F.col("_place") <= per_key).drop("_place")


def coverage(rows: DataFrame, expected: DataFrame, key: str = "key") -> DataFrame:
    """One row ``n_expected, n_covered, n_unknown``: how many of the expected keys have rows, and how many other keys do."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    both = expected.select(key, F.lit(True).alias("asked")).distinct().join(counts, key, "full")
    return both.agg(F.count_if("asked").alias("n_expected"), F.count_if(F.col("asked") & (F.col("n") > 0)).alias("n_covered"), F.count_if(F.col("asked").isNull()).alias("n_unknown"))


def code_histogram(rows: DataFrame, code: str, codes: int) -> DataFrame:
    """``code, n`` for each code from 0 below ``codes``, those that do not occur with 0, and any others that do."""
    counts = rows.groupBy(F.col(code).cast("long").alias("code")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.range(codes).select(F.col("id").alias("code"))
    return every.join(counts, "code", "full").select("code", F.coalesce("n", F.lit(0)).alias("n"))
