"""Ranks and running sums within keys of any size: ranges of the order are taken by tasks, prefix counts join them up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.session import Scratch


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``rank`` (from 1) within ``keys`` in ascending ``order`` and ``upto_s``, the sum of each of ``sums`` up to
    and including the row. Null keys are one key; ``order`` should leave no ties.

    Rows are dealt by ranges of (keys, order) and written with their range, so a lost executor can't deal them anew. Each
    task then ranks its own; counts and sums of a key's ranges before it (one row a range) are added.
    """
    keys, order, sums = list(keys), list(order), list(sums)
    scratch = Scratch(rows.sparkSession, "running")
    dealt = scratch.table(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    each = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_n"), *(F.sum(s).alias(f"_{s}") for s in sums))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("_n", *(f"_{s}" for s in sums))]
    offsets = each.select(*(F.col(k).alias(f"_key_{k}") for k in keys), F.col("_range").alias("_of"), *starts)
    own = Window.partitionBy(*keys, "_range").orderBy(*order)
    upto = [F.sum(s).over(own.rowsBetween(Window.unboundedPreceding, 0)).alias(f"_own_{s}") for s in sums]
    placed = dealt.select("*", F.row_number().over(own).alias("_own"), *upto)
    same = [F.col("_range") == F.col("_of"), *(F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys)]
    found = [(F.col("_own") + F.col("_n_before")).alias("rank"), *((F.col(f"_own_{s}") + F.col(f"_{s}_before")).alias(f"upto_{s}") for s in sums)]
    return placed.join(offsets, same).select(*rows.columns, *found)


def dense_labels(groups: DataFrame, keys: Sequence[str], group: str, order: str) -> DataFrame:
    """``keys, group, label``: the groups of each key numbered from 0 in the order in which they first appear by ``order``.

    ``groups`` has a row for each member; members of different groups should not have equal places in the order.
    """
    first = groups.groupBy(*keys, group).agg(F.min(order).alias("_first"))
    return running(first, keys, ["_first", group]).select(*keys, group, (F.col("rank") - 1).alias("label"))
