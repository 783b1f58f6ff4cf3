"""Losses and paired comparisons per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.functions.series import huber
from gaugeflow.operators.metrics import EPS, nse_by


def losses(rows: DataFrame, pred: str, delta: float = 0.5) -> DataFrame:
    """``key, mse, mae, huber``."""
    e = F.col(pred) - F.col("obs")
    return rows.groupBy("key").agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.avg(huber(e, delta)).alias("huber"))


def quick_nse(rows: DataFrame, pred: str) -> DataFrame:
    """``key, nse`` from sums of one pass; groups of one value, or without variation, have no row."""
    o, e = F.col("obs"), F.col(pred) - F.col("obs")
    sums = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum(e * e).alias("res"), F.sum(o).alias("s"), F.sum(o * o).alias("ss"))
    total = F.col("ss") - F.col("s") * F.col("s") / F.col("n")
    return sums.where((F.col("n") > 1) & (total > EPS)).select("key", (1 - F.col("res") / total).alias("nse"))


def subset_nse(rows: DataFrame, flags: DataFrame, pred: str) -> DataFrame:
    """``seen, key, nse``: the scores of windows that training has seen and of the others.

    ``flags`` has ``key, origin, leaked``; a window without a flag counts as seen.
    """
    flagged = rows.join(flags.select("key", "origin", "leaked"), ["key", "origin"], "left").withColumn("seen", F.coalesce("leaked", F.lit(True)))
    return nse_by(flagged, pred, "seen", "key")


def subset_medians(rows: DataFrame, flags: DataFrame, pred: str) -> DataFrame:
    """``subset, n_keys, median_nse`` for clean, overlapping and target-seen windows.

    ``flags`` has ``key, origin, input_seen, target_seen``; a window without flags counts as seen. Groups without
    variation are dropped before the median; a subset without groups has a null median.
    """
    seen = [F.coalesce(c, F.lit(True)).alias(c) for c in ("input_seen", "target_seen")]
    flagged = rows.join(flags.select("key", "origin", "input_seen", "target_seen"), ["key", "origin"], "left").select("key", "obs", pred, *seen)
    overlap = F.col("input_seen") | F.col("target_seen")
    subsets = F.array(F.when(overlap, "overlap").otherwise("clean"), F.when(F.col("target_seen"), "target_seen"))
    each = flagged.select("key", "obs", pred, F.explode(F.array_compact(subsets)).alias("subset"))
    found = nse_by(each, pred, "subset", "key").groupBy("subset").agg(F.count("*").alias("n_keys"), F.median("nse").alias("median_nse"))
    every = flags.sparkSession.createDataFrame([("clean",), ("overlap",), ("target_seen",)], "subset string")
    return every.join(found, "subset", "left").select("subset", F.coalesce("n_keys", F.lit(0)).alias("n_keys"), "median_nse")


def signed_rank(pairs: DataFrame, difference: str = "d") -> DataFrame:
    """``key, n, w_plus, z``: the Wilcoxon signed-rank statistic of each group, by the normal approximation with
    the correction for ties. Zero and null differences do not count; z is null without variance."""
    d = pairs.where(F.col(difference) != 0).select("key", F.col(difference).alias("d"), F.abs(difference).alias("a"))
    # equal sizes share the mean of their ranks, so ranks follow from counts of sizes
    counts = d.groupBy("key", "a").agg(F.count("*").alias("t"), F.count_if(F.col("d") > 0).alias("up"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy("key").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.withColumn("rank", before + (F.col("t") + 1) / 2)
    sums = ranked.groupBy("key").agg(F.sum("t").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("w_plus"), F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    n = F.col("n")
    variance = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    return sums.select("key", "n", "w_plus", F.when(variance > 0, (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(variance)).alias("z"))


def normal_tail(z):
    """The upper tail of the normal law, by the rational approximation 26.2.17 of Abramowitz and Stegun (error below 1e-7)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-a * a / 2) / 2.5066282746310002 * series
    return F.when(z >= 0, upper).otherwise(1 - upper)


def significance(pairs: DataFrame, difference: str = "d", least: int = 6) -> DataFrame:
    """``key, n, w_plus, p_value, test``: is the difference greater than zero? The signed-rank statistic with its normal
    approximation from ``least`` pairs on, else the sign test. A group of zeros only has p 1."""
    ranks = signed_rank(pairs, difference).select("key", "n", "w_plus", "z")
    d = F.col(difference)
    signs = pairs.groupBy("key").agg(F.count_if(d > 0).alias("up"), F.count_if(d != 0).alias("m"))
    # the chance of ``up`` or more of m fair signs, summed over binomial coefficients built step by step
    steps = F.sequence(F.lit(0), F.col("m").cast("int"))
    start = F.struct(F.lit(1.0).alias("c"), F.lit(0.0).alias("tail"))
    add = lambda a, k: F.struct((a["c"] * (F.col("m") - k) / (k + 1)).alias("c"), (a["tail"] + F.when(k >= F.col("up"), a["c"]).otherwise(0.0)).alias("tail"))
    sign = F.aggregate(steps, start, add, lambda a: a["tail"]) / F.pow(F.lit(2.0), F.col("m"))
    joined = signs.join(ranks, "key", "left")
    by_rank = (F.col("m") >= least) & F.col("z").isNotNull()
    p = F.when(F.col("m") == 0, 1.0).when(by_rank, normal_tail(F.col("z"))).otherwise(F.when(F.col("m") < 200, sign))
    return joined.select("key", F.col("m").alias("n"), F.coalesce("w_plus", F.lit(0.0)).alias("w_plus"), p.alias("p_value"), F.when(by_rank, "rank").otherwise("sign").alias("test"))
