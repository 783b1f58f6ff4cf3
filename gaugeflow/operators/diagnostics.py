"""Diagnoses of forecasts and series: regimes, terciles, concentration of errors, spectra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.operators.metrics import EPS
from gaugeflow.operators.selection import quantiles


def pooled_skill(pred: str, bar: str = "persistence") -> list[Column]:
    """``n, skill, bias`` as aggregates over rows with ``obs``, ``pred`` and ``bar``."""
    error = lambda c: F.sum(F.pow(F.col(c) - F.col("obs"), 2))
    return [F.count("*").alias("n"), F.when(error(bar) > 0, 1 - F.try_divide(error(pred), error(bar))).alias("skill"), F.avg(F.col(pred) - F.col("obs")).alias("bias")]


def by_regime(rows: DataFrame, scale: DataFrame, pred: str, steady: float = 0.25) -> DataFrame:
    """``regime, n, skill, bias``: windows whose mean lies within ``steady`` deviations (``key, std``) of the last value are
    steady, the others rise or fall."""
    mean = rows.groupBy("key", "origin").agg(F.avg("obs").alias("mean"), F.first("persistence").alias("last"))
    moved = (F.col("mean") - F.col("last")) / F.col("std")
    regime = F.when(F.abs(moved) < steady, "steady").when(moved > 0, "rising").otherwise("falling")
    regimes = mean.join(scale, "key").select("key", "origin", regime.alias("regime"))
    return rows.join(regimes, ["key", "origin"]).groupBy("regime").agg(*pooled_skill(pred))


def by_tercile(rows: DataFrame, pred: str) -> DataFrame:
    """``tercile, n, skill, bias``: rows up to each key's first and from its second tercile of observations on."""
    cuts = quantiles(rows, ["key"], "obs", {"lo": 1 / 3, "hi": 2 / 3}).drop("n_rows")
    part = F.when(F.col("obs") <= F.col("lo"), "low").when(F.col("obs") >= F.col("hi"), "high").otherwise("middle")
    return rows.join(cuts, "key").withColumn("tercile", part).groupBy("tercile").agg(*pooled_skill(pred))


def error_concentration(rows: DataFrame, pred: str, shares: tuple[float, ...] = (0.001, 0.01, 0.05), digits: int = 6) -> DataFrame:
    """``share, squared, absolute``: which part of all squared and absolute error the largest errors make up.

    Errors are counted by size to ``digits`` places first, so only distinct sizes are ranked, in ranges of their size.
    """
    size = F.round(F.abs(F.col(pred) - F.col("obs")), digits).alias("e")
    counts = rows.select(size).where("e is not null").groupBy("e").agg(F.count("*").alias("n"))
    counts = counts.withColumn("range", F.floor(64 * F.log2(F.col("e") + 1e-6)))
    ranges = counts.groupBy("range").agg(F.sum("n").alias("n"))
    every = Window.orderBy(F.desc("range"))  # a few thousand ranges at most
    above = F.coalesce(F.sum("n").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("range", above.alias("above"), F.sum("n").over(Window.partitionBy()).alias("all"))
    own = Window.partitionBy("range").orderBy(F.desc("e")).rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.join(ranges, "range").withColumn("before", F.col("above") + F.coalesce(F.sum("n").over(own), F.lit(0)))
    each = placed.withColumn("share", F.explode(F.array(*(F.lit(s) for s in shares))))
    taken = F.least(F.col("n"), F.greatest(F.lit(0), F.greatest(F.lit(1), F.bround(F.col("share") * F.col("all"))) - F.col("before")))
    part = lambda c: F.sum(taken * c) / F.sum(F.col("n") * c)
    return each.groupBy("share").agg(part(F.pow("e", F.lit(2))).alias("squared"), part(F.col("e")).alias("absolute"))


def rank_agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``n, rho``: Spearman's correlation, equal values sharing their mean rank. For one row a run."""
    both = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    mean_rank = lambda c: F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2
    return both.select(mean_rank(a).alias("ra"), mean_rank(b).alias("rb")).agg(F.count("*").alias("n"), guarded_correlation("ra", "rb").alias("rho"))


def guarded_correlation(a: str, b: str) -> Column:
    """Pearson's correlation, 0 where either side does not vary."""
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(spread > EPS, F.try_divide(F.covar_pop(a, b), spread)).otherwise(0.0)


def zero_crossings(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``key, n, crossings, mean_period``: sign changes of each series, zero counting as positive; the period is 2 n / crossings."""
    up = F.col(value) >= 0
    changed = (up != F.lag(up).over(Window.partitionBy(key).orderBy(order))).alias("changed")
    counts = rows.select(key, changed).groupBy(key).agg(F.count("*").alias("n"), F.count_if("changed").alias("crossings"))
    return counts.select(key, "n", "crossings", F.when(F.col("crossings") > 0, 2 * F.col("n") / F.col("crossings")).otherwise(float("inf")).alias("mean_period"))


def local_extrema(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``key, maxima, minima``: values larger, or smaller, than both neighbours."""
    own = Window.partitionBy(key).orderBy(order)
    v, before, after = F.col(value), F.lag(value).over(own), F.lead(value).over(own)
    marked = rows.select(key, ((v > before) & (v > after)).alias("top"), ((v < before) & (v < after)).alias("low"))
    return marked.groupBy(key).agg(F.count_if("top").alias("maxima"), F.count_if("low").alias("minima"))


def swing_ratio(rows: DataFrame, value: str, driver: str, low: float, high: float, least: int = 10) -> Column:
    """As an aggregate: the deviation of ``value`` where ``driver`` is above ``high`` over that where it is below ``low``;
    null with fewer than ``least`` values on a side."""
    storm, quiet = F.col(driver) > high, F.col(driver) < low
    enough = (F.count_if(storm) >= least) & (F.count_if(quiet) >= least)
    return F.when(enough, F.try_divide(F.stddev_pop(F.when(storm, F.col(value))), F.stddev_pop(F.when(quiet, F.col(value)))))


def curve_diagnostics(values: Column) -> list[Column]:
    """Of an array: ``peak`` (largest mean of three), ``late`` (mean of the last five), ``slope`` of the last ten,
    ``jitter`` (sample deviation of the differences in the second half)."""
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    tail = F.slice(values, F.greatest(F.size(values) - 9, F.lit(1)), 10)
    n = F.size(tail)
    weighted = F.aggregate(F.transform(tail, lambda v, i: v * (i - (n - 1) / 2)), F.lit(0.0), lambda s, v: s + v)
    half = F.slice(values, F.floor(F.size(values) / 2).cast("int") + 1, F.size(values))
    steps = F.zip_with(F.slice(half, F.lit(2), F.size(half)), F.slice(half, F.lit(1), F.size(half) - 1), lambda b, a: b - a)
    spread = F.aggregate(steps, F.lit(0.0), lambda s, v: s + F.pow(v - mean(steps), 2))
    return [
        mean(F.slice(values, F.greatest(F.size(values) - 4, F.lit(1)), 5)).alias("late"),
        F.when(n > 1, weighted / (n * (n * n - 1) / 12)).alias("slope"),
        F.when(F.size(steps) > 1, F.sqrt(spread / (F.size(steps) - 1))).alias("jitter"),
    ]


def bootstrap_medians(values: DataFrame, key: str, a: str, b: str, resamples: int = 4000, seed: int = 42) -> DataFrame:
    """One row ``n, low, middle, high, share``: the difference of the medians of ``a`` and ``b`` over resamples of the keys with
    replacement: its 2.5 %, 50 % and 97.5 % quantiles, and how often it is positive.

    ``values`` has one row a key; rows with a null in ``a`` or ``b`` do not count, and without rows ``n`` is 0 and the
    rest null. Draw i of a resample takes the key at place md5(seed:resample:i) modulo the number of keys.
    """
    known = values.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    place = F.row_number().over(Window.orderBy(key)) - 1  # one row a key
    placed = known.select(F.col(a).alias("a"), F.col(b).alias("b"), place.cast("long").alias("place"))
    n = placed.count()
    ids = values.sparkSession.range(resamples * n)
    draw = F.concat_ws(":", F.lit(seed), F.expr(f"id div {max(n, 1)}"), F.expr(f"id % {max(n, 1)}"))
    pick = F.conv(F.substring(F.md5(draw.cast("binary")), 1, 8), 16, 10).cast("long") % max(n, 1)
    drawn = ids.select(F.expr(f"id div {max(n, 1)}").alias("resample"), pick.alias("place")).join(placed, "place")
    each = drawn.groupBy("resample").agg(F.round(F.median("a") - F.median("b"), 9).alias("d"))
    quantile = lambda q: F.percentile("d", F.lit(q))
    share = F.avg((F.col("d") > 0).cast("int"))
    return each.agg(F.count("*").alias("n"), quantile(0.025).alias("low"), quantile(0.5).alias("middle"), quantile(0.975).alias("high"), share.alias("share"))
