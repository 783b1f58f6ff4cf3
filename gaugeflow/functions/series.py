"""Folds and measures over arrays of values in time order, as array expressions.

A null or empty array gives null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def peak_of_means(values: Column, width: int = 3) -> Column:
    """The largest mean of ``width`` consecutive values; null where there are fewer."""
    starts = F.sequence(F.lit(1), F.size(values) - width + 1)
    means = F.transform(starts, lambda i: F.aggregate(F.slice(values, i, width), F.lit(0.0), lambda a, v: a + v) / width)
    return F.when(F.size(values) >= width, F.array_max(means))


def moving_mean(values: Column, decay: float = 0.999) -> Column:
    """The exponential mean, from the first value; at step t its decay is min(decay, (1 + t) / (10 + t))."""
    start = F.struct(F.lit(0).alias("t"), F.get(values, F.lit(0)).alias("e"))

    def step(a: Column, v: Column) -> Column:
        d = F.least(F.lit(decay), (2 + a["t"]) / (11 + a["t"]))
        return F.struct((a["t"] + 1).alias("t"), (d * a["e"] + (1 - d) * v).alias("e"))

    return F.when(F.size(values) > 0, F.aggregate(F.slice(values, F.lit(2), F.size(values)), start, step, lambda a: a["e"]))


def early_stop(values: Column, patience: int, min_delta: float = 1e-4) -> Column:
    """``best, best_epoch, epoch, stopped``: a value counts as better if it exceeds the best by ``min_delta``;
    ``patience`` values in a row without that end the run, and later ones are not read. Epochs count from 0."""
    start = F.struct(F.lit(float("-inf")).alias("best"), F.lit(-1).alias("best_epoch"), F.lit(-1).alias("epoch"), F.lit(False).alias("stopped"))

    def step(a: Column, v: Column) -> Column:
        epoch, better = a["epoch"] + 1, F.coalesce(v > a["best"] + min_delta, F.lit(False))
        best_epoch = F.when(better, epoch).otherwise(a["best_epoch"])
        moved = F.struct(F.when(better, v).otherwise(a["best"]).alias("best"), best_epoch.alias("best_epoch"), epoch.alias("epoch"), (epoch - F.greatest(best_epoch, F.lit(-1)) >= patience).alias("stopped"))
        return F.when(a["stopped"], a).otherwise(moved)

    return F.when(F.size(values) > 0, F.aggregate(values, start, step))


def spark_levels(values: Column, levels: int = 8) -> Column:
    """Each value's level from 0 to ``levels`` between the least and the largest."""
    low, high = F.array_min(values), F.array_max(values)
    return F.transform(values, lambda v: F.least(F.lit(levels), F.floor((v - low) / (high - low + 1e-9) * levels)).cast("int"))


def huber(error: Column, delta: float) -> Column:
    size = F.abs(error)
    return F.when(size <= delta, error * error / 2).otherwise(delta * (size - delta / 2))


def route_by_entropy(entropies: Column, n_high: int) -> Column:
    """The indices, in order, of the ``n_high`` components of largest entropy; of equals the first."""
    order = F.sort_array(F.transform(entropies, lambda e, i: F.struct((-e).alias("e"), i.alias("i"))))
    return F.sort_array(F.transform(F.slice(order, 1, n_high), lambda s: s["i"]))


def threshold_disagrees(entropies: Column, original: Column, n_high: int) -> Column:
    """Would sending every component to the fast branch whose entropy reaches the original's give another number than ``n_high``?

    Branches are fixed, so the threshold rule falls back to ``route_by_entropy`` then; where the numbers agree, both name the
    same components. Null entropies do not reach it.
    """
    return F.size(F.filter(entropies, lambda e: e >= original)) != n_high


def branch_inputs(channels: Column, bands: Column, picks: Column, target: int = 0, replace: bool = True) -> Column:
    """For each of ``picks`` (indices of ``bands``) one branch's input: all ``channels`` with the band in place of the
    channel ``target``, or with ``replace=False`` the band alone. A pick that names no band gives a null channel."""

    def branch(p: Column) -> Column:
        band = F.get(bands, p)
        return F.transform(channels, lambda c, i: F.when(i == target, band).otherwise(c)) if replace else F.array(band)

    return F.transform(picks, branch)


def warmup_cosine(step: Column, total: int, warmup: float = 0.05, least: float = 0.01) -> Column:
    """The factor of the learning rate: evenly up from 0 in the first part ``warmup`` of the steps, then half a cosine down to ``least``."""
    ramp = max(1, int(total * warmup))
    done = (step - ramp) / max(1, total - ramp)
    return F.when(step < ramp, step / ramp).otherwise(least + (1 - least) * 0.5 * (1 + F.cos(F.lit(math.pi) * done)))


def sample_entropy(values: Column, tolerance: float = 0.2, flat: float = 1e-8, most: float = 3.0) -> Column:
    """-ln(A / B): B counts the pairs of runs of two values that differ by at most ``tolerance`` deviations everywhere, A those
    of three. Without pairs, and at most, ``most``; short series and those with a deviation below ``flat`` give 0; null
    arrays, and arrays with a null, give null.

    Pairs are counted by the distance between them: along each, a run of close values of length k holds k - 1 pairs of two.
    """
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / n
    bound = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    variance = bound(mean, lambda m: F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / n)
    counts = lambda run, b, a: F.struct(run.cast("int").alias("run"), b.cast("long").alias("b"), a.cast("long").alias("a"))

    def pairs(near: Column) -> Column:
        def distance(total: Column, d: Column) -> Column:
            def step(s: Column, i: Column) -> Column:
                close = F.abs(F.get(values, i) - F.get(values, i + d)) <= near
                run = F.when(close, s["run"] + 1).otherwise(F.lit(0))
                return counts(run, s["b"] + F.when(close & (s["run"] >= 1), 1).otherwise(0), s["a"] + F.when(close & (s["run"] >= 2), 1).otherwise(0))

            # a run goes along one distance only
            return F.aggregate(F.sequence(F.lit(0), n - 1 - d), counts(F.lit(0), total["b"], total["a"]), step)

        return F.aggregate(F.sequence(F.lit(1), n - 1), counts(F.lit(0), F.lit(0), F.lit(0)), distance)

    entropy = lambda c: F.when((c["a"] > 0) & (c["b"] > 0), F.least(F.lit(most), F.log(F.try_divide(c["b"].cast("double"), c["a"].cast("double"))))).otherwise(most)
    usable = values.isNotNull() & ~F.exists(values, lambda v: v.isNull())
    spread = F.sqrt(variance)
    found = F.when((n <= 3) | (spread < flat), 0.0).otherwise(bound(bound(tolerance * spread, pairs), entropy))
    return F.when(usable, found)


def with_last_added(residuals: Column, last: Column) -> Column:
    """A forecast of differences from the last value, as values."""
    return F.transform(residuals, lambda v: v + last)


def patience(base: Column, epochs: Column, by_batch: Column) -> Column:
    """How many epochs without improvement to wait: half of all at least where the schedule steps with every batch."""
    return F.when(by_batch, F.greatest(base, F.floor(epochs / 2).cast("int"))).otherwise(base)
