"""Closed-form forecasts as array expressions over a window's history ``x``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("persistence", "mean", "climatology", "decay")


def group_means(windows: DataFrame) -> DataFrame:
    """``key, key_mean``: the mean history value, each hour as often as windows contain it."""
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    return windows.groupBy("key").agg((F.sum(total) / F.sum(F.size("x"))).alias("key_mean"))


def with_forecasts(windows: DataFrame, *kinds: str, ahead: int = 48) -> DataFrame:
    """``windows`` with one array column for each of ``kinds`` (all without names); means are joined only where needed."""
    kinds = kinds or KINDS
    last = F.element_at("x", -1)
    steps = F.sequence(F.lit(0), F.lit(ahead - 1))
    # the mean of the last seven values at the hour's place in the day, by index: no array is built in the lambda
    day = lambda t: F.aggregate(F.sequence(F.lit(0), F.lit(6)), F.lit(0.0), lambda a, d: a + F.get("x", F.size("x") - 168 + d * 24 + t % 24), lambda a: a / 7)
    decay: Column = F.transform(steps, lambda t: last * F.exp(-t / 24.0) + F.col("key_mean") * (1 - F.exp(-t / 24.0)))
    made = {"persistence": F.array_repeat(last, ahead), "mean": F.array_repeat("key_mean", ahead), "climatology": F.transform(steps, day), "decay": decay}
    if {"mean", "decay"} & set(kinds):
        windows = windows.join(group_means(windows), "key")
    return windows.withColumns({k: made[k] for k in kinds}).drop("key_mean")
