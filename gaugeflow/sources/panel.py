"""Hourly panels from events, and the fixed history and forecast windows cut from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HISTORY, AHEAD = 336, 48


def hour_range(events: DataFrame, ts: str = "ts") -> tuple[str, int]:
    """The first day's midnight and the number of hours up to the end of the last day that events are from."""
    first, last = events.agg(F.to_date(F.min(ts)), F.to_date(F.max(ts))).first()
    return (str(first), 24 * ((last - first).days + 1)) if first is not None else ("1970-01-01", 0)


def _hours_of(events: DataFrame, key: str, start: str, *aggregates: Column) -> DataFrame:
    """``key, h`` and the aggregates of each hour from ``start`` that has events."""
    events = events.where(F.col(key).isNotNull() & F.col("ts").isNotNull())
    hour = F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lit(start).cast("timestamp"))) / 3600)
    return events.select(F.col(key).cast("string").alias("key"), hour.alias("h"), "value").groupBy("key", "h").agg(*aggregates)


def hourly_panel(events: DataFrame, key: str = "event_type", start: str | None = None, hours: int | None = None) -> DataFrame:
    """``key, h, q, n``: the sum and count of ``value`` in each hour from ``start``; hours without events are 0.

    Without ``start`` and ``hours`` all days that have events are covered; with them, events outside are left out.
    """
    if start is None or hours is None:
        start, hours = hour_range(events.where(F.col(key).isNotNull()))
    seen = _hours_of(events, key, start, F.sum("value").alias("q"), F.count("*").alias("n")).where(F.col("h").between(0, hours - 1))
    every = F.sequence(F.lit(0).cast("long"), F.lit(hours - 1).cast("long")) if hours else F.array().cast("array<bigint>")
    grid = seen.select("key").distinct().select("key", F.explode(every).alias("h"))
    return grid.join(seen, ["key", "h"], "left").select("key", "h", F.coalesce("q", F.lit(0.0)).alias("q"), F.coalesce("n", F.lit(0)).alias("n"))


def hourly_series(events: DataFrame, key: str = "event_type", start: str | None = None, hours: int | None = None) -> DataFrame:
    """``key, s``: the values ``q`` of the panel as one array a key, without a grid: gaps between hours become zeros.

    Without ``start`` and ``hours`` the days come from the gathered hours themselves, within the plan, so events are read once.
    """
    given = start is not None and hours is not None
    seen = _hours_of(events, key, start if given else "1970-01-01", F.sum("value").alias("q"))
    seen = seen.where(F.col("h").between(0, hours - 1)) if given else seen
    points = seen.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("h", "q"))).alias("p"))  # at most ``hours`` of them
    if given:
        placed = points.select("*", F.lit(0).cast("long").alias("from"), F.lit(hours).cast("long").alias("to"))
    else:
        first, last = F.min(F.col("p")[0]["h"]), F.max(F.element_at("p", -1)["h"])
        days = points.agg((F.floor(first / 24) * 24).alias("from"), (F.floor(last / 24) * 24 + 24).alias("to"))
        placed = points.crossJoin(F.broadcast(days))  # one row
    zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    later = F.concat(F.transform(F.slice("p", 2, F.size("p")), lambda x: x["h"]), F.array(F.col("to")))
    filled = F.zip_with("p", later, lambda x, after: F.concat(F.array(F.coalesce(x["q"], F.lit(0.0))), zeros(after - x["h"] - 1)))
    return placed.select("key", F.concat(zeros(F.col("p")[0]["h"] - F.col("from")), F.flatten(filled)).alias("s"))


def cut_windows(panel: DataFrame, history: int = HISTORY, ahead: int = AHEAD, stride: int = 24) -> DataFrame:
    """``key, origin, x, y``: the history up to and including hour ``origin``, and the hours after it.

    A key's series is gathered once (its length is the panel's) and sliced, so no band join is needed.
    """
    series = panel.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("h", "q"))), lambda s: s["q"]).alias("s"))
    return series_windows(series, history, ahead, stride)


def series_windows(series: DataFrame, history: int = HISTORY, ahead: int = AHEAD, stride: int = 24) -> DataFrame:
    """The windows of ``cut_windows`` from ``hourly_series``, with what else the series' rows have."""
    more = [c for c in series.columns if c not in ("key", "s")]
    last = F.size("s") - ahead - 1
    # short series have no origins; a filter on the size would have the series made twice
    found = F.when(last >= history - 1, F.sequence(F.lit(history - 1), last, F.lit(stride)))
    origins = series.select("*", F.explode(found).alias("origin"))
    return origins.select("key", F.col("origin").cast("long"), F.slice("s", F.col("origin") - history + 2, history).alias("x"), F.slice("s", F.col("origin") + 2, ahead).alias("y"), *more)


def long_targets(windows: DataFrame, *columns: Column | str) -> DataFrame:
    """``key, origin, lead_h`` (from 1), ``obs`` and the given array columns, one row an hour ahead."""
    arrays = ["y", *columns]
    zipped = windows.select("key", "origin", F.posexplode(F.arrays_zip(*arrays)).alias("i", "z"))
    return zipped.select("key", "origin", (F.col("i") + 1).cast("long").alias("lead_h"), F.col("z.y").alias("obs"), *(F.col(f"z.{c}").alias(c) for c in columns))
