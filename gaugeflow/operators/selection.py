"""Exact order statistics of many keys by histograms, refined in passes.

No task ever holds or sorts a key's rows. The first pass counts the rows of each power of two of both signs; where a wanted
rank falls into a bin with more than ``few`` rows, a further pass counts 1024 equal bins between the least and the greatest
value of that bin, and so on. A double has 52 bits behind its power of two, so six further passes always suffice; most
data need none or one. Map tasks add up their own bins first, so a key that holds a third of all rows moves no more than
its bins. The rows of the last bins (``few`` a rank at most, equal values folded into one) settle the ranks.

Bins carry the sums of given columns, so the totals above a rank come with it and need no second look at the rows.

Null and NaN values are skipped, and rows with a null key; infinities count as values. Keys without values have no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.session import Scratch

BINS = 1024
_LARGEST = 1100  # more than any exponent of a double


def _power(v: Column) -> Column:
    """A number that never falls as v grows: the power of two of the value, with its sign."""
    size = F.floor(F.log2(F.abs(v))).cast("int") + _LARGEST
    return F.when(v == 0, 0).when(F.abs(v) == float("inf"), F.signum(v).cast("int") * 3 * _LARGEST).otherwise(F.signum(v).cast("int") * size)


def _found(bins: DataFrame, ranks: DataFrame, on: list[str], sums: list[str]) -> DataFrame:
    """The bin of each rank: its rows ``n``, ``lo``, ``hi`` and sums ``in_s``; ``below`` and ``above_s`` are of all beyond it.

    ``bins`` has at most a few thousand rows for each group of ``on``. ``ranks`` brings what the group had beyond it already.
    """
    up_to = Window.partitionBy(*on).orderBy("bin")
    after = Window.partitionBy(*on).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    above = [F.coalesce(F.sum(s).over(after), F.lit(0.0)).alias(f"_over_{s}") for s in sums]
    joined = bins.select("*", F.sum("n").over(up_to).alias("_to"), *above).join(ranks, on)
    start, wanted = F.col("_to") - F.col("n"), F.col("rank") - F.col("below")
    hit = joined.where((start < wanted) & (wanted <= F.col("_to")))
    beyond = [(F.col("below") + start).alias("below"), *((F.col(f"above_{s}") + F.col(f"_over_{s}")).alias(f"above_{s}") for s in sums)]
    return hit.select(*on, "name", "rank", "n_rows", "n", "lo", "hi", *beyond, *(F.col(s).alias(f"in_{s}") for s in sums))


def order_statistics(
    rows: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Column], sums: Sequence[str] = (), few: int = 4096
) -> DataFrame:
    """``keys, name, rank, value, n_rows, below, equal`` and, for each of ``sums``, ``above_s`` and ``equal_s``.

    ``ranks`` gives each name's rank from 1, ascending, as an expression in ``n_rows``, the number of the key's values;
    those out of range have no row. ``below`` values are less than the found one, ``equal`` the same; the sums are over
    the rows with greater and with equal values.
    """
    keys, sums = list(keys), list(sums)
    on = keys or ["_all"]
    scratch = Scratch(rows.sparkSession, "order-statistics")
    v = F.col(value).cast("double")
    held = rows.where(v.isNotNull() & ~F.isnan(v))
    held = held.where(" and ".join(f"`{k}` is not null" for k in keys)) if keys else held.withColumn("_all", F.lit(1))
    held = scratch.table(held.select(*on, (v + F.lit(0.0)).alias("v"), *(F.col(s).cast("double").alias(s) for s in sums)), "values")
    sum_up = [F.sum(s).alias(s) for s in sums]
    added = [F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), *sum_up]
    bins = scratch.table(held.groupBy(*on, _power(F.col("v")).alias("bin")).agg(*added), "bins")
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items())))
    wanted = bins.groupBy(*on).agg(F.sum("n").alias("n_rows")).select("*", wanted.alias("_w")).select(*on, "n_rows", "_w.name", "_w.rank")
    nothing = [F.lit(0).cast("long").alias("below"), *(F.lit(0.0).alias(f"above_{s}") for s in sums)]
    state = scratch.table(_found(bins, wanted.select("*", *nothing), on, sums), "ranks-0")

    def inside(some: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The values in the brackets of ``some``, and ``some`` ready to be looked up among their bins."""
        brackets = some.select(*on, F.col("lo").alias("from"), F.col("hi").alias("to")).distinct()
        ready = some.withColumnsRenamed({"lo": "from", "hi": "to"}).drop("n", *(f"in_{s}" for s in sums))
        return held.join(brackets, on).where("v between `from` and `to`"), ready

    bracket = [*on, "from", "to"]
    for k in range(1, 9):
        wide = (F.col("n") > few) & (F.col("lo") < F.col("hi"))
        if state.where(wide).isEmpty():
            break
        some, ready = inside(state.where(wide))
        # in halves, since the width of a bin could be beyond a double; without a width there are few values left
        place = F.floor(F.try_divide(F.col("v") / 2 - F.col("from") / 2, (F.col("to") / 2 - F.col("from") / 2) / BINS))
        place = F.coalesce(F.least(F.lit(BINS - 1).cast("long"), place), F.lit(0).cast("long"))
        parts = some.groupBy(*bracket, place.alias("bin")).agg(*added)
        refined = _found(parts, ready, bracket, sums).drop("from", "to")
        state = scratch.table(state.where(~wide).unionByName(refined), f"ranks-{k}")
    some, ready = inside(state)
    values = some.groupBy(*bracket, F.col("v").alias("bin")).agg(*added)
    exact = _found(values, ready, bracket, sums)
    found = [c for s in sums for c in (F.col(f"above_{s}"), F.col(f"in_{s}").alias(f"equal_{s}"))]
    return exact.select(*keys, "name", "rank", F.col("lo").alias("value"), "n_rows", "below", F.col("n").alias("equal"), *found)


def quantiles(rows: DataFrame, keys: Sequence[str], value: str, fractions: dict[str, float], few: int = 4096) -> DataFrame:
    """``keys, n_rows`` and a column for each of ``fractions``: linear between the two nearest values, nulls and NaN skipped.

    A key without values has no row.
    """
    at = {name: (F.col("n_rows") - 1) * F.lit(float(q)) for name, q in fractions.items()}
    ranks = {f"{name} {side}": step(place) + 1 for name, place in at.items() for side, step in (("lo", F.floor), ("hi", F.ceil))}
    found = order_statistics(rows, keys, value, ranks, few=few)
    one = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    wide = found.groupBy(*keys, "n_rows").agg(*(one(n).alias(n) for n in ranks))
    between = lambda n: F.col(f"{n} lo") + (F.col(f"{n} hi") - F.col(f"{n} lo")) * (at[n] - F.floor(at[n]))
    same = lambda n: F.col(f"{n} lo") == F.col(f"{n} hi")
    return wide.select(*keys, "n_rows", *(F.when(same(n), F.col(f"{n} lo")).otherwise(between(n)).alias(n) for n in fractions))


def medians(rows: DataFrame, keys: Sequence[str], values: Sequence[str], few: int = 4096) -> DataFrame:
    """``keys, column, n_rows, median`` of each of the columns ``values``; those without a value have no row."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in values)))
    long = rows.select(*keys, pairs.alias("_p")).select(*keys, "_p.column", "_p.v")
    return quantiles(long, [*keys, "column"], "v", {"median": 0.5}, few)


def top_sums(rows: DataFrame, keys: Sequence[str], value: str, how_many: Column, few: int = 4096) -> DataFrame:
    """``keys, n_top, top_sum``: the sum of the key's ``how_many`` (an expression in ``n_rows``) greatest values."""
    summed = rows.withColumn("_value", F.col(value))
    found = order_statistics(summed, keys, value, {"top": F.col("n_rows") - how_many.cast("long") + 1}, ["_value"], few)
    return found.select(*keys, top_count().alias("n_top"), top_sum("_value").alias("top_sum"))


def top_count() -> Column:
    """Of a row of ``order_statistics``: how many values its rank and those above it are."""
    return F.col("n_rows") - F.col("rank") + 1


def top_sum(column: str) -> Column:
    """The sum of these values, where ``column`` holds the values themselves: of equal ones as many as the rank takes."""
    above = F.col("n_rows") - F.col("below") - F.col("equal")
    return F.col(f"above_{column}") + (top_count() - above) * F.col("value")
