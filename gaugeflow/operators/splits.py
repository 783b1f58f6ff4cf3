"""Seeded splits by hash, and audits of what the sides share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.operators.graph import connected_components
from gaugeflow.operators.ranks import running
from gaugeflow.session import Scratch


def ranked_by_hash(rows: DataFrame, seed: int, name: str, *keys: str) -> DataFrame:
    """``rows`` with ``rank`` (from 1) by md5(seed:name), then name, within ``keys``, and the number ``n`` of their rows.

    A task ranks the rows of one range of hashes; the counts of the ranges before it are added, so no group has to fit
    into one task.
    """
    hashed = rows.withColumn("hash", F.md5(F.concat(F.lit(f"{seed}:"), F.col(name).cast("string"))))
    hashed = hashed.withColumn("range", F.substring("hash", 1, 2))
    counts = hashed.groupBy(*keys, "range").agg(F.count("*").alias("m"))
    all_of = Window.partitionBy(*keys)  # at most 256 rows for each key
    before = F.coalesce(F.sum("m").over(all_of.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*keys, "range", before.alias("before"), F.sum("m").over(all_of).alias("n"))
    own = F.row_number().over(Window.partitionBy(*keys, "range").orderBy("hash", name))
    ranked = hashed.withColumn("own", own).join(counts, [*keys, "range"])
    return ranked.withColumn("rank", F.col("before") + F.col("own")).drop("hash", "range", "own", "before")


def hold_out_keys(keys: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """``key, held_out``: the first ``round(n * fraction)`` keys, at least one, in order of md5(seed:key)."""
    distinct = keys.select(F.col(key).cast("string").alias("key")).where("key is not null").distinct()
    ranked = ranked_by_hash(distinct, seed, "key")
    return ranked.select("key", (F.col("rank") <= F.greatest(F.lit(1), F.bround(F.col("n") * fraction))).alias("held_out"))


def hold_out_within(rows: DataFrame, key: str, row_id: str, fraction: float, seed: int = 42) -> DataFrame:
    """``key, id, held_out``: in each group the first ``floor(n * fraction)`` rows, at least one, by md5 order."""
    ranked = ranked_by_hash(rows.select(F.col(key).alias("key"), F.col(row_id).alias("id")).where("key is not null"), seed, "id", "key")
    return ranked.select("key", "id", (F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("n") * fraction))).alias("held_out"))


def assign_components(rows: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """``key, component, size, held_out`` from ``key, component``: whole components are held out, the smallest first
    (equal ones by hash), until ``fraction`` of the key's rows is reached; none may lift the total over twice the
    fraction, or over one half. A key whose smallest component is too large for that holds out the smallest.

    Sizes ascend, so once one is too large all later ones are, and a running sum decides; it runs over ranges of the sizes, so
    no task has to hold a key's components.
    """
    return assign_sizes(rows.groupBy("key", "component").agg(F.count("*").alias("size")), fraction, seed)


def assign_sizes(sizes: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """``assign_components`` from ``key, component, size``, a row each."""
    scratch = Scratch(sizes.sparkSession, "assign-components")
    jitter = F.md5(F.concat(F.lit(f"{seed}:"), F.col("component").cast("string")))
    sizes = scratch.table(sizes.withColumn("jitter", jitter), "sizes")
    whole = sizes.groupBy(F.col("key").alias("of")).agg(F.sum("size").alias("total"), F.min(F.struct("size", "component")).alias("least"))
    placed = running(sizes, ["key"], ["size", "jitter", "component"], ["size"]).join(whole, F.col("key").eqNullSafe(F.col("of")))
    target, cap = F.bround(F.col("total") * fraction), F.floor(F.col("total") * min(0.5, 2 * fraction))
    fits = (F.col("upto_size") <= cap) & (F.col("upto_size") - F.col("size") < target)
    alone = (F.col("least.size") > cap) & F.col("least.component").eqNullSafe(F.col("component")) & (target > 0)
    return placed.select("key", "component", "size", (fits | alone).alias("held_out"))


def split_statistics(assigned: DataFrame) -> DataFrame:
    """``key, n_rows, n_held, share, n_components, largest`` of ``assign_components``."""
    held = F.sum(F.when(F.col("held_out"), F.col("size")).otherwise(0))
    return assigned.groupBy("key").agg(
        F.sum("size").alias("n_rows"), held.alias("n_held"), (held / F.sum("size")).alias("share"),
        F.count("*").alias("n_components"), F.max("size").alias("largest"),
    )


def seen_flags(grams_in: DataFrame, grams_x: DataFrame, grams_y: DataFrame, threshold: int = 3, same_key: bool = True) -> DataFrame:
    """``key, origin, input_seen, target_seen``: does training hold ``threshold`` runs of a window's inputs, or targets?

    Without ``same_key`` runs of any key count, for splits that share none.
    """
    on = ["key", "h", "g"] if same_key else ["h", "g"]
    known = grams_in.withColumn("h", F.xxhash64("g")).select(*on).distinct()
    each = grams_x.withColumn("part", F.lit("x")).unionByName(grams_y.withColumn("part", F.lit("y"))).withColumn("h", F.xxhash64("g"))
    hit = each.join(known.withColumn("known", F.lit(1)).hint("merge"), on, "left").groupBy("key", "origin")
    count = lambda part: F.count_if((F.col("part") == part) & F.col("known").isNotNull())
    return hit.agg((count("x") >= threshold).alias("input_seen"), (count("y") >= threshold).alias("target_seen"))


def leak_rates(flags: DataFrame) -> DataFrame:
    """``key, n, n_input, n_target, rate``: how many windows of each key have inputs or targets that training holds."""
    either = F.col("input_seen") | F.col("target_seen")
    return flags.groupBy("key").agg(F.count("*").alias("n"), F.count_if("input_seen").alias("n_input"), F.count_if("target_seen").alias("n_target"), F.avg(either.cast("int")).alias("rate"))


def grams(windows: DataFrame, column: str = "x", n: int = 6, least_distinct: int = 3) -> DataFrame:
    """``key, origin, g``: each distinct run of n values of a window with at least ``least_distinct`` distinct ones."""
    runs = F.transform(F.sequence(F.lit(1), F.size(column) - n + 1), lambda i: F.slice(F.transform(column, lambda v: v + 0.0), i, n))
    each = windows.where(F.size(column) >= n).select("key", "origin", F.explode(F.array_distinct(runs)).alias("g"))
    return each.where(F.size(F.array_distinct("g")) >= least_distinct)


def _runs(windows: DataFrame, column: str, n: int, least_distinct: int, *others: str) -> DataFrame:
    """``key, origin``, ``others``, ``g`` and its hash ``h`` with the key: the runs of ``grams``, repeated where a window repeats them."""
    plain = windows.where(F.size(column) >= n).select("key", "origin", *others, F.transform(column, lambda v: v + 0.0).alias("_x"))
    each = plain.select("key", "origin", *others, "_x", F.explode(F.sequence(F.lit(1), F.size("_x") - n + 1)).alias("_i"))
    each = each.select("key", "origin", *others, F.slice("_x", F.col("_i"), n).alias("g")).where(F.size(F.array_distinct("g")) >= least_distinct)
    return each.withColumn("h", F.xxhash64("key", "g"))


def _over_equal_runs(value: Column) -> Column:
    """An aggregate over all rows with the same run of a key. Runs are dealt once and nothing is broadcast: what an array explodes
    to is larger than the planner takes it for."""
    return value.over(Window.partitionBy("h", "key", "g"))


def leaked_windows(grams_in: DataFrame, grams_out: DataFrame, threshold: int = 3) -> DataFrame:
    """``key, origin, n_shared, leaked``: windows held out, and how many of their runs some training window of the key has."""
    seen = grams_in.select("key", F.xxhash64("g").alias("h"), "g").distinct()
    shared = grams_out.withColumn("h", F.xxhash64("g")).join(seen.hint("merge"), ["key", "h", "g"], "left_semi").groupBy("key", "origin").agg(F.count("*").alias("n_shared"))
    every = grams_out.select("key", "origin").distinct().join(shared, ["key", "origin"], "left")
    n = F.coalesce("n_shared", F.lit(0))
    return every.select("key", "origin", n.alias("n_shared"), (n >= threshold).alias("leaked"))


def overlap_components(windows: DataFrame, column: str = "x", n: int = 6) -> DataFrame:
    """``key, origin, component``: windows of a key that share a run of n values, not all equal, directly or through others, are
    of one component, which is named by the smallest origin in it. A window without such a run is one of its own.

    Windows are told apart by key and origin themselves and runs by their values, never by hashes alone.
    """
    runs = _runs(windows, column, n, 2).withColumn("first", _over_equal_runs(F.min("origin")))
    ends = runs.where("first <> origin").select("key", "first", "origin").distinct()
    edges = ends.select(F.struct("key", F.col("first").alias("origin")).alias("a"), F.struct("key", "origin").alias("b"))
    found = connected_components(edges).select("node.key", "node.origin", F.col("component.origin").alias("component"))
    joined = windows.select("key", "origin").distinct().join(found.hint("merge"), ["key", "origin"], "left")
    return joined.select("key", "origin", F.coalesce("component", "origin").alias("component"))


def build_split(windows: DataFrame, fraction: float = 0.12, seed: int = 42, mode: str = "component", column: str = "x") -> DataFrame:
    """``key, origin, label, size, held_out`` for every window; both sides share no run of values within a key.

    ``component``: overlapping windows are components, labelled densely by first appearance; whole components are held out.
    ``basin``: whole keys are held out; a key's label is 0. A table without windows gives none.
    """
    scratch = Scratch(windows.sparkSession, "build-split")
    if mode == "basin":
        sides = hold_out_keys(windows, "key", fraction, seed)
        sizes = windows.groupBy("key").agg(F.count("*").alias("size")).join(sides, "key")
        return windows.select("key", "origin", F.lit(0).cast("long").alias("label")).join(sizes, "key").select("key", "origin", "label", "size", "held_out")
    if mode != "component":
        raise ValueError(f"mode is component or basin, not {mode}")
    components = scratch.table(overlap_components(windows, column), "components")
    # a component is named by its first origin, so labels and sides are made of one row a component
    sizes = components.groupBy("key", "component").agg(F.count("*").alias("size"))
    labelled = running(sizes, ["key"], ["component"]).select("key", "component", "size", (F.col("rank") - 1).alias("label"))
    labelled = scratch.table(labelled, "labels")
    sides = assign_sizes(labelled.select("key", F.col("label").alias("component"), "size"), fraction, seed)
    sides = sides.select("key", F.col("component").alias("label"), "held_out").hint("merge")
    return components.join(labelled.join(sides, ["key", "label"]).hint("merge"), ["key", "component"]).select("key", "origin", "label", "size", "held_out")


def split_report(windows: DataFrame, split: DataFrame, column: str = "x", fail: bool = False) -> DataFrame:
    """``key, n_windows, n_components, largest, n_held, share, n_leaked``: what ``build_split`` made of each key.

    ``n_leaked`` counts held-out windows that share a run with the key's other side; with ``fail`` any raises an error.
    """
    sides = windows.join(split.select("key", "origin", "held_out").hint("merge"), ["key", "origin"])
    shared = _runs(sides, column, 6, 2, "held_out").withColumn("known", _over_equal_runs(F.bool_or(~F.col("held_out"))))
    leaks = shared.where("held_out and known").select("key", "origin").distinct().groupBy("key").agg(F.count("*").alias("n_leaked"))
    counted = split.groupBy("key").agg(
        F.count("*").alias("n_windows"), F.countDistinct("label").alias("n_components"), F.max("size").alias("largest"),
        F.count_if("held_out").alias("n_held"), (F.count_if("held_out") / F.count("*")).alias("share"),
    )
    n = F.coalesce("n_leaked", F.lit(0).cast("long"))
    if fail:
        n = F.when(n > 0, F.raise_error(F.concat(F.lit("windows leak: "), F.col("key"))).cast("long")).otherwise(n)
    return counted.join(leaks, "key", "left").select("key", "n_windows", "n_components", "largest", "n_held", "share", n.alias("n_leaked"))
