"""Tables and rules over runs of experiments: one row for each run, so all of them are small.

A run has ``run, arm, seed, state`` and metrics; a metric that is missing is null and sorts last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATES = ("running", "done", "empty", "corrupt", "unknown")  # fixed order of the inventory


def finished(runs: DataFrame, metric: str) -> DataFrame:
    return runs.where((F.col("state") == "done") & F.col(metric).isNotNull())


def board(runs: DataFrame, metric: str, bar: float) -> DataFrame:
    """``place, run, value, delta, class``: best first, equal ones by name; within 0.01 of the bar a run is level with it."""
    place = F.row_number().over(Window.orderBy(F.col(metric).desc_nulls_last(), "run")).cast("long")
    delta = F.col(metric) - bar
    kind = F.when(delta > 0.01, "better").when(delta < -0.01, "worse").when(delta.isNotNull(), "level")
    return runs.select(place.alias("place"), "run", F.col(metric).alias("value"), delta.alias("delta"), kind.alias("class"))


def generalisation(gap: Column, width: float = 0.02) -> Column:
    return F.when(gap > width, "higher").when(gap < -width, "lower").when(gap.isNotNull(), "agrees")


def gradient_health(norm: Column, clip: Column) -> Column:
    return F.when((clip > 0) & (norm > clip), "clips always").when((clip > 0) & (norm < 0.1 * clip), "never clips")


def gap_audit(runs: DataFrame) -> DataFrame:
    """``run, gap, verdict, gradient``: the report split's score less the selection split's."""
    gap = F.col("dev") - F.col("sanval")
    return finished(runs, "dev").select("run", gap.alias("gap"), generalisation(gap).alias("verdict"), gradient_health(F.col("grad_norm"), F.col("clip")).alias("gradient"))


def inventory(runs: DataFrame) -> DataFrame:
    """``position, state, n``: how many runs are in each state, in the fixed order; states without runs have 0."""
    states = runs.sparkSession.createDataFrame(list(enumerate(STATES)), "position int, state string")
    known = F.when(F.col("state").isin(*STATES), F.col("state")).otherwise("unknown")
    return states.join(runs.groupBy(known.alias("state")).agg(F.count("*").alias("n")), "state", "left").select("position", "state", F.coalesce("n", F.lit(0)).alias("n"))


def detail(runs: DataFrame, *fields: str) -> DataFrame:
    """``run, field, value``: a row for each field that is not null."""
    return runs.unpivot("run", list(fields), "field", "value").where("value is not null")


def seed_table(runs: DataFrame, metric: str, seeds: tuple[int, ...]) -> DataFrame:
    """``arm, s<seed>..., mean, n``: the arms by seeds, and the mean over the seeds that there are."""
    of = lambda s: F.max(F.when(F.col("seed") == s, F.col(metric)))
    return finished(runs, metric).where(F.col("seed").isin(*seeds)).groupBy("arm").agg(*(of(s).alias(f"s{s}") for s in seeds), F.avg(metric).alias("mean"), F.count("*").alias("n"))


def seed_noise(runs: DataFrame, metric: str, bar_arm: str) -> DataFrame:
    """``run, z``: how many sample deviations of the bar arm's seeds a run lies above their mean."""
    done = finished(runs, metric)
    noise = done.where(F.col("arm") == bar_arm).agg(F.avg(metric).alias("m"), F.stddev_samp(metric).alias("sd"))
    return done.crossJoin(F.broadcast(noise)).select("run", F.when(F.col("sd") > 0, (F.col(metric) - F.col("m")) / F.col("sd")).alias("z"))


def adopt(pairs: DataFrame) -> DataFrame:
    """One row ``n_pairs, mean_delta, mean_late, adopt`` from ``d, late``: the mean gain is 0.02 or more, every gain is
    positive and the mean gain of hours 25 to 48 is not negative; null (pending) with fewer than three pairs."""
    rule = (F.avg("d") >= 0.02) & F.bool_and(F.col("d") > 0) & (F.avg("late") >= 0)
    return pairs.agg(F.count("*").alias("n_pairs"), F.avg("d").alias("mean_delta"), F.avg("late").alias("mean_late"), F.when(F.count("*") >= 3, rule).alias("adopt"))


def gate(delta: Column, early: Column, early_bar: Column) -> Column:
    """A gain of 0.01 and a better skill in the first hours; null (pending) where either is missing."""
    return F.when(delta.isNotNull() & early.isNotNull() & early_bar.isNotNull(), (delta >= 0.01) & (early > early_bar))


def early_skill(skill: Column, hours: int = 3) -> Column:
    """The mean of the first hours' skill; null where there are fewer."""
    return F.when(F.size(skill) >= hours, F.aggregate(F.slice(skill, 1, hours), F.lit(0.0), lambda a, v: a + v) / hours)


def labelled(runs: DataFrame, labels: DataFrame, suffix: str = "_s[0-9]+$") -> DataFrame:
    """``run, label``: the label of the run's name without its seed suffix, which is put behind it; else the name."""
    base, tail = F.regexp_replace("run", suffix, ""), F.regexp_extract("run", f"({suffix})", 1)
    named = runs.select("run", base.alias("base"), tail.alias("tail")).join(labels.withColumnRenamed("name", "base"), "base", "left")
    return named.select("run", F.when(F.col("label").isNotNull(), F.concat("label", F.regexp_replace("tail", "_s", " seed "))).otherwise(F.col("run")).alias("label"))


def _parts(text: str, low: int, high: int) -> Column:
    """The distinct parts of ``low`` to ``high`` characters of a text column."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))
    sized = [F.when(F.length(text) >= n, of(n) if n else F.array(F.lit(""))).otherwise(F.array().cast("array<string>")) for n in range(low, high + 1)]
    return F.array_distinct(F.flatten(F.array(*sized)))


def lookup(runs: DataFrame, asked: DataFrame, n: int = 3) -> DataFrame:
    """``asked, run``: the run of that name, else the first by name that contains it; null if there is none.

    Names are found through an index of their parts of up to ``n`` characters: a text no longer than that is looked up itself; of
    a longer one the part that fewest names hold, and only their names are searched. All joins are by equality.
    """
    named, wanted = runs.select("run").where("run is not null").distinct(), asked.select("asked").distinct()
    index = named.select("run", F.explode(_parts("run", 0, n)).alias("part"))
    common = index.groupBy("part").agg(F.count("*").alias("n"), F.min("run").alias("first"))
    short = wanted.where(F.length("asked") <= n).join(common, F.col("asked") == F.col("part")).select("asked", F.col("first").alias("found"))
    parts = wanted.where(F.length("asked") > n).select("asked", F.explode(_parts("asked", n, n)).alias("part")).join(common.select("part", "n"), "part", "left")
    rarest = parts.groupBy("asked").agg(F.min_by("part", F.col("n")).alias("part"), F.count_if(F.col("n").isNull()).alias("unknown")).where("unknown = 0")
    long = rarest.join(index, "part").where(F.col("run").contains(F.col("asked"))).groupBy("asked").agg(F.min("run").alias("found"))
    exact = named.select(F.col("run").alias("asked"), F.col("run").alias("same"))
    met = wanted.join(exact, "asked", "left").join(short.unionByName(long), "asked", "left")
    return met.select("asked", F.coalesce("same", "found").alias("run"))


def coerced(text: Column) -> Column:
    """``kind`` and ``value`` of a setting's text: bool, null, int, float or str."""
    low = F.lower(text)
    kind = F.when(low.isin("true", "false"), "bool").when(low.isin("none", "null"), "null")
    kind = kind.when(text.try_cast("long").isNotNull() & ~text.contains("."), "int").when(text.try_cast("double").isNotNull(), "float").otherwise("str")
    number = text.try_cast("double").cast("string")
    return F.struct(kind.alias("kind"), F.when(kind.isin("int", "float"), number).when(kind == "str", text).when(kind == "bool", low).alias("value"))


def grid_problems(grid: DataFrame, defaults: DataFrame, baseline: str) -> DataFrame:
    """``name, problem, key``: names given twice, entries without overrides, unknown keys, and entries of which no override
    differs from its default. ``grid`` has ``entry, name, overrides`` (a map of texts), ``defaults`` ``key, default``."""
    twice = grid.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name", F.lit("duplicate name").alias("problem"), F.lit(None).cast("string").alias("key"))
    own = grid.where(F.col("name") != baseline)
    empty = own.where(F.size("overrides") == 0).select("name", F.lit("no overrides").alias("problem"), F.lit(None).cast("string").alias("key"))
    each = own.select("entry", "name", F.explode("overrides").alias("key", "text")).join(defaults, "key", "left")
    unknown = each.where("default is null").select("name", F.lit("unknown key").alias("problem"), "key")
    same = F.col("default").isNotNull() & coerced(F.col("text")).eqNullSafe(coerced(F.col("default")))
    idle = each.groupBy("entry", "name").agg(F.bool_and(same).alias("idle")).where("idle").select("name", F.lit("nothing differs").alias("problem"), F.lit(None).cast("string").alias("key"))
    return twice.union(empty).union(unknown).union(idle)


def ensemble(members: DataFrame, n_members: int) -> DataFrame:
    """``id, lead_h, p`` from ``member, id, lead_h, p``: the mean of the members. Fails where a member lacks an id or has it twice."""
    mean = members.groupBy("id", "lead_h").agg(F.avg("p").alias("p"), F.count("*").alias("n"), F.countDistinct("member").alias("m"))
    whole = (F.col("n") == n_members) & (F.col("m") == n_members)
    checked = F.when(whole, F.col("p")).otherwise(F.raise_error(F.lit("members differ in their ids")).cast("double"))
    return mean.select("id", "lead_h", checked.alias("p"))


def normalizer_differences(a: DataFrame, b: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """``key`` of the statistics (``key, mean, std``) that only one side has or that differ by more than the tolerance."""
    both = a.join(b.select("key", F.col("mean").alias("m"), F.col("std").alias("s")), "key", "full")
    near = lambda x, y: F.abs(F.col(x) - F.col(y)) <= tolerance + 1e-5 * F.abs(F.col(y))
    return both.where(~F.coalesce(near("mean", "m") & near("std", "s"), F.lit(False))).select("key")


def comparison(runs: DataFrame, rank_by: str, histories: DataFrame | None = None, id_col: str = "run") -> DataFrame:
    """``place, run, median_nse, median_kge, gap, verdict, gradient_norm`` and the ranking figure as ``ranked``: all finished runs on
    one board, best first by ``rank_by``; runs without it come last, equal ones by name.

    ``histories`` (``run, grad_norm``) gives each run's mean gradient norm over the epochs that have one. Where runs may share a
    name, ``id_col`` tells them apart in both tables, and runs that are equal otherwise are placed by it.
    """
    done = runs.where("state = 'done'")
    gap = F.col("dev") - F.col("sanval")
    board = done.select(F.col(id_col).alias("_id"), "run", F.col("dev").alias("median_nse"), F.col("kge").alias("median_kge"), gap.alias("gap"), generalisation(gap).alias("verdict"), F.col(rank_by).alias("ranked"))
    norms = done.select(F.col(id_col).alias("_id")).limit(0).withColumn("gradient_norm", F.lit(None).cast("double"))
    if histories is not None:
        norms = histories.where(~F.isnan("grad_norm")).groupBy(F.col(id_col).alias("_id")).agg(F.avg("grad_norm").alias("gradient_norm"))
    place = F.row_number().over(Window.orderBy(F.col("ranked").desc_nulls_last(), "run", "_id")).cast("long")
    return board.join(norms, "_id", "left").select(place.alias("place"), "*").drop("_id")


def seed_points(runs: DataFrame, splits: tuple[str, ...] = ("dev", "test")) -> DataFrame:
    """``arm, split, seed, value, mean, n``: a row for each run and split that has a score, with its arm's mean over seeds."""
    long = runs.where("state = 'done'").unpivot(["arm", "seed"], list(splits), "split", "value").where("value is not null")
    means = long.groupBy("arm", "split").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    return long.join(means, ["arm", "split"]).select("arm", "split", "seed", "value", "mean", "n")
