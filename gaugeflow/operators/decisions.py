"""Decision rules as data: conditions are rows, judged on metrics of runs that are paired by arm and seed.

A rule compares a treatment with a reference arm. Each of its conditions names a metric, what to take of it (the paired
``delta`` or the ``treat``ment's own values), how to sum it up over the seeds, and a bound. With fewer than ``least`` values a
condition is pending, and so is the rule; otherwise the rule holds if all its conditions do, where a value that is not a
number meets no bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gaugeflow.functions.series import peak_of_means
from gaugeflow.operators.reports import early_skill

# The rules' bounds.
ADOPT = [("median_nse", "delta", "mean", ">=", 0.02, 3), ("median_nse", "delta", "min", ">", 0.0, 3), ("h25_48", "delta", "mean", ">=", 0.0, 3)]
PICK = [("median_nse", "delta", "mean", ">=", 0.01, 3), ("highflow_beta", "treat", "median", ">=", 0.9, 0)]
GATE = [("median_nse", "delta", "mean", ">=", 0.01, 1), ("early_skill", "delta", "min", ">", 0.0, 1)]
CLOSE = [("median_nse", "delta", "mean", "<", 0.02, 1), ("sanval", "delta", "mean", "<", 0.02, 1)]
VOTES = [("votes", "treat", "mean", ">=", 4.0, 1)]
KINDS = {
    "adopt": (ADOPT, ("ADOPT", "REJECT", "PENDING"), None), "pick": (PICK, ("MAE", "Huber 0.5", "PENDING"), None), "gate": (GATE, ("PASS", "FAIL", "PENDING"), 42),
    "close": (CLOSE, ("CLOSE", "KEEP", "PENDING"), 42), "votes": (VOTES, ("ADOPT", "REJECT", "PENDING"), None),
}
CONDITION = "kind string, position int, metric string, of string, how string, op string, bound double, least int, seed int"


def resolved(metrics: DataFrame, first: str | None = None) -> DataFrame:
    """One row a run of ``metrics`` (``run, source, skill_by_lead`` and others): its own file if that has skills, else the
    rescored one, else its own as it is. Of equal files of a run the one with the least number ``first``, if given, then the one with the greater text is taken."""
    skilled = F.coalesce(F.size("skill_by_lead") > 0, F.lit(False))
    rank = F.when((F.col("source") == "own") & skilled, 0).when(F.col("source") == "rescore", 1).when(F.col("source") == "own", 2)
    whole = F.struct(*metrics.columns)
    best = metrics.withColumn("_rank", rank).where("_rank is not null").groupBy("run").agg(F.max_by(whole, F.struct(-F.col("_rank"), *[-F.col(c) for c in (first,) if c], F.to_json(whole))).alias("m"))
    return best.select("m.*")


def metric_rows(runs: DataFrame) -> DataFrame:
    """``arm, seed, metric, value`` of runs with ``arm, seed, median_nse, horizon_nse, skill_by_lead, highflow_beta, sanval``.

    ``h25_48`` is the mean of the last two buckets, ``early_skill`` that of the first three hours; null where a part is missing.
    """
    bucket = lambda name: F.try_element_at("horizon_nse", F.lit(name))
    values = {
        "median_nse": F.col("median_nse"), "h25_48": (bucket("h25_36") + bucket("h37_48")) / 2, "early_skill": early_skill(F.col("skill_by_lead")),
        "highflow_beta": F.col("highflow_beta"), "sanval": F.col("sanval"),
    }
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in values.items())))
    return runs.select("arm", "seed", each.alias("m")).select("arm", "seed", "m.metric", "m.value").where("value is not null")


def ema_votes(histories: DataFrame) -> DataFrame:
    """One row ``arm, seed, metric, value``: how many runs (``run, epoch, nse, ema``) have a smoothed peak of the mean weights'
    curve as high as that of the others. Runs without that curve, or with fewer than three epochs, have no vote."""
    voting = histories.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("epoch", "nse", "ema"))).alias("h"), F.count("ema").alias("n"), F.count("*").alias("all"))
    voting = voting.where((F.col("n") == F.col("all")) & (F.col("all") >= 3))
    curve = lambda c: peak_of_means(F.transform("h", lambda x: x[c]))
    vote = F.coalesce(curve("ema") >= curve("nse"), F.lit(False))
    return voting.agg(F.lit("*").alias("arm"), F.lit(0).alias("seed"), F.lit("votes").alias("metric"), F.coalesce(F.sum(vote.cast("double")), F.lit(0.0)).alias("value"))


def conditions(spark, kinds: dict = KINDS) -> DataFrame:
    """The conditions of each kind of rule, a row each."""
    rows = [(kind, k, *c, seed) for kind, (found, _, seed) in kinds.items() for k, c in enumerate(found)]
    return spark.createDataFrame(rows, CONDITION)


def _summed(values: Column, how: Column) -> Column:
    mean = F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, v: a + v), F.size(values))
    real = F.array_sort(F.filter(values, lambda v: ~F.isnan(v)))
    middle = lambda n: F.get(real, n.cast("int"))
    median = (middle(F.floor((F.size(real) - 1) / 2)) + middle(F.ceil((F.size(real) - 1) / 2))) / 2
    return F.when(how == "mean", mean).when(how == "min", F.array_min(values)).when(how == "max", F.array_max(values)).when(how == "median", median)


def decide(rules: DataFrame, metrics: DataFrame, kinds: dict = KINDS) -> DataFrame:
    """``rule, n_pairs, values, verdict`` of ``rules`` (``rule, kind, treat, ref``): ``values`` maps ``metric how`` to what was
    judged, ``n_pairs`` counts the seeds that have both arms' medians. Rows of one ``rule`` are judged together."""
    spark = rules.sparkSession
    asked = rules.join(F.broadcast(conditions(spark, kinds)), "kind")  # a dozen rows
    treat = metrics.select(F.col("arm").alias("treat"), "metric", F.col("seed").alias("at"), F.col("value").alias("t"))
    ref = metrics.select(F.col("arm").alias("ref"), "metric", F.col("seed").alias("at"), F.col("value").alias("r"))
    met = asked.join(treat, ["treat", "metric"], "left").join(ref, ["ref", "metric", "at"], "left")
    value = F.when(F.col("of") == "delta", F.col("t") - F.col("r")).otherwise(F.col("t"))
    counted = F.col("at").isNotNull() & (F.col("seed").isNull() | (F.col("seed") == F.col("at")))
    values = F.collect_list(F.when(counted, value))  # a seed each
    judged = met.groupBy("rule", "kind", "position", "metric", "of", "how", "op", "bound", "least").agg(values.alias("v")).withColumn("value", _summed(F.col("v"), F.col("how")))
    bound = F.when(F.col("op") == ">=", F.col("value") >= F.col("bound")).when(F.col("op") == ">", F.col("value") > F.col("bound")).otherwise(F.col("value") < F.col("bound"))
    number = F.col("value").isNotNull() & ~F.isnan("value")
    judged = judged.select("*", (F.size("v") < F.col("least")).alias("waits"), (number & F.coalesce(bound, F.lit(False))).alias("holds"))
    name = F.concat("metric", F.lit(" "), "how")
    pairs = F.max(F.when((F.col("metric") == "median_nse") & (F.col("of") == "delta"), F.size("v")))
    verdicts = judged.groupBy("rule", "kind").agg(
        F.coalesce(pairs, F.lit(0)).alias("n_pairs"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(name.alias("k"), F.col("value").alias("v"))))).alias("values"),
        F.when(F.bool_or("waits"), None).otherwise(F.bool_and("holds")).alias("yes"),
    )
    text = F.lit(None).cast("string")
    for kind, (_, (yes, no, waits), _) in kinds.items():
        said = F.when(F.col("yes"), yes).when(~F.col("yes"), no).otherwise(waits)
        text = F.when(F.col("kind") == kind, said).otherwise(text)
    return verdicts.select("rule", "n_pairs", "values", text.alias("verdict"))


@F.udf(StringType())
def _pair_text(seed, delta, late):
    """Rounds the double itself, as C does; ``format_string`` rounds its shortest text, so -0.31765 would become -0.3177."""
    return f"s{seed}: {delta:+.4f} (h25-48 {'-' if late is None else f'{late:+.4f}'})"


def pair_texts(rules: DataFrame, metrics: DataFrame) -> DataFrame:
    """``rule, pairs``: the rule's differences by seed, as ``s42: +0.0213 (h25-48 +0.0100)``; a dash without any."""
    own = metrics.where(F.col("metric").isin("median_nse", "h25_48")).groupBy("arm", "seed").pivot("metric", ["median_nse", "h25_48"]).agg(F.first("value"))
    side = lambda name, p: own.select(F.col("arm").alias(name), "seed", F.col("median_nse").alias(f"{p}m"), F.col("h25_48").alias(f"{p}h"))
    met = rules.select("rule", "treat", "ref").join(side("treat", "t"), "treat").join(side("ref", "r"), ["ref", "seed"]).where("tm is not null and rm is not null")
    text = _pair_text("seed", F.col("tm") - F.col("rm"), F.col("th") - F.col("rh"))
    lines = met.groupBy("rule").agg(F.array_sort(F.collect_list(F.struct("seed", text.alias("text")))).alias("l"))  # a seed each
    joined = F.array_join(F.transform("l", lambda x: x["text"]), "  ")
    return rules.select("rule").distinct().join(lines, "rule", "left").select("rule", F.coalesce(joined, F.lit("-")).alias("pairs"))
