"""Folders of runs (``<root>/<run>/metrics_*.json``, ``summary.json``, ``history.csv``) and target files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed formats: the superset of fields over old and new files; what a file lacks is null.
_BASIN = "struct<basin_id:int, n_samples:int, nse:double, kge:double, kge_r:double, kge_alpha:double, kge_beta:double, rmse:double, mae:double>"
_SCORES = ("median_nse", "mean_nse", "std_nse", "pct_nse_05", "pct_nse_07", "median_kge", "mean_kge", "median_rmse", "median_mae", "median_nse_persistence", "mean_nse_clip", "median_highflow_beta", "median_fhv")
METRICS = ", ".join(f"{c} double" for c in _SCORES) + f", n_basins int, n_basins_total int, n_samples int, horizon_nse map<string,double>, split_name string, best_epoch int, per_basin array<{_BASIN}>, horizon_nse_persistence map<string,double>, skill_by_lead array<double>, subset_median_nse map<string,double>"
SUMMARY = "dev_median_nse double, horizon_nse map<string,double>, dev_horizon_nse map<string,double>"
HISTORY = "epoch int, train_loss double, sanval_nse double, lr double, grad_norm double, elapsed_s double, sanval_nse_ema double"


def run_name() -> Column:
    """The folder that a row's file lies in."""
    return F.regexp_extract(F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), "\\+", "%2B")), "([^/]+)/[^/]+$", 1)


def read_metrics(spark: SparkSession, root: str, file: str = "metrics_*.json", holds: str = "") -> DataFrame:
    """``run`` and the fields of its metrics; a file that is not JSON gives a row with ``corrupt`` set. ``holds`` keeps
    the runs whose name contains it."""
    found = spark.read.schema(f"{METRICS}, corrupt string").json(f"{root}/*/{file}", multiLine=True, columnNameOfCorruptRecord="corrupt", allowNonNumericNumbers=True)
    return found.select(run_name().alias("run"), "*").where(F.col("run").contains(holds))


def read_summaries(spark: SparkSession, root: str) -> DataFrame:
    """``run, dev_median_nse, horizon_nse, corrupt``; trained runs and baselines name the horizons differently."""
    found = spark.read.schema(f"{SUMMARY}, corrupt string").json(f"{root}/*/summary.json", multiLine=True, columnNameOfCorruptRecord="corrupt", allowNonNumericNumbers=True)
    return found.select(run_name().alias("run"), "dev_median_nse", F.coalesce("horizon_nse", "dev_horizon_nse").alias("horizon_nse"), "corrupt")


def read_history(spark: SparkSession, root: str) -> DataFrame:
    """``run`` and a row for each epoch; columns go by their names, those a file lacks are null."""
    lines = spark.read.text(f"{root}/*/history.csv").select(run_name().alias("run"), F.trim("value").alias("line")).where("line <> ''")
    heads = lines.where("line like 'epoch,%'").groupBy("run").agg(F.max(F.split("line", ",")).alias("names"))
    cells = lines.where("line not like 'epoch,%'").join(heads, "run").select("run", F.map_from_entries(F.arrays_zip("names", F.split("line", ","))).alias("row"))
    fields = [f.strip().split(" ") for f in HISTORY.split(",")]
    return cells.select("run", *(F.try_element_at("row", F.lit(name)).try_cast(kind).alias(name) for name, kind in fields))


def run_states(names: DataFrame, summaries: DataFrame, metrics: DataFrame, history: DataFrame) -> DataFrame:
    """``run, state, median_nse``: corrupt if a file cannot be read, else done with a summary or metrics, running with a
    history, else empty. The median is the summary's, or that of the metrics."""
    files = summaries.select("run", "corrupt", "dev_median_nse", F.lit(None).cast("double").alias("median_nse")).unionByName(metrics.select("run", "corrupt", F.lit(None).cast("double").alias("dev_median_nse"), "median_nse"))
    read = files.groupBy("run").agg(F.bool_or(F.col("corrupt").isNotNull()).alias("corrupt"), F.coalesce(F.max("dev_median_nse"), F.max("median_nse")).alias("median_nse"))
    seen = names.select("run").distinct().join(read, "run", "left").join(history.select("run", F.lit(True).alias("began")).distinct(), "run", "left")
    state = F.when(F.col("corrupt"), "corrupt").when(F.col("corrupt").isNotNull(), "done").when(F.col("began"), "running").otherwise("empty")
    return seen.select("run", state.alias("state"), "median_nse")


def read_targets(spark: SparkSession, path: str, ahead: int = 48) -> DataFrame:
    """``sample_id, y``: a CSV of ``Id, q_01 ...``; an hour that is no number is null."""
    hours = [f"q_{k:02d}" for k in range(1, ahead + 1)]
    found = spark.read.schema("Id long, " + ", ".join(f"{h} double" for h in hours)).csv(path, header=True, enforceSchema=False)
    return found.select(F.col("Id").alias("sample_id"), F.array(*hours).alias("y"))


def target_faults(targets: DataFrame, windows: DataFrame, ahead: int = 48, least_corr: float = 0.90) -> DataFrame:
    """One row of counts against ``windows`` (``sample_id, x``): missing, unknown and repeated ids, hours that are null or
    not finite, negative hours, the correlation of the last history value with the first hour, and ``valid``."""
    given = targets.groupBy("sample_id").agg(F.count("*").alias("n"), F.first("y").alias("y"))
    both = windows.select("sample_id", F.element_at("x", -1).alias("last"), F.lit(True).alias("known")).join(given, "sample_id", "full")
    infinite = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    sd = F.stddev_pop("last") * F.stddev_pop(F.get("y", F.lit(0)))
    corr = F.when(sd > 0, F.covar_pop("last", F.get("y", F.lit(0))) / sd)
    counts = both.agg(
        F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("known").isNull()).alias("unknown"), F.count_if(F.col("n") > 1).alias("repeated"),
        F.coalesce(F.sum(F.size(F.filter("y", infinite)) + F.abs(F.size("y") - ahead)), F.lit(0)).alias("not_finite"), F.coalesce(F.sum(F.size(F.filter("y", lambda v: v < 0))), F.lit(0)).alias("negative"), corr.alias("corr"),
    )
    return counts.withColumn("valid", (F.col("missing") + F.col("unknown") + F.col("repeated") + F.col("not_finite") + F.col("negative") == 0) & F.coalesce(F.col("corr") >= least_corr, F.lit(False)))


def write_report(df: DataFrame, path: str) -> None:
    """A small report as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)
