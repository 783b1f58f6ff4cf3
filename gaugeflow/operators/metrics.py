"""Scores of observed and predicted values per group.

A group whose observations do not vary has NSE 0 in ``score`` and no row in ``score_buckets``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.operators.selection import order_statistics, top_sum

EPS = 1e-10


def score(rows: DataFrame, pred: str, key: str = "key", obs: str = "obs") -> DataFrame:
    """``key, n_values, nse, kge, kge_r, kge_alpha, kge_beta, rmse, mae`` from mergeable moments, so tasks add up first."""
    o, p = F.col(obs), F.col(pred)
    e = p - o
    moments = rows.groupBy(key).agg(
        F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.avg(o).alias("om"), F.avg(p).alias("pm"),
        F.stddev_pop(o).alias("so"), F.stddev_pop(p).alias("sp"), F.covar_pop(o, p).alias("op"), (F.var_pop(o) * F.count("*")).alias("oo"),
    )
    so, sp = F.col("so"), F.col("sp")
    r = F.when((so <= EPS) | (sp <= EPS), 1.0).otherwise(F.try_divide(F.col("op"), so * sp))
    alpha = F.when(so <= EPS, 1.0).otherwise(F.try_divide(sp, so))
    beta = F.when(F.abs("om") <= EPS, 1.0).otherwise(F.try_divide(F.col("pm"), F.col("om")))
    parts = moments.select("*", r.alias("kge_r"), alpha.alias("kge_alpha"), beta.alias("kge_beta"))
    kge = 1 - F.sqrt(F.pow(F.col("kge_r") - 1, 2) + F.pow(F.col("kge_alpha") - 1, 2) + F.pow(F.col("kge_beta") - 1, 2))
    nse = F.when(F.col("oo") <= EPS, 0.0).otherwise(1 - F.try_divide(F.col("mse") * F.col("n"), F.col("oo")))
    rmse = F.sqrt("mse")
    return parts.select(key, F.col("n").alias("n_values"), nse.alias("nse"), kge.alias("kge"), "kge_r", "kge_alpha", "kge_beta", rmse.alias("rmse"), "mae")


def nse_by(rows: DataFrame, pred: str, *keys: str) -> DataFrame:
    """``keys, nse`` with each group's own mean; a group without variation has no row."""
    error = F.sum(F.pow(F.col(pred) - F.col("obs"), 2))
    sums = rows.groupBy(*keys).agg(error.alias("res"), (F.var_pop("obs") * F.count("*")).alias("oo"))
    return sums.where(F.col("oo") > EPS).select(*keys, (1 - F.col("res") / F.col("oo")).alias("nse"))


def score_buckets(rows: DataFrame, pred: str, width: int = 12) -> DataFrame:
    """``key, bucket, nse`` over lead buckets of ``width`` hours with the bucket's own mean."""
    bucket = F.floor((F.col("lead_h") - 1) / width).cast("long")
    return nse_by(rows.withColumn("bucket", bucket), pred, "key", "bucket")


def summarise(scores: DataFrame) -> DataFrame:
    """One row: medians and means over valid groups; the shares above 0.5 and 0.7 are of all groups."""
    valid = F.col("nse").isNotNull() & F.col("kge").isNotNull() & ~F.isnan("nse") & ~F.isnan("kge")
    v = lambda c: F.when(valid, F.col(c))
    return scores.agg(
        F.median(v("nse")).alias("median_nse"), F.avg(v("nse")).alias("mean_nse"), F.stddev_pop(v("nse")).alias("std_nse"),
        (100 * F.count_if(valid & (F.col("nse") > 0.5)) / F.count("*")).alias("pct_nse_05"), (100 * F.count_if(valid & (F.col("nse") > 0.7)) / F.count("*")).alias("pct_nse_07"),
        F.median(v("kge")).alias("median_kge"), F.avg(v("kge")).alias("mean_kge"), F.median(v("rmse")).alias("median_rmse"), F.median(v("mae")).alias("median_mae"),
        F.avg(F.greatest(v("nse"), F.lit(-1.0))).alias("mean_nse_clip"), F.count_if(valid).alias("n_basins"), F.count("*").alias("n_basins_total"),
    )


def high_flow(rows: DataFrame, pred: str, *keys: str) -> DataFrame:
    """``keys`` (``key`` without any), ``highflow_beta, fhv``: bias of the top tercile, and of the top 2 % of both, each by its own order.

    The tercile begins at the linearly interpolated quantile, so at one of the two values around it.
    """
    keys = list(keys) or ["key"]
    pairs = rows.select(*keys, F.col("obs").alias("o"), F.col(pred).alias("p"))
    at = (F.col("n_rows") - 1) * F.lit(2 / 3)
    first = F.col("n_rows") - F.greatest(F.lit(1), F.bround(0.02 * F.col("n_rows"))).cast("long") + 1
    of_obs = order_statistics(pairs.withColumn("v", F.col("o")), keys, "v", {"lo": F.floor(at) + 1, "hi": F.ceil(at) + 1, "top": first}, ["o", "p"])
    of_pred = order_statistics(pairs.withColumn("v", F.col("p")), keys, "v", {"top": first}, ["p"])
    one = lambda name, c: F.max(F.when(F.col("name") == name, c))
    from_ = lambda s: F.col(f"above_{s}") + F.col(f"equal_{s}")
    ends = [one(n, F.col("value")).alias(f"v_{n}") for n in ("lo", "hi")]
    sums = [one(n, from_(s)).alias(f"{s}_{n}") for n in ("lo", "hi") for s in ("o", "p")]
    wide = of_obs.groupBy(*keys, "n_rows").agg(*ends, *sums, one("top", top_sum("o")).alias("to"))
    cut = F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * (at - F.floor(at))
    high = lambda s: F.when(cut <= F.col("v_lo"), F.col(f"{s}_lo")).otherwise(F.col(f"{s}_hi"))
    both = wide.select(*keys, high("o").alias("ho"), high("p").alias("hp"), "to").join(of_pred.select(*keys, top_sum("p").alias("tp")), keys, "left")
    guarded = lambda a, b: F.when(F.abs(b) > EPS, F.try_divide(a, F.col(b)))
    return both.select(*keys, guarded(F.col("hp"), "ho").alias("highflow_beta"), (100 * guarded(F.col("tp") - F.col("to"), "to")).alias("fhv"))


def skill_by_lead(rows: DataFrame, pred: str, bar: str = "persistence") -> DataFrame:
    """``lead_h, skill``: one minus the ratio of squared errors to those of ``bar``, pooled over all groups."""
    sums = rows.groupBy("lead_h").agg(F.sum(F.pow(F.col(pred) - F.col("obs"), 2)).alias("m"), F.sum(F.pow(F.col(bar) - F.col("obs"), 2)).alias("b"))
    return sums.select("lead_h", F.when(F.col("b") > 0, 1 - F.try_divide("m", "b")).alias("skill"))
