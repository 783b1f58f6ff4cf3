"""Queries for curves, routing, branch inputs and resampling, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeflow.functions.series import branch_inputs, early_stop, moving_mean, threshold_disagrees, warmup_cosine
from gaugeflow.operators import diagnostics, metrics
from gaugeflow.plans.catalogue import PANEL, _panel, _rows, _table, _windows, query, rounded


@query(
    PANEL.replace("WITH", "WITH RECURSIVE", 1) + """d AS (SELECT key, CAST(h // 24 AS INTEGER) AS day, round(sum(q) / 100, 6) AS v FROM panel GROUP BY ALL),
s AS (SELECT *, least(0.999e0, (1 + day) / (10e0 + day)) AS r FROM d),
f AS (
  SELECT key, day, v AS best, day AS best_epoch, day AS epoch, false AS stopped, v AS mean FROM s WHERE day = 0
  UNION ALL
  SELECT s.key, s.day, CASE WHEN NOT stopped AND v > best + 1e-4 THEN v ELSE best END, CASE WHEN NOT stopped AND v > best + 1e-4 THEN s.day ELSE best_epoch END,
    CASE WHEN stopped THEN epoch ELSE s.day END, stopped OR (v <= best + 1e-4 AND s.day - best_epoch >= 5), r * mean + (1 - r) * v
  FROM f JOIN s ON s.key = f.key AND s.day = f.day + 1)
SELECT key, round(best, 6) AS best, best_epoch, epoch, stopped, round(mean, 6) AS mean FROM f WHERE day = 29"""
)
def stopping_days(spark, sf_dir):
    """Each key's daily totals as a curve: where early stopping with a patience of five ends it, and its exponential mean."""
    days = _panel(spark, sf_dir).groupBy("key", F.expr("h div 24").alias("day")).agg(F.round(F.sum("q") / 100, 6).alias("v"))
    curve = days.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "v"))), lambda p: p["v"]).alias("s"))
    return rounded(curve.select("key", early_stop(F.col("s"), 5).alias("e"), moving_mean(F.col("s")).alias("mean")).select("key", "e.*", "mean"))


@query(PANEL + "x AS (SELECT DISTINCT h FROM panel) SELECT h, round(CASE WHEN h < 36 THEN h / 36e0 ELSE 0.01e0 + 0.99e0 * 0.5e0 * (1 + cos(pi() * (h - 36) / 684)) END, 6) AS factor FROM x")
def learning_rates(spark, sf_dir):
    """The factor of the learning rate at each hour's step."""
    return rounded(_panel(spark, sf_dir).select("h").distinct().select("h", warmup_cosine(F.col("h"), 720).alias("factor")))


@query("WITH e AS (SELECT vec_id, embedding[7] AS o, unnest(embedding[1:6]) AS v FROM embeddings) SELECT vec_id, count(*) FILTER (v >= o) <> 2 AS disagrees FROM e GROUP BY vec_id")
def routing_disagreement(spark, sf_dir):
    """For which vectors does the threshold rule fall back to the fixed split? The seventh value stands for the original's."""
    return _table(spark, sf_dir, "embeddings").select("vec_id", threshold_disagrees(F.slice("embedding", 1, 6), F.get("embedding", F.lit(6)), 2).alias("disagrees"))


@query(
    PANEL + """w AS (SELECT key, origin, h, q, avg(q) OVER (PARTITION BY key, origin) AS m FROM history),
c AS (SELECT key, origin, sum(m * m) AS slow, sum((q - m) ** 2) AS fast, sum(((h % 24) ** 2)) AS clock FROM w GROUP BY ALL),
b AS (SELECT key, origin, 0 AS branch, 0 AS channel, slow AS power FROM c UNION ALL SELECT key, origin, 1, 0, fast FROM c UNION ALL SELECT key, origin, unnest([0, 1]), 1, clock FROM c)
SELECT key, origin, branch, channel, round(power, 4) AS power FROM b"""
)
def branch_powers(spark, sf_dir):
    """The sum of squares of each channel of two branches, which hold the window's mean and what is left beside the hour of the day."""
    w = _windows(spark, sf_dir).withColumn("m", F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / F.size("x"))
    clock = F.transform("x", lambda v, i: ((F.col("origin") - F.size("x") + 1 + i) % 24).cast("double"))
    fast, slow = F.transform("x", lambda v: v - F.col("m")), F.transform("x", lambda v: F.col("m"))
    branches = branch_inputs(F.array("x", clock), F.array(fast, slow), F.array(F.lit(1), F.lit(0)))
    each = w.select("key", "origin", F.posexplode(branches).alias("branch", "b")).select("key", "origin", "branch", F.posexplode("b").alias("channel", "v"))
    return rounded(each.select("key", "origin", "branch", "channel", F.aggregate("v", F.lit(0.0), lambda a, v: a + v * v).alias("power")), 4)


@query(
    PANEL + """v AS (SELECT key, 1 - sum((decay - obs) ** 2) / (var_pop(obs) * count(*)) AS a, 1 - sum((persistence - obs) ** 2) / (var_pop(obs) * count(*)) AS b FROM rows GROUP BY key),
p AS (SELECT a, b, row_number() OVER (ORDER BY key) - 1 AS place, count(*) OVER () AS n FROM v),
g AS (SELECT s.range AS resample, CAST('0x' || substr(md5('42:' || s.range || ':' || p.place), 1, 8) AS BIGINT) % p.n AS pick FROM range(4000) s CROSS JOIN p),
m AS (SELECT resample, round(median(a) - median(b), 9) AS d FROM g JOIN p ON p.place = g.pick GROUP BY resample)
SELECT count(*) AS n, round(quantile_cont(d, 0.025), 6) AS low, round(median(d), 6) AS middle, round(quantile_cont(d, 0.975), 6) AS high, round(avg(CAST(d > 0 AS INT)), 6) AS share FROM m"""
)
def bootstrap_medians(spark, sf_dir):
    """How sure is it, over resamples of the keys, that decay's median score lies above persistence's?"""
    rows = _rows(spark, sf_dir, "persistence", "decay")
    a, b = (metrics.score(rows, k).select("key", F.col("nse").alias(k)) for k in ("decay", "persistence"))
    return rounded(diagnostics.bootstrap_medians(a.join(b, "key"), "key", "decay", "persistence"))
