"""Every query of the engine with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeflow.functions.forecasts import KINDS, with_forecasts
from gaugeflow.functions.series import peak_of_means, route_by_entropy, sample_entropy, spark_levels
from gaugeflow.operators import compare, configs, decompose, metrics, reports, ridge, selection, splits
from gaugeflow.session import Scratch
from gaugeflow.sources.panel import hourly_panel, hourly_series, long_targets, series_windows
from gaugeflow.streaming.statistics import running_statistics

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

PANEL = """
WITH seen AS (SELECT event_type AS key, CAST(floor(epoch(ts - TIMESTAMP '2024-01-01') / 3600) AS BIGINT) AS h, sum(value) AS q, count(*) AS n FROM events GROUP BY ALL),
panel AS (SELECT k.key, g.h, coalesce(s.q, 0.0) AS q, coalesce(s.n, 0) AS n FROM (SELECT DISTINCT key FROM seen) k CROSS JOIN (SELECT CAST(range AS BIGINT) AS h FROM range(720)) g LEFT JOIN seen s ON s.key = k.key AND s.h = g.h),
origins AS (SELECT DISTINCT key, CAST(335 + 24 * range AS BIGINT) AS origin FROM panel CROSS JOIN range(15)),
history AS (SELECT o.key, o.origin, p.h, p.q FROM origins o JOIN panel p ON p.key = o.key AND p.h BETWEEN o.origin - 335 AND o.origin),
targets AS (SELECT o.key, o.origin, p.h - o.origin AS lead_h, p.q AS obs FROM origins o JOIN panel p ON p.key = o.key AND p.h BETWEEN o.origin + 1 AND o.origin + 48),
means AS (SELECT key, avg(q) AS key_mean FROM history GROUP BY key),
lasts AS (SELECT key, origin, q AS persistence FROM history WHERE h = origin),
profile AS (SELECT key, origin, h % 24 AS m, avg(q) AS climatology FROM history WHERE h > origin - 168 GROUP BY ALL),
rows AS (
  SELECT t.*, l.persistence, m.key_mean AS mean, p.climatology,
    l.persistence * exp(-(t.lead_h - 1) / 24.0) + m.key_mean * (1 - exp(-(t.lead_h - 1) / 24.0)) AS decay
  FROM targets t JOIN lasts l USING (key, origin) JOIN means m USING (key) JOIN profile p ON p.key = t.key AND p.origin = t.origin AND p.m = (t.origin + t.lead_h) % 24),
"""
SCORES = """scores AS (
  SELECT key, '{kind}' AS kind, count(*) AS n_values,
    CASE WHEN var_pop(obs) * count(*) <= 1e-10 THEN 0.0 ELSE 1 - sum(({kind} - obs) ** 2) / (var_pop(obs) * count(*)) END AS nse,
    CASE WHEN stddev_pop(obs) <= 1e-10 OR stddev_pop({kind}) <= 1e-10 THEN 1.0 ELSE covar_pop(obs, {kind}) / (stddev_pop(obs) * stddev_pop({kind})) END AS kge_r,
    CASE WHEN stddev_pop(obs) <= 1e-10 THEN 1.0 ELSE stddev_pop({kind}) / stddev_pop(obs) END AS kge_alpha,
    CASE WHEN abs(avg(obs)) <= 1e-10 THEN 1.0 ELSE avg({kind}) / avg(obs) END AS kge_beta,
    sqrt(avg(({kind} - obs) ** 2)) AS rmse, avg(abs({kind} - obs)) AS mae
  FROM rows GROUP BY key),
full_scores AS (SELECT *, 1 - sqrt((kge_r - 1) ** 2 + (kge_alpha - 1) ** 2 + (kge_beta - 1) ** 2) AS kge FROM scores)
"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly_panel(_table(spark, sf_dir, "events"))


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series_windows(hourly_series(_table(spark, sf_dir, "events")))


def _rows(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    kinds = kinds or KINDS
    return long_targets(with_forecasts(_windows(spark, sf_dir), *kinds), *kinds)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` places, so that the order of summation does not show."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query(PANEL + "x AS (SELECT 1) SELECT key, h, round(q, 6) AS q, n FROM panel")
def panel_hourly(spark, sf_dir):
    return rounded(_panel(spark, sf_dir))


@query(PANEL + "x AS (SELECT 1) SELECT key, origin, lead_h, round(obs, 6) AS obs FROM targets")
def window_targets_long(spark, sf_dir):
    return rounded(long_targets(_windows(spark, sf_dir)))


@query(PANEL + "x AS (SELECT 1) SELECT key, origin, lead_h, round(persistence, 6) AS persistence, round(mean, 6) AS mean, round(climatology, 6) AS climatology, round(decay, 6) AS decay FROM rows")
def forecasts_long(spark, sf_dir):
    return rounded(_rows(spark, sf_dir).drop("obs"))


@query(PANEL + "x AS (SELECT 1) SELECT key, round(avg(q), 6) AS mean, round(CASE WHEN stddev_pop(q) < 1e-6 THEN 1.0 ELSE stddev_pop(q) END, 6) AS std, count(*) AS n FROM history GROUP BY key")
def norm_per_basin(spark, sf_dir):
    each = _windows(spark, sf_dir).select("key", F.explode("x").alias("q"))
    std = F.stddev_pop("q")
    return rounded(each.groupBy("key").agg(F.avg("q").alias("mean"), F.when(std < 1e-6, 1.0).otherwise(std).alias("std"), F.count("*").alias("n")))


@query(PANEL + "g AS (SELECT avg(q) AS mean, stddev_pop(q) AS std FROM history) SELECT DISTINCT key, round(g.mean, 6) AS mean, round(CASE WHEN g.std < 1e-6 THEN 1.0 ELSE g.std END, 6) AS std FROM panel, g")
def norm_global(spark, sf_dir):
    windows = _windows(spark, sf_dir)
    std = F.stddev_pop("q")
    pooled = windows.select(F.explode("x").alias("q")).agg(F.avg("q").alias("mean"), F.when(std < 1e-6, 1.0).otherwise(std).alias("std"))
    return rounded(windows.select("key").distinct().crossJoin(F.broadcast(pooled)))


@query(PANEL + "n AS (SELECT key, avg(q) AS m, stddev_pop(q) AS s FROM history GROUP BY key) SELECT key, origin, round(sum((q - m) / s), 5) + 0.0 AS z_sum, true AS exact FROM history JOIN n USING (key) GROUP BY key, origin")
def zscore_roundtrip(spark, sf_dir):
    windows = _windows(spark, sf_dir)
    norm = windows.select("key", F.explode("x").alias("q")).groupBy("key").agg(F.avg("q").alias("m"), F.stddev_pop("q").alias("s"))
    z = windows.join(norm, "key").withColumn("z", F.transform("x", lambda v: (v - F.col("m")) / F.col("s")))
    error = F.array_max(F.zip_with("x", "z", lambda x, v: F.abs(v * F.col("s") + F.col("m") - x)))
    return z.select("key", "origin", (F.round(F.aggregate("z", F.lit(0.0), lambda a, v: a + v), 5) + 0.0).alias("z_sum"), (error < 1e-9).alias("exact"))


def _score_query(kind: str) -> None:
    columns = ", ".join(f"round({c}, 6) AS {c}" for c in ("nse", "kge", "kge_r", "kge_alpha", "kge_beta", "rmse", "mae"))

    def run(spark, sf_dir):
        return rounded(metrics.score(_rows(spark, sf_dir, kind), kind))

    run.__name__ = f"score_{kind}"
    query(PANEL + SCORES.format(kind=kind) + f"SELECT key, n_values, {columns} FROM full_scores")(run)


for _kind in KINDS:
    _score_query(_kind)


@query(PANEL + "b AS (SELECT key, (lead_h - 1) // 12 AS bucket, sum((decay - obs) ** 2) AS res, var_pop(obs) * count(*) AS oo FROM rows GROUP BY ALL) SELECT key, bucket, round(1 - res / oo, 6) AS nse FROM b WHERE oo > 1e-10")
def score_buckets(spark, sf_dir):
    return rounded(metrics.score_buckets(_rows(spark, sf_dir, "decay"), "decay"))


@query(PANEL + "b AS (SELECT key, (lead_h - 1) // 12 AS bucket, sum((decay - obs) ** 2) AS res, var_pop(obs) * count(*) AS oo FROM rows GROUP BY ALL) SELECT bucket, round(median(1 - res / oo), 6) AS median_nse FROM b WHERE oo > 1e-10 GROUP BY bucket")
def bucket_medians(spark, sf_dir):
    return rounded(selection.quantiles(metrics.score_buckets(_rows(spark, sf_dir, "decay"), "decay"), ["bucket"], "nse", {"median_nse": 0.5}).drop("n_rows"))


@query(
    PANEL + SCORES.format(kind="decay") + """SELECT round(median(nse), 6) AS median_nse, round(avg(nse), 6) AS mean_nse, round(stddev_pop(nse), 6) AS std_nse,
  round(100.0 * count(*) FILTER (nse > 0.5) / count(*), 6) AS pct_nse_05, round(100.0 * count(*) FILTER (nse > 0.7) / count(*), 6) AS pct_nse_07,
  round(median(kge), 6) AS median_kge, round(avg(kge), 6) AS mean_kge, round(median(rmse), 6) AS median_rmse, round(median(mae), 6) AS median_mae,
  round(avg(greatest(nse, -1)), 6) AS mean_nse_clip, count(*) AS n_basins, count(*) AS n_basins_total FROM full_scores"""
)
def aggregate_summary(spark, sf_dir):
    return rounded(metrics.summarise(metrics.score(_rows(spark, sf_dir, "decay"), "decay")))


@query(
    PANEL + """c AS (SELECT key, quantile_cont(obs, 2.0 / 3) AS cut, greatest(1, round_even(0.02 * count(*), 0)) AS k FROM rows GROUP BY key),
r AS (SELECT key, obs, decay, row_number() OVER (PARTITION BY key ORDER BY obs DESC) AS ko, row_number() OVER (PARTITION BY key ORDER BY decay DESC) AS kp FROM rows)
SELECT key, round(sum(decay) FILTER (obs >= cut) / sum(obs) FILTER (obs >= cut), 6) AS highflow_beta,
  round(100 * (sum(decay) FILTER (kp <= k) - sum(obs) FILTER (ko <= k)) / sum(obs) FILTER (ko <= k), 6) AS fhv FROM r JOIN c USING (key) GROUP BY key"""
)
def high_flow(spark, sf_dir):
    return rounded(metrics.high_flow(_rows(spark, sf_dir, "decay"), "decay"))


@query(
    PANEL + """c AS (SELECT key, quantile_cont(obs, 2.0 / 3) AS cut, greatest(1, round_even(0.02 * count(*), 0)) AS k FROM rows GROUP BY key),
r AS (SELECT key, obs, persistence AS p, row_number() OVER (PARTITION BY key ORDER BY obs DESC) AS ko, row_number() OVER (PARTITION BY key ORDER BY persistence DESC) AS kp FROM rows),
f AS (SELECT key, sum(p) FILTER (obs >= cut) / sum(obs) FILTER (obs >= cut) AS highflow_beta, 100 * (sum(p) FILTER (kp <= k) - sum(obs) FILTER (ko <= k)) / sum(obs) FILTER (ko <= k) AS fhv FROM r JOIN c USING (key) GROUP BY key),
l AS (SELECT 'highflow_beta' AS "column", highflow_beta AS v FROM f UNION ALL SELECT 'fhv', fhv FROM f)
SELECT "column", count(*) AS n_rows, round(median(v), 6) AS median FROM l WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY "column\""""
)
def high_flow_medians(spark, sf_dir):
    """Medians over the groups, skipping those without a high flow."""
    found = metrics.high_flow(_rows(spark, sf_dir, "persistence"), "persistence")
    return rounded(selection.medians(found, [], ["highflow_beta", "fhv"]))


@query("SELECT event_type AS key, count(value) AS n_rows, round(quantile_cont(value, 0.1), 6) AS q10, round(median(value), 6) AS q50, round(quantile_cont(value, 0.99), 6) AS q99 FROM events WHERE value IS NOT NULL GROUP BY event_type")
def value_quantiles(spark, sf_dir):
    """Exact quantiles of few keys with very many rows."""
    return rounded(selection.quantiles(_table(spark, sf_dir, "events"), ["event_type"], "value", {"q10": 0.1, "q50": 0.5, "q99": 0.99}).withColumnRenamed("event_type", "key"))


@query("WITH r AS (SELECT l_suppkey AS key, l_extendedprice AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC) AS k, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem), t AS (SELECT key, count(*) AS n_top, sum(v) AS top FROM r WHERE k <= ceil(0.05 * n) GROUP BY key) SELECT t.key, n_top, round(top / sum(l_extendedprice), 6) AS share FROM t JOIN lineitem ON l_suppkey = t.key GROUP BY t.key, n_top, top")
def top_share(spark, sf_dir):
    """What part of a supplier's sales the greatest twentieth of its lines make up."""
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_extendedprice").alias("v"))
    top = selection.top_sums(lines, ["key"], "v", F.ceil(0.05 * F.col("n_rows")))
    total = lines.groupBy("key").agg(F.sum("v").alias("total"))
    return rounded(top.join(total, "key").select("key", "n_top", F.try_divide("top_sum", "total").alias("share")))


@query(PANEL + "s AS (SELECT lead_h, sum((decay - obs) ** 2) AS m, sum((persistence - obs) ** 2) AS b FROM rows GROUP BY lead_h) SELECT lead_h, round(1 - m / b, 6) AS skill FROM s")
def skill_by_lead(spark, sf_dir):
    return rounded(metrics.skill_by_lead(_rows(spark, sf_dir, "persistence", "decay"), "decay"))


@query("WITH k AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS key FROM events), r AS (SELECT key, row_number() OVER (ORDER BY md5('42:' || key), key) AS k, count(*) OVER () AS n FROM k) SELECT key, k <= greatest(1, round_even(n * 0.12, 0)) AS held_out FROM r")
def split_basin_holdout(spark, sf_dir):
    return splits.hold_out_keys(_table(spark, sf_dir, "events"), "user_id", 0.12)


@query("WITH r AS (SELECT event_type AS key, event_id AS id, row_number() OVER (PARTITION BY event_type ORDER BY md5('42:' || event_id), event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT key, id, k <= greatest(1, floor(n * 0.12)) AS held_out FROM r")
def split_random_within(spark, sf_dir):
    return splits.hold_out_within(_table(spark, sf_dir, "events"), "event_type", "event_id", 0.12)


_GRAMS = """s AS (SELECT key, origin, h, q + 0.0 AS q FROM history),
w AS (SELECT key, origin, h, list(q) OVER (PARTITION BY key, origin ORDER BY h ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS g FROM s),
grams AS (SELECT DISTINCT key, origin, g FROM w WHERE len(g) = 6 AND len(list_distinct(g)) >= 3),
held AS (SELECT key, origin, row_number() OVER (PARTITION BY key ORDER BY md5('42:' || origin), origin) <= 3 AS out FROM origins)
"""


@query(PANEL + _GRAMS + ", n AS (SELECT g.key, g.origin, count(*) AS n FROM grams g JOIN held USING (key, origin) WHERE out AND EXISTS (FROM grams t JOIN held u USING (key, origin) WHERE NOT u.out AND t.key = g.key AND t.g = g.g) GROUP BY ALL) SELECT key, origin, coalesce(n, 0) AS n_shared, coalesce(n, 0) >= 3 AS leaked FROM (SELECT DISTINCT key, origin FROM grams JOIN held USING (key, origin) WHERE out) LEFT JOIN n USING (key, origin)")
def leak_flags(spark, sf_dir):
    windows = _windows(spark, sf_dir)
    held = splits.hold_out_within(windows, "key", "origin", 0.2).withColumnRenamed("id", "origin")
    runs = splits.grams(windows).join(held, ["key", "origin"])
    return splits.leaked_windows(runs.where("not held_out"), runs.where("held_out"))


_REACH = """edges AS (SELECT DISTINCT a.key, a.origin AS a, b.origin AS b FROM grams a JOIN grams b USING (key, g) WHERE a.origin <> b.origin),
reach AS (SELECT key, origin AS a, origin AS b FROM origins UNION SELECT r.key, r.a, e.b FROM reach r JOIN edges e ON e.key = r.key AND e.a = r.b)
"""


@query(PANEL.replace("WITH", "WITH RECURSIVE", 1) + _GRAMS.replace(">= 3)", ">= 2)") + ", " + _REACH + "SELECT key, a AS origin, min(b) AS component FROM reach GROUP BY ALL")
def overlap_components(spark, sf_dir):
    """Windows of one key that share a run of six values are one component."""
    return splits.overlap_components(_windows(spark, sf_dir))


_SPLIT = """WITH RECURSIVE seen AS (SELECT CAST(user_id AS VARCHAR) AS key, CAST(floor(epoch(ts - TIMESTAMP '2024-01-01') / 3600) AS BIGINT) AS h, sum(value) AS q FROM events GROUP BY ALL),
panel AS (SELECT k.key, g.h, coalesce(s.q, 0.0) AS q FROM (SELECT DISTINCT key FROM seen) k CROSS JOIN (SELECT CAST(range AS BIGINT) AS h FROM range(720)) g LEFT JOIN seen s ON s.key = k.key AND s.h = g.h),
origins AS (SELECT DISTINCT key, CAST(47 + 24 * range AS BIGINT) AS origin FROM panel CROSS JOIN range(28)),
w AS (SELECT o.key, o.origin, p.h, list(p.q + 0.0) OVER (PARTITION BY o.key, o.origin ORDER BY p.h ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS g FROM origins o JOIN panel p ON p.key = o.key AND p.h BETWEEN o.origin - 47 AND o.origin),
grams AS (SELECT DISTINCT key, origin, g FROM w WHERE len(g) = 6 AND len(list_distinct(g)) >= 2),
""" + _REACH + """, comp AS (SELECT key, a AS origin, min(b) AS first FROM reach GROUP BY ALL),
lab AS (SELECT key, origin, dense_rank() OVER (PARTITION BY key ORDER BY first) - 1 AS label FROM comp),
c AS (SELECT key, label, count(*) AS size FROM lab GROUP BY ALL),
r AS (SELECT *, sum(size) OVER (PARTITION BY key) AS total, min(size) OVER (PARTITION BY key) AS least, row_number() OVER (PARTITION BY key ORDER BY size, label) AS k,
  sum(size) OVER (PARTITION BY key ORDER BY size, md5('42:' || label), label ROWS UNBOUNDED PRECEDING) AS reached FROM c),
a AS (SELECT key, label, size, (reached <= floor(total * 0.24) AND reached - size < round_even(total * 0.12, 0)) OR (least > floor(total * 0.24) AND k = 1 AND round_even(total * 0.12, 0) > 0) AS held_out FROM r),
sp AS (SELECT key, origin, label, size, held_out FROM lab JOIN a USING (key, label))
"""


def _user_windows(spark, sf_dir) -> DataFrame:
    """Two days of a user's hours every day; days without events part them."""
    return series_windows(hourly_series(_table(spark, sf_dir, "events"), "user_id"), history=48, ahead=24)


@query(_SPLIT + "SELECT * FROM sp")
def split_labels(spark, sf_dir):
    """The split builder: overlapping windows, dense labels, packing."""
    windows = Scratch(spark, "split-labels").table(_user_windows(spark, sf_dir), "windows")
    return splits.build_split(windows)


@query(
    _SPLIT + """, lk AS (SELECT x.key, count(DISTINCT x.origin) AS n FROM grams x JOIN sp ON sp.key = x.key AND sp.origin = x.origin AND held_out JOIN grams t ON t.key = x.key AND t.g = x.g JOIN sp u ON u.key = t.key AND u.origin = t.origin AND NOT u.held_out GROUP BY x.key)
SELECT sp.key, count(*) AS n_windows, count(DISTINCT label) AS n_components, max(size) AS largest, count(*) FILTER (held_out) AS n_held, round(count(*) FILTER (held_out) / count(*), 6) AS share, coalesce(any_value(lk.n), 0) AS n_leaked FROM sp LEFT JOIN lk ON lk.key = sp.key GROUP BY sp.key"""
)
def split_report(spark, sf_dir):
    """What the split builder made of each user; a window that leaks stops the query."""
    windows = Scratch(spark, "split-report").table(_user_windows(spark, sf_dir), "windows")
    split = Scratch(spark, "split-report").table(splits.build_split(windows), "split")
    return rounded(splits.split_report(windows, split, fail=True))


@query(PANEL + "e AS (SELECT key, obs, (persistence + mean + climatology + decay) / 4 AS p FROM rows) SELECT key, round(1 - sum((p - obs) ** 2) / (var_pop(obs) * count(*)), 6) AS nse, round(avg(abs(p - obs)), 6) AS mae FROM e GROUP BY key")
def ensemble_mean(spark, sf_dir):
    rows = _rows(spark, sf_dir).withColumn("ensemble", sum((F.col(k) for k in KINDS), F.lit(0.0)) / len(KINDS))
    return rounded(metrics.score(rows, "ensemble").select("key", "nse", "mae"))


def _all_scores(spark, sf_dir) -> DataFrame:
    rows = _rows(spark, sf_dir)
    long = rows.select("key", "obs", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("p")) for k in KINDS))).alias("f")).select(F.to_json(F.struct("key", "f.kind")).alias("id"), "key", "obs", "f.kind", "f.p")
    names = long.select("id", "key", "kind").distinct()
    return metrics.score(long, "p", key="id").join(names, "id").drop("id")


_ALL = "all_scores AS (" + " UNION ALL ".join(f"SELECT key, '{k}' AS kind, 1 - sum(({k} - obs) ** 2) / (var_pop(obs) * count(*)) AS nse FROM rows GROUP BY key" for k in KINDS) + ")"


@query(PANEL + _ALL + ", m AS (SELECT kind, median(nse) AS v FROM all_scores GROUP BY kind) SELECT row_number() OVER (ORDER BY v DESC, kind) AS place, kind, round(v, 6) AS median_nse, round(v - (SELECT v FROM m WHERE kind = 'persistence'), 6) AS delta FROM m")
def scoreboard(spark, sf_dir):
    medians = _all_scores(spark, sf_dir).groupBy("kind").agg(F.median("nse").alias("v"))
    bar = medians.where("kind = 'persistence'").select(F.col("v").alias("bar"))
    place = F.row_number().over(Window.orderBy(F.desc("v"), "kind"))
    return rounded(medians.crossJoin(F.broadcast(bar)).select(place.cast("long").alias("place"), "kind", F.col("v").alias("median_nse"), (F.col("v") - F.col("bar")).alias("delta")))


@query(
    PANEL + _ALL + """, d AS (SELECT a.key, a.nse - b.nse AS d FROM all_scores a JOIN all_scores b USING (key) WHERE a.kind = 'decay' AND b.kind = 'persistence'),
late AS (SELECT key, (lead_h - 1) // 12 AS bucket, 1 - sum((decay - obs) ** 2) / (var_pop(obs) * count(*)) AS a, 1 - sum((persistence - obs) ** 2) / (var_pop(obs) * count(*)) AS b FROM rows WHERE lead_h > 24 GROUP BY ALL HAVING var_pop(obs) * count(*) > 1e-10),
l AS (SELECT key, avg(a) - avg(b) AS late FROM late GROUP BY key)
SELECT count(*) AS n_pairs, round(avg(d), 6) AS mean_delta, round(avg(late), 6) AS mean_late, CASE WHEN count(*) >= 3 THEN avg(d) >= 0.02 AND bool_and(d > 0) AND avg(late) >= 0 END AS adopt FROM d LEFT JOIN l USING (key)"""
)
def adopt_rule(spark, sf_dir):
    """Is decay adopted over persistence, by all scores and by those of hours 25 to 48?"""
    rows = _rows(spark, sf_dir, "persistence", "decay")
    late = rows.where("lead_h > 24")
    whole, tail = None, None
    for k in ("decay", "persistence"):
        one = metrics.score(rows, k).select("key", F.col("nse").alias(k))
        two = metrics.score_buckets(late, k).groupBy("key").agg(F.avg("nse").alias(k))
        whole = one if whole is None else whole.join(one, "key")
        tail = two if tail is None else tail.join(two, "key")
    d = whole.select("key", (F.col("decay") - F.col("persistence")).alias("d"))
    pairs = d.join(tail.select("key", (F.col("decay") - F.col("persistence")).alias("late")), "key", "left")
    return rounded(reports.adopt(pairs))


@query("SELECT count(*) AS n, count(*) FILTER (value < 0) AS negative, count(*) FILTER (value = 0) AS zeros, count(*) FILTER (value IS NULL) AS missing, round(median(value), 6) AS median, round(avg(value), 6) AS mean, round(max(value), 6) AS largest FROM events")
def quality_checks(spark, sf_dir):
    v, events = F.col("value"), _table(spark, sf_dir, "events")
    counts = [F.count("*").alias("n"), F.count_if(v < 0).alias("negative"), F.count_if(v == 0).alias("zeros"), F.count_if(v.isNull()).alias("missing")]
    moments = events.agg(*counts, F.avg(v).alias("mean"), F.max(v).alias("largest"))
    median = selection.quantiles(events, [], "value", {"median": 0.5}).select("median")
    return rounded(moments.join(median, how="left"))  # one row each


@query("""WITH d AS (SELECT l_suppkey AS key, CAST(l_shipdate AS DATE) AS day, sum(l_extendedprice) AS q FROM lineitem GROUP BY ALL),
p AS (SELECT key, q AS obs, lag(q) OVER (PARTITION BY key ORDER BY day) AS p FROM d)
SELECT key, count(*) AS n_values, round(1 - sum((p - obs) ** 2) / (var_pop(obs) * count(*)), 6) AS nse, round(avg(abs(p - obs)), 4) AS mae FROM p WHERE p IS NOT NULL GROUP BY key HAVING count(*) > 1""")
def supplier_panel_score(spark, sf_dir):
    """The same scorer on another domain: a supplier's daily sales, forecast by the last day with sales."""
    days = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("key"), F.to_date("l_shipdate").alias("day")).agg(F.sum("l_extendedprice").alias("obs"))
    pairs = days.withColumn("p", F.lag("obs").over(Window.partitionBy("key").orderBy("day"))).where("p is not null")
    scored = metrics.score(pairs, "p").where("n_values > 1")
    return scored.select("key", "n_values", F.round("nse", 6).alias("nse"), F.round("mae", 4).alias("mae"))


@query("SELECT user_id, substr(sha256('{\"user\": ' || user_id || '}'), 1, 12) AS config_key FROM (SELECT DISTINCT user_id FROM events)")
def config_key(spark, sf_dir):
    """The content address of settings in canonical JSON text."""
    users = _table(spark, sf_dir, "events").select("user_id").distinct()
    layers = users.select(F.col("user_id").alias("id"), F.lit(1).alias("priority"), F.to_json(F.struct(F.lit(0).alias("unused"), F.col("user_id").alias("user"))).alias("config"))
    return configs.content_keys(layers, ["user"]).select(F.col("id").alias("user_id"), F.col("key").alias("config_key"))


@query(PANEL + """x AS (SELECT 1) SELECT key, round(avg((decay - obs) ** 2), 6) AS mse, round(avg(abs(decay - obs)), 6) AS mae,
  round(avg(CASE WHEN abs(decay - obs) <= 0.5 THEN (decay - obs) ** 2 / 2 ELSE 0.5 * (abs(decay - obs) - 0.25) END), 6) AS huber FROM rows GROUP BY key""")
def loss_means(spark, sf_dir):
    return rounded(compare.losses(_rows(spark, sf_dir, "decay"), "decay"))


@query(PANEL + "x AS (SELECT 1) SELECT key, round(1 - sum((decay - obs) ** 2) / (sum(obs * obs) - sum(obs) ** 2 / count(*)), 6) AS nse FROM rows GROUP BY key")
def quick_nse(spark, sf_dir):
    return rounded(compare.quick_nse(_rows(spark, sf_dir, "decay"), "decay"))


@query(
    PANEL + _GRAMS + """, n AS (SELECT g.key, g.origin, count(*) AS n FROM grams g JOIN held USING (key, origin) WHERE out AND EXISTS (FROM grams t JOIN held u USING (key, origin) WHERE NOT u.out AND t.key = g.key AND t.g = g.g) GROUP BY ALL),
flags AS (SELECT key, origin, coalesce(n, 0) >= 3 AS leaked FROM (SELECT DISTINCT key, origin FROM grams JOIN held USING (key, origin) WHERE out) LEFT JOIN n USING (key, origin)),
f AS (SELECT r.key, r.obs, r.decay, coalesce(leaked, true) AS seen FROM rows r LEFT JOIN flags ON flags.key = r.key AND flags.origin = r.origin)
SELECT seen, key, round(1 - sum((decay - obs) ** 2) / (var_pop(obs) * count(*)), 6) AS nse FROM f GROUP BY seen, key"""
)
def subset_nse(spark, sf_dir):
    return rounded(compare.subset_nse(_rows(spark, sf_dir, "decay"), leak_flags(spark, sf_dir), "decay"))


@query(
    PANEL + """d AS (SELECT key, origin, round(avg(abs(persistence - obs)) - avg(abs(decay - obs)), 9) AS d FROM rows GROUP BY ALL),
r AS (SELECT key, d, rank() OVER (PARTITION BY key ORDER BY abs(d)) + (count(*) OVER (PARTITION BY key, abs(d)) - 1) / 2.0 AS k, count(*) OVER (PARTITION BY key, abs(d)) AS t FROM d WHERE d <> 0),
g AS (SELECT key, count(*) AS n, coalesce(sum(k) FILTER (d > 0), 0.0) AS w, sum(t * t - 1) AS ties FROM r GROUP BY key)
SELECT key, n, round(w, 6) AS w_plus, round((w - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0), 6) AS z FROM g"""
)
def signed_rank(spark, sf_dir):
    """Are the windows' errors of persistence larger than those of decay?"""
    error = lambda k: F.avg(F.abs(F.col(k) - F.col("obs")))
    d = _rows(spark, sf_dir, "persistence", "decay").groupBy("key", "origin").agg(F.round(error("persistence") - error("decay"), 9).alias("d"))
    return rounded(compare.signed_rank(d))


@query("SELECT event_type AS key, count(value) AS n, round(avg(value), 6) AS mean, round(CASE WHEN stddev_pop(value) < 1e-6 THEN 1.0 ELSE stddev_pop(value) END, 6) AS std FROM events GROUP BY event_type")
def statistics_by_type(spark, sf_dir):
    return rounded(running_statistics(_table(spark, sf_dir, "events"), "event_type", "value"))


@query(
    PANEL + """m AS (SELECT key, avg(q) OVER w AS m, count(*) OVER w AS c, q, min(q) OVER (PARTITION BY key) AS lo, max(q) OVER (PARTITION BY key) AS hi FROM panel WINDOW w AS (PARTITION BY key ORDER BY h ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT key, round(max(m) FILTER (c = 3), 6) AS peak, count(*) FILTER (least(8, floor((q - lo) / (hi - lo + 1e-9) * 8)) >= 7) AS n_high FROM m GROUP BY key"""
)
def series_peaks(spark, sf_dir):
    series = _panel(spark, sf_dir).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("h", "q"))), lambda p: p["q"]).alias("s"))
    high = F.size(F.filter(spark_levels(F.col("s")), lambda v: v >= 7)).cast("long")
    return rounded(series.select("key", peak_of_means(F.col("s")).alias("peak"), high.alias("n_high")))


@query()
def ridge_scores(spark, sf_dir):
    """Ridge on the whole standardised history, scored on the windows it was fitted to; no SQL twin (a linear system is solved)."""
    windows = _windows(spark, sf_dir)
    fitted = ridge.with_ridge(windows, ridge.fit_ridge(windows, standardise=True))
    return rounded(metrics.score(long_targets(fitted, "ridge"), "ridge"))


@query(
    PANEL + """e AS (SELECT key, origin, h, q, lead(q) OVER w AS q1, lead(q, 2) OVER w AS q2, 0.2 * stddev_pop(q) OVER (PARTITION BY key, origin) AS r FROM history WINDOW w AS (PARTITION BY key, origin ORDER BY h)),
c AS (SELECT a.key, a.origin, count(*) AS b, count(*) FILTER (abs(a.q2 - z.q2) <= a.r) AS a FROM e a JOIN e z ON a.key = z.key AND a.origin = z.origin AND a.h <> z.h AND abs(a.q - z.q) <= a.r AND abs(a.q1 - z.q1) <= a.r GROUP BY ALL)
SELECT e.key, e.origin, round(CASE WHEN any_value(e.r) < 2e-9 THEN 0.0 WHEN coalesce(any_value(a), 0) = 0 THEN 3.0 ELSE least(3.0, ln(any_value(b) / any_value(a))) END, 6) AS entropy FROM e LEFT JOIN c ON c.key = e.key AND c.origin = e.origin GROUP BY e.key, e.origin"""
)
def sample_entropy_windows(spark, sf_dir):
    return rounded(_windows(spark, sf_dir).select("key", "origin", sample_entropy(F.col("x")).alias("entropy")))


@query()
def emd_identity(spark, sf_dir):
    """Do the plain modes and what is left sum to the window? No SQL twin (splines are iterated)."""
    windows = _windows(spark, sf_dir)
    parts = decompose.plain_modes(windows, ["key", "origin"]).groupBy("key", "origin").agg(F.count("*").alias("n_parts"), F.collect_list("part").alias("parts"))
    return windows.join(parts, ["key", "origin"]).select("key", "origin", "n_parts", (decompose.band_error(F.col("x"), F.col("parts")) < 1e-9).alias("exact"))


@query()
def mode_groups(spark, sf_dir):
    """Each window's noise-assisted modes in three bands, their entropies and the band of each branch; no SQL twin."""
    windows = _windows(spark, sf_dir)
    # a window is few bytes and much work, so the number of tasks is given, which keeps small ones apart
    spread = windows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "origin")
    found = decompose.decompose(spread, ["key", "origin"])
    scale = F.greatest(F.lit(1.0), F.array_max("x"))
    exact = decompose.band_error(F.col("x"), F.col("bands").cast("array<array<double>>")) < 1e-5 * scale
    return windows.join(found, ["key", "origin"]).select("key", "origin", "n_modes", "code", F.transform("band_entropy", lambda e: F.round(e, 4)).alias("band_entropy"), route_by_entropy(F.col("band_entropy"), 2).alias("high"), exact.alias("exact"))


@query("WITH e AS (SELECT vec_id, unnest(embedding[1:6]) AS v, unnest(range(6)) AS i FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS k FROM e) SELECT vec_id, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS high FROM r WHERE k <= 2 GROUP BY vec_id")
def route_bands(spark, sf_dir):
    """The two of six values that the routing rule sends to the fast branch."""
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(route_by_entropy(F.slice("embedding", 1, 6), 2).cast("array<string>"), ",").alias("high"))
