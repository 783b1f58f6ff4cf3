"""Queries of the whole scorer, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow.functions.forecasts import KINDS, with_forecasts
from gaugeflow.functions.series import patience, with_last_added
from gaugeflow.operators import compare, correlation, metrics, sampling, scorer, splits
from gaugeflow.plans.boards import _SAME, _flags
from gaugeflow.plans.catalogue import PANEL, _table, _windows, query, rounded
from gaugeflow.session import Scratch
from gaugeflow.sources.panel import hourly_series


def fixed_point(column: Column, kind: T.DataType, digits: int = 6) -> Column:
    """Doubles anywhere in a nested column as decimal text, so that equal documents are equal texts."""
    if isinstance(kind, T.DoubleType):
        return F.round(column, digits).cast(f"decimal(30,{digits})").cast("string")
    if isinstance(kind, T.StructType):
        return F.struct(*(fixed_point(column[f.name], f.dataType, digits).alias(f.name) for f in kind.fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: fixed_point(x, kind.elementType, digits))
    if isinstance(kind, T.MapType):
        return F.transform_values(column, lambda _, x: fixed_point(x, kind.valueType, digits))
    return column


_LONG = "long AS (" + " UNION ALL ".join(f"SELECT '{k}' AS model, key, origin, lead_h, obs, persistence AS bar, {k} AS p FROM rows" for k in KINDS) + ")"
_T = "CAST(CAST(round({0}, 6) AS DECIMAL(30, 6)) AS VARCHAR)"


def _text(sql: str) -> str:
    return _T.format(sql)


_NSE = "1 - sum(({p} - obs) ** 2) / (var_pop(obs) * count(*))"
_DOCUMENT = f"""{_LONG},
st AS (SELECT key, stddev_pop(q) AS std FROM history GROUP BY key),
bn AS (SELECT model, key, (lead_h - 1) // 12 AS b, {_NSE.format(p="p")} AS nse, {_NSE.format(p="bar")} AS nse_bar FROM long GROUP BY ALL HAVING var_pop(obs) * count(*) > 1e-10),
bm AS (SELECT model, b, median(nse) AS nse, median(nse_bar) AS nse_bar FROM bn GROUP BY model, b),
names AS (SELECT CAST(range AS BIGINT) AS b, 'h' || (12 * range + 1) || '-' || (12 * range + 12) AS name FROM range(4)),
hz AS (SELECT model, map_from_entries(list((name, {_text("nse")}) ORDER BY b)) AS horizon, map_from_entries(list((name, {_text("nse_bar")}) ORDER BY b)) AS horizon_bar FROM bm JOIN names USING (b) GROUP BY model),
kb AS (SELECT model, key, map_from_entries(list((name, {_text("nse")}) ORDER BY b)) AS horizon FROM bn JOIN names USING (b) GROUP BY ALL),
wh AS (SELECT model, key, count(*) // 48 AS n_samples, CASE WHEN var_pop(obs) * count(*) <= 1e-10 THEN 0.0 ELSE {_NSE.format(p="p")} END AS nse,
    CASE WHEN var_pop(obs) * count(*) <= 1e-10 THEN 0.0 ELSE {_NSE.format(p="bar")} END AS nse_bar,
    CASE WHEN stddev_pop(obs) <= 1e-10 OR stddev_pop(p) <= 1e-10 THEN 1.0 ELSE covar_pop(obs, p) / (stddev_pop(obs) * stddev_pop(p)) END AS kge_r,
    CASE WHEN stddev_pop(obs) <= 1e-10 THEN 1.0 ELSE stddev_pop(p) / stddev_pop(obs) END AS kge_alpha,
    CASE WHEN abs(avg(obs)) <= 1e-10 THEN 1.0 ELSE avg(p) / avg(obs) END AS kge_beta, sqrt(avg((p - obs) ** 2)) AS rmse, avg(abs(p - obs)) AS mae FROM long GROUP BY ALL),
k AS (SELECT *, 1 - sqrt((kge_r - 1) ** 2 + (kge_alpha - 1) ** 2 + (kge_beta - 1) ** 2) AS kge FROM wh),
cut AS (SELECT model, key, quantile_cont(obs, 2.0 / 3) AS cut, greatest(1, round_even(0.02 * count(*), 0)) AS top FROM long GROUP BY ALL),
rk AS (SELECT model, key, obs, p, row_number() OVER (PARTITION BY model, key ORDER BY obs DESC) AS ko, row_number() OVER (PARTITION BY model, key ORDER BY p DESC) AS kp FROM long),
tl AS (SELECT model, key, sum(p) FILTER (obs >= cut) / sum(obs) FILTER (obs >= cut) AS beta, 100 * (sum(p) FILTER (kp <= top) - sum(obs) FILTER (ko <= top)) / sum(obs) FILTER (ko <= top) AS fhv FROM rk JOIN cut USING (model, key) GROUP BY ALL),
ld AS (SELECT model, lead_h, 1 - sum((p - obs) ** 2 / std ** 2) / sum((bar - obs) ** 2 / std ** 2) AS v FROM long JOIN st USING (key) GROUP BY ALL),
sk AS (SELECT model, list({_text("v")} ORDER BY lead_h) AS skill FROM ld GROUP BY model),
fg AS (SELECT l.*, coalesce(input_seen, true) AS i, coalesce(target_seen, true) AS t FROM long l LEFT JOIN fl ON fl.key = l.key AND fl.origin = l.origin),
sb AS (SELECT 1 AS k, 'dev_clean' AS subset, * FROM fg WHERE NOT (i OR t) UNION ALL SELECT 2, 'dev_overlap', * FROM fg WHERE i OR t UNION ALL SELECT 3, 'dev_target_seen', * FROM fg WHERE t),
sn AS (SELECT model, k, subset, key, {_NSE.format(p="p")} AS nse FROM sb GROUP BY ALL HAVING var_pop(obs) * count(*) > 1e-10),
sm AS (SELECT model, k, subset, median(nse) AS nse FROM sn GROUP BY ALL),
su AS (SELECT model, map_from_entries(list((subset, {_text("nse")}) ORDER BY k)) AS subsets FROM sm GROUP BY model)
"""
_FIELDS = (
    ("n_basins", "count(*)"), ("n_basins_total", "count(*)"), ("n_samples", "CAST(sum(n_samples) AS BIGINT)"), ("median_nse", _text("median(nse)")), ("mean_nse", _text("avg(nse)")),
    ("std_nse", _text("stddev_pop(nse)")), ("mean_nse_clip", _text("avg(greatest(nse, -1))")), ("pct_nse_05", _text("100.0 * count(*) FILTER (nse > 0.5) / count(*)")),
    ("pct_nse_07", _text("100.0 * count(*) FILTER (nse > 0.7) / count(*)")), ("median_kge", _text("median(kge)")), ("mean_kge", _text("avg(kge)")), ("median_rmse", _text("median(rmse)")),
    ("median_mae", _text("median(mae)")), ("median_highflow_beta", _text("median(beta)")), ("median_fhv", _text("median(fhv)")), ("median_nse_persistence", _text("median(nse_bar)")),
    ("horizon_nse", "any_value(hz.horizon)"), ("horizon_nse_persistence", "any_value(hz.horizon_bar)"), ("skill_by_lead", "any_value(skill)"), ("subset_median_nse", "any_value(subsets)"),
)
_KEY = ", ".join(f"'{c}': " + ("k.n_samples" if c == "n_samples" else _text(f"k.{c}")) for c in ("n_samples", "nse", "kge", "kge_r", "kge_alpha", "kge_beta", "rmse", "mae"))
_PER_KEY = "list({'key': k.key, " + _KEY + ", 'horizon': kb.horizon} ORDER BY k.key)"


@query(
    PANEL + _SAME.rstrip() + ", " + _DOCUMENT + "SELECT k.model, CAST(to_json({" + ", ".join(f"'{n}': {e}" for n, e in _FIELDS) + ", 'per_basin': " + _PER_KEY + """}) AS VARCHAR) AS document
FROM k JOIN tl USING (model, key) LEFT JOIN kb ON kb.model = k.model AND kb.key = k.key LEFT JOIN hz ON hz.model = k.model LEFT JOIN sk ON sk.model = k.model LEFT JOIN su ON su.model = k.model GROUP BY k.model"""
)
def score_document(spark, sf_dir):
    """All scores of all baselines, each as one nested document in JSON; the rows are written once and scored from there."""
    scratch = Scratch(spark, "score-document")
    windows = _windows(spark, sf_dir)
    rows = scratch.table(scorer.baseline_rows(windows), "rows")
    scale = windows.select("key", F.explode("x").alias("q")).groupBy("key").agg(F.stddev_pop("q").alias("std"))
    flags = scratch.table(_flags(spark, sf_dir), "flags")
    tails = metrics.high_flow(rows, "pred", "model", "key")
    found = scorer.evaluate(rows, scratch.table(scale, "scale"), "dev", flags, tails)
    return documents_as_json(found)


def documents_as_json(found: DataFrame) -> DataFrame:
    return found.select("model", F.to_json(fixed_point(F.col("document"), found.schema["document"].dataType), {"ignoreNullFields": "false"}).alias("document"))


@query(
    PANEL + _LONG + f""", k AS (SELECT model, key, {_NSE.format(p="p")} AS nse, avg(abs(p - obs)) AS mae FROM long GROUP BY ALL), b AS (SELECT model, key, (lead_h - 1) // 12 AS b, {_NSE.format(p="p")} AS nse FROM long GROUP BY ALL HAVING var_pop(obs) * count(*) > 1e-10)
SELECT k.model, k.key, round(any_value(k.nse), 6) AS nse, round(any_value(mae), 6) AS mae, round(max(b.nse) FILTER (b = 0), 6) AS first_hours, round(max(b.nse) FILTER (b = 3), 6) AS last_hours FROM k LEFT JOIN b USING (model, key) GROUP BY k.model, k.key"""
)
def key_scores(spark, sf_dir):
    """The per-key part of the document as rows, for any number of keys: one scan, no written table."""
    found = scorer.key_scores(scorer.moments_cube(scorer.baseline_rows(_windows(spark, sf_dir)))).where("key is not null")
    bucket = lambda name: F.round(F.try_element_at("buckets", F.lit(name)), 6)
    return found.select("model", "key", F.round("whole.nse", 6).alias("nse"), F.round("whole.mae", 6).alias("mae"), bucket("h1-12").alias("first_hours"), bucket("h37-48").alias("last_hours"))


_USERS = """WITH seen AS (SELECT CAST(user_id AS VARCHAR) AS key, CAST(floor(epoch(ts - TIMESTAMP '2024-01-01') / 3600) AS BIGINT) AS h, sum(value) AS q FROM events GROUP BY ALL),
p AS (SELECT k.key, g.h, coalesce(s.q, 0.0) AS q FROM (SELECT DISTINCT key FROM seen) k CROSS JOIN (SELECT CAST(range AS BIGINT) AS h FROM range(720)) g LEFT JOIN seen s ON s.key = k.key AND s.h = g.h)
"""


@query(_USERS + "SELECT x.key AS a, y.key AS b, round(CASE WHEN stddev_pop(x.q) <= 1e-10 OR stddev_pop(y.q) <= 1e-10 THEN 0.0 ELSE covar_pop(x.q, y.q) / (stddev_pop(x.q) * stddev_pop(y.q)) END, 6) + 0.0 AS corr FROM p x JOIN p y ON x.h = y.h AND x.key < y.key GROUP BY x.key, y.key")
def correlation_matrix(spark, sf_dir):
    """How alike the hours of every two users are."""
    found = correlation.correlations(hourly_series(_table(spark, sf_dir, "events"), "user_id"))
    # rounded as doubles, as in the SQL; by decimal texts all pairs took a third longer
    return found.select("a", "b", (F.rint(F.col("corr") * 1e6) / 1e6 + 0.0).alias("corr"))


@query(
    PANEL + """t AS (SELECT h, sum(q) AS q FROM panel GROUP BY h),
c AS (SELECT key, stddev_pop(p.q) AS deviation, sqrt(avg(p.q * p.q)) AS rms, CASE WHEN stddev_pop(p.q) <= 1e-10 OR stddev_pop(t.q) <= 1e-10 THEN 0.0 ELSE covar_pop(p.q, t.q) / (stddev_pop(p.q) * stddev_pop(t.q)) END AS corr FROM panel p JOIN t USING (h) GROUP BY key),
w AS (SELECT *, abs(corr) * deviation AS weight FROM c), r AS (SELECT *, row_number() OVER (ORDER BY weight DESC, key) AS k, sum(weight) OVER () AS total FROM w)
SELECT key, round(corr, 6) AS corr, round(rms, 6) AS rms, round(deviation, 6) AS deviation, round(weight, 6) AS weight, round(weight / total, 6) AS share, CAST(CASE WHEN k <= 2 THEN k END AS INTEGER) AS rank, round(sum(weight) FILTER (k <= 2) OVER () / total, 6) AS top_share FROM r"""
)
def energy_shares(spark, sf_dir):
    """What part of the whole's variation each type of events holds, and the two that hold most."""
    events = _table(spark, sf_dir, "events")
    whole = hourly_series(events.withColumn("key", F.lit("*")), "key")
    return rounded(correlation.energy_shares(hourly_series(events).unionByName(whole), "*"))


@query(
    PANEL + _LONG + f""", hk AS (SELECT key, row_number() OVER (ORDER BY md5('42:' || key), key) <= greatest(1, round_even(count(*) OVER () * 0.4, 0)) AS held FROM (SELECT DISTINCT key FROM panel)),
k AS (SELECT model, key, {_NSE.format(p="p")} AS nse FROM long GROUP BY ALL)
SELECT model, NOT held AS known, count(*) AS n_keys, round(median(nse), 6) AS median_nse FROM k JOIN hk USING (key) GROUP BY ALL"""
)
def known_and_unseen(spark, sf_dir):
    """Median scores of the keys that a split leaves in training and of those that it holds out."""
    rows = scorer.baseline_rows(_windows(spark, sf_dir))
    scores = scorer.key_scores(scorer.moments_cube(rows)).where("key is not null").select("model", "key", F.col("whole.nse").alias("nse"))
    sides = splits.hold_out_keys(_windows(spark, sf_dir), "key", 0.4)
    return rounded(scorer.known_and_unseen(scores, sides.where("not held_out")))


@query(PANEL + "s AS (SELECT key, 1 - sum((decay - obs) ** 2) / (sum(obs * obs) - sum(obs) ** 2 / count(*)) AS nse FROM rows GROUP BY key) SELECT round(coalesce(median(nse), 0.0), 6) AS median_nse FROM s")
def quick_median(spark, sf_dir):
    """The one figure that training watches: the median of the quick scores, 0 without any."""
    scored = compare.quick_nse(compared_rows(spark, sf_dir), "decay")
    return rounded(scored.agg(F.coalesce(F.median("nse"), F.lit(0.0)).alias("median_nse")))


def compared_rows(spark, sf_dir) -> DataFrame:
    rows = scorer.baseline_rows(_windows(spark, sf_dir), ("decay",))
    return rows.select("key", "origin", "lead_h", "obs", F.col("pred").alias("decay"))


@query("SELECT event_type AS key, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5('7:' || event_id), event_id) AS k FROM events) WHERE k <= 200")
def sampled_events(spark, sf_dir):
    """A sampling operator: 200 events of each type, the same in every run."""
    events = _table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), "event_id", "value")
    return sampling.sample_exactly(events, "event_id", 200, 7, ["key"])


@query("WITH u AS (SELECT DISTINCT user_id FROM events ORDER BY user_id LIMIT 20) SELECT user_id AS key, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE user_id IN (FROM u)) WHERE k <= 15")
def first_events(spark, sf_dir):
    """A capped scan as a report asks for it: the first 15 events of the first 20 users."""
    return sampling.first_rows(_table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id"), 20, 15, "event_id")


@query("WITH c AS (SELECT s_suppkey AS key, count(l_suppkey) AS n FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey) SELECT count(*) AS n_expected, count(*) FILTER (n > 0) AS n_covered, (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)) AS n_unknown FROM c")
def supplier_coverage(spark, sf_dir):
    suppliers = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"))
    return sampling.coverage(_table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key")), suppliers)


@query("WITH c AS (SELECT least(l_linenumber, 9) AS code, count(*) AS n FROM lineitem GROUP BY ALL) SELECT CAST(range AS BIGINT) AS code, coalesce(n, 0) AS n FROM range(10) LEFT JOIN c ON c.code = range")
def line_histogram(spark, sf_dir):
    return sampling.code_histogram(_table(spark, sf_dir, "lineitem").select(F.least("l_linenumber", F.lit(9)).alias("code")), "code", 10)


@query(PANEL + "d AS (SELECT key, origin, lead_h, persistence + (decay - persistence) AS added FROM rows) SELECT key, round(avg(added), 6) AS mean, CAST(greatest(5, 48 // 2) AS INTEGER) AS waits FROM d GROUP BY key")
def residual_forecasts(spark, sf_dir):
    """Forecasts of differences with the last value added back; the patience of a schedule of 48 steps."""
    windows = with_forecasts(_windows(spark, sf_dir), "decay").withColumn("last", F.element_at("x", -1))
    residual = F.transform("decay", lambda v: v - F.col("last"))
    added = windows.withColumn("residual", residual).select("key", F.explode(with_last_added(F.col("residual"), F.col("last"))).alias("added"))
    waits = patience(F.lit(5), F.lit(48), F.lit(True)).alias("waits")
    return rounded(added.groupBy("key").agg(F.avg("added").alias("mean")).select("key", "mean", waits))
