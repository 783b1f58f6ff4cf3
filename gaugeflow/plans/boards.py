"""Queries for splits, reports over runs, ensembles and diagnoses, with the DuckDB SQL that must give the same rows.

The tables hold no runs of experiments, so these queries derive them from ``supplier`` by ``RUN``, expressions
that both dialects share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.functions.forecasts import KINDS
from gaugeflow.operators import compare, diagnostics, metrics, reports, splits
from gaugeflow.plans.catalogue import _GRAMS, PANEL, _panel, _rows, _table, _windows, query, rounded
from gaugeflow.sources.panel import long_targets

_THIRD = "CAST(floor(s_suppkey / 3) AS BIGINT)"
RUN = {
    "arm": f"concat('exp_', lpad(concat('', {_THIRD}), 4, '0'))",
    "seed": "CASE s_suppkey % 3 WHEN 1 THEN 123 WHEN 2 THEN 177 ELSE 42 END",
    "run": f"concat('exp_', lpad(concat('', {_THIRD}), 4, '0'), CASE s_suppkey % 3 WHEN 1 THEN '_s123' WHEN 2 THEN '_s177' ELSE '' END)",
    "state": "CASE s_suppkey % 11 WHEN 0 THEN 'empty' WHEN 1 THEN 'corrupt' WHEN 2 THEN 'running' ELSE 'done' END",
    "dev": "CASE WHEN s_suppkey % 13 <> 0 THEN s_acctbal / 1e4 END",
    "sanval": "s_acctbal / 1e4 + (s_suppkey * 37 % 100 - 50) / 1e3",
    "test": "CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal / 1e4 + (s_suppkey * 53 % 100 - 40) / 1e3 END",
    "h1_12": "s_acctbal / 1e4 + 0.1e0",
    "h37_48": "CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal / 1e4 - s_suppkey * 29 % 50 / 1e2 END",
    "grad_norm": "s_suppkey * 17 % 300 / 1e2",
    "clip": "CASE WHEN s_suppkey % 4 = 0 THEN 0e0 ELSE 1e0 END",
}
RUNS = "WITH runs AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in RUN.items()) + " FROM supplier)"
DONE = "state = 'done' AND {m} IS NOT NULL"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "supplier").selectExpr(*(f"{e} AS {n}" for n, e in RUN.items()))


_BOARD = """ SELECT row_number() OVER (ORDER BY {m} DESC NULLS LAST, run) AS place, run, round({m}, 6) AS value, round({m} - 0.5, 6) AS delta,
  CASE WHEN {m} - 0.5 > 0.01 THEN 'better' WHEN {m} - 0.5 < -0.01 THEN 'worse' WHEN {m} IS NOT NULL THEN 'level' END AS class FROM runs WHERE {w}"""


@query(RUNS + _BOARD.format(m="dev", w=DONE.format(m="dev")))
def run_scoreboard(spark, sf_dir):
    return rounded(reports.board(reports.finished(_runs(spark, sf_dir), "dev"), "dev", 0.5))


@query(RUNS + _BOARD.format(m="h37_48", w="state = 'done'"))
def run_horizon_board(spark, sf_dir):
    return rounded(reports.board(_runs(spark, sf_dir).where("state = 'done'"), "h37_48", 0.5))


@query(RUNS + " SELECT run, round(dev - sanval, 6) AS gap, CASE WHEN dev - sanval > 0.02 THEN 'higher' WHEN dev - sanval < -0.02 THEN 'lower' ELSE 'agrees' END AS verdict, CASE WHEN clip > 0 AND grad_norm > clip THEN 'clips always' WHEN clip > 0 AND grad_norm < 0.1 * clip THEN 'never clips' END AS gradient FROM runs WHERE " + DONE.format(m="dev"))
def gap_audit(spark, sf_dir):
    return rounded(reports.gap_audit(_runs(spark, sf_dir)))


@query(RUNS + ", s AS (SELECT unnest(range(5)) AS position, unnest(['running', 'done', 'empty', 'corrupt', 'unknown']) AS state) SELECT CAST(position AS INTEGER) AS position, s.state, count(run) AS n FROM s LEFT JOIN runs ON runs.state = s.state GROUP BY ALL")
def run_inventory(spark, sf_dir):
    return reports.inventory(_runs(spark, sf_dir))


@query(RUNS + ", u AS (FROM (SELECT run, dev, sanval, test, grad_norm FROM runs WHERE state = 'done') UNPIVOT (value FOR field IN (dev, sanval, test, grad_norm))) SELECT run, field, round(value, 6) AS value FROM u")
def run_detail(spark, sf_dir):
    return rounded(reports.detail(_runs(spark, sf_dir).where("state = 'done'"), "dev", "sanval", "test", "grad_norm"))


@query(RUNS + " SELECT arm, round(max(dev) FILTER (seed = 42), 6) AS s42, round(max(dev) FILTER (seed = 123), 6) AS s123, round(max(dev) FILTER (seed = 177), 6) AS s177, round(avg(dev), 6) AS mean, count(*) AS n FROM runs WHERE " + DONE.format(m="dev") + " GROUP BY arm")
def seed_table(spark, sf_dir):
    return rounded(reports.seed_table(_runs(spark, sf_dir), "dev", (42, 123, 177)))


@query(RUNS + ", b AS (SELECT avg(dev) AS m, stddev_samp(dev) AS sd FROM runs WHERE state = 'done' AND dev IS NOT NULL AND arm = 'exp_0001') SELECT run, round(CASE WHEN sd > 0 THEN (dev - m) / sd END, 6) AS z FROM runs, b WHERE state = 'done' AND dev IS NOT NULL")
def seed_noise(spark, sf_dir):
    return rounded(reports.seed_noise(_runs(spark, sf_dir), "dev", "exp_0001"))


@query(RUNS + " SELECT run, round(dev, 6) AS dev, round(test, 6) AS test, round(test - dev, 6) AS change FROM runs WHERE state = 'done' AND dev IS NOT NULL AND test IS NOT NULL")
def dev_against_test(spark, sf_dir):
    """The runs that have both read-outs; names are cut to four digits, so runs may share one, and each is a row of its own."""
    both = reports.finished(reports.finished(_runs(spark, sf_dir), "dev"), "test")
    return rounded(both.select("run", "dev", "test", (F.col("test") - F.col("dev")).alias("change")))


@query(RUNS + ", d AS (SELECT * FROM runs WHERE state = 'done' AND dev IS NOT NULL) SELECT max_by(run, dev) AS best, round(max(dev) - max(dev) FILTER (run = 'exp_0001'), 6) AS delta FROM d")
def best_against_baseline(spark, sf_dir):
    done = reports.finished(_runs(spark, sf_dir), "dev")
    bar = F.max(F.when(F.col("run") == "exp_0001", F.col("dev")))
    return rounded(done.agg(F.max_by("run", "dev").alias("best"), (F.max("dev") - bar).alias("delta")))


@query(
    RUNS + """, d AS (SELECT arm, CAST(substr(arm, 5) AS BIGINT) AS k, dev, CASE WHEN seed = 42 AND h37_48 IS NOT NULL THEN (h1_12 + dev + h37_48) / 3 END AS early FROM runs WHERE seed = 42 AND state = 'done' AND dev IS NOT NULL)
SELECT a.arm, round(a.dev - b.dev, 6) AS delta, CASE WHEN a.early IS NOT NULL AND b.early IS NOT NULL THEN a.dev - b.dev >= 0.01 AND a.early > b.early END AS passes FROM d a JOIN d b ON a.k = b.k + 1"""
)
def gate_rule(spark, sf_dir):
    """Does each arm pass the gate against the arm before it? The skills of the first hours are three of a run's figures."""
    done = reports.finished(_runs(spark, sf_dir), "dev").where("seed = 42")
    skill = F.when(F.col("h37_48").isNotNull(), F.array("h1_12", "dev", "h37_48"))
    d = done.select("arm", F.substring("arm", 5, 10).cast("long").alias("k"), "dev", reports.early_skill(skill).alias("early"))
    b = d.select((F.col("k") + 1).alias("k"), F.col("dev").alias("dev_b"), F.col("early").alias("early_b"))
    delta = F.col("dev") - F.col("dev_b")
    return rounded(d.join(b, "k").select("arm", delta.alias("delta"), reports.gate(delta, F.col("early"), F.col("early_b")).alias("passes")))


@query(RUNS + " SELECT run, CASE WHEN CAST(substr(arm, 5) AS BIGINT) % 2 = 0 THEN concat('Arm ', substr(arm, 5), CASE seed WHEN 42 THEN '' ELSE concat(' seed ', seed) END) ELSE run END AS label FROM runs")
def run_labels(spark, sf_dir):
    """Every second arm has a label; other runs keep their names."""
    runs = _runs(spark, sf_dir)
    names = runs.where(F.substring("arm", 5, 10).cast("long") % 2 == 0).select(F.col("arm").alias("name"), F.concat(F.lit("Arm "), F.substring("arm", 5, 10)).alias("label")).distinct()
    return reports.labelled(runs, names)


_ASKED = "SELECT DISTINCT substr(run, 5, 3 + s % 7) AS asked FROM (SELECT run, length(run) + CAST(substr(run, 5, 4) AS INT) AS s FROM runs) r WHERE substr(run, 5, 3 + s % 7) <> ''"


@query(RUNS + f", asked AS ({_ASKED} UNION SELECT 'exp_0003_s123' UNION SELECT 'no such run'), m AS (SELECT asked, run, row_number() OVER (PARTITION BY asked ORDER BY run IS NOT NULL AND run <> asked, run) AS k FROM asked LEFT JOIN runs ON contains(run, asked)) SELECT asked, run FROM m WHERE k = 1")
def run_lookup(spark, sf_dir):
    """Names, and parts of names, as somebody would ask for them."""
    runs = _runs(spark, sf_dir)
    s = (F.length("run") + F.substring("run", 5, 4).cast("int")) % 7
    parts = runs.select(F.col("run").substr(F.lit(5), 3 + s).alias("asked")).where("asked <> ''")
    asked = parts.union(spark.createDataFrame([("exp_0003_s123",), ("no such run",)], "asked string")).distinct()
    return reports.lookup(runs, asked)


@query(
    """WITH g AS (SELECT s_suppkey AS entry, concat('exp_', s_suppkey % 60) AS name, s_suppkey AS k, round(s_acctbal / 1e3, 1) AS v FROM supplier),
o AS (SELECT entry, name, 'lr' AS key, CASE WHEN k % 4 = 0 THEN '0.001' ELSE concat('', v) END AS text FROM g WHERE k % 5 <> 0
  UNION ALL SELECT entry, name, 'residual', CASE WHEN k % 3 = 0 THEN 'False' ELSE 'true' END FROM g WHERE k % 5 <> 0 AND k % 2 = 0
  UNION ALL SELECT entry, name, 'typo', '1' FROM g WHERE k % 5 <> 0 AND k % 17 = 1)
SELECT name, 'duplicate name' AS problem, NULL AS key FROM g GROUP BY name HAVING count(*) > 1
UNION ALL SELECT name, 'no overrides', NULL FROM g WHERE k % 5 = 0 AND name <> 'exp_0'
UNION ALL SELECT name, 'unknown key', 'typo' FROM o WHERE key = 'typo' AND name <> 'exp_0'
UNION ALL SELECT name, 'nothing differs', NULL FROM o WHERE name <> 'exp_0' GROUP BY entry, name HAVING bool_and((key = 'lr' AND TRY_CAST(text AS DOUBLE) = 0.001) OR (key = 'residual' AND lower(text) = 'false'))"""
)
def grid_problems(spark, sf_dir):
    """A grid of settings with all the faults that the rules look for."""
    k, v = F.col("s_suppkey"), F.round(F.col("s_acctbal") / 1e3, 1).cast("string")
    given = F.map_from_entries(F.array_compact(F.array(
        F.struct(F.lit("lr").alias("key"), F.when(k % 4 == 0, "0.001").otherwise(v).alias("text")),
        F.when(k % 2 == 0, F.struct(F.lit("residual").alias("key"), F.when(k % 3 == 0, "False").otherwise("true").alias("text"))),
        F.when(k % 17 == 1, F.struct(F.lit("typo").alias("key"), F.lit("1").alias("text"))),
    )))
    overrides = F.when(k % 5 == 0, F.create_map().cast("map<string,string>")).otherwise(given)
    grid = _table(spark, sf_dir, "supplier").select(k.alias("entry"), F.concat(F.lit("exp_"), (k % 60).cast("string")).alias("name"), overrides.alias("overrides"))
    defaults = spark.createDataFrame([("lr", "0.001"), ("residual", "false")], "key string, default string")
    return reports.grid_problems(grid, defaults, "exp_0")


@query(
    PANEL + "b AS (SELECT 'decay' AS kind, key, (lead_h - 1) // 12 AS bucket, 1 - sum((decay - obs) ** 2) / (var_pop(obs) * count(*)) AS nse FROM rows GROUP BY ALL UNION ALL SELECT 'persistence', key, (lead_h - 1) // 12, 1 - sum((persistence - obs) ** 2) / (var_pop(obs) * count(*)) FROM rows GROUP BY ALL) SELECT kind, bucket, round(median(nse), 6) AS median_nse FROM b GROUP BY ALL"
)
def lead_table(spark, sf_dir):
    """A long table of lead buckets with persistence appended."""
    rows = _rows(spark, sf_dir, "persistence", "decay")
    one, two = (metrics.score_buckets(rows, k).withColumn("kind", F.lit(k)) for k in ("decay", "persistence"))
    return rounded(one.unionByName(two).groupBy("kind", "bucket").agg(F.median("nse").alias("median_nse")))


_HOURS = (1, 6, 12, 24, 48)


@query(
    PANEL + "s AS (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, lead_h, 1 - sum(({k} - obs) ** 2) / sum((persistence - obs) ** 2) AS skill FROM rows GROUP BY lead_h" for k in KINDS[1:]) + ") SELECT kind, " + ", ".join(f"round(max(greatest(skill, -3)) FILTER (lead_h = {h}), 6) AS h{h}" for h in _HOURS) + " FROM s GROUP BY kind"
)
def skill_table(spark, sf_dir):
    """Skill by hour as a wide table, clipped at -3."""
    rows = _rows(spark, sf_dir)
    long = None
    for k in KINDS[1:]:
        one = metrics.skill_by_lead(rows, k).select(F.lit(k).alias("kind"), "lead_h", F.greatest("skill", F.lit(-3.0)).alias("skill"))
        long = one if long is None else long.union(one)
    wide = long.groupBy("kind").pivot("lead_h", list(_HOURS)).agg(F.max("skill"))
    return rounded(wide.select("kind", *(F.col(str(h)).alias(f"h{h}") for h in _HOURS)))


@query(
    PANEL + """d AS (SELECT key, h // 24 AS day, sum(q) AS v FROM panel GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY day) - 1 AS i, lead(v) OVER (PARTITION BY key ORDER BY day) - v AS step FROM d)
SELECT key, round(avg(v) FILTER (i >= 25), 5) AS late, round(regr_slope(v, i) FILTER (i >= 20), 5) AS slope, round(stddev_samp(step) FILTER (i >= 15), 5) AS jitter FROM n GROUP BY key"""
)
def curve_diagnostics(spark, sf_dir):
    """The daily sums of each key as a curve."""
    days = _panel(spark, sf_dir).groupBy("key", F.expr("h div 24").alias("day")).agg(F.sum("q").alias("v"))
    curves = days.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "v"))), lambda s: s["v"]).alias("v"))
    return rounded(curves.select("key", *diagnostics.curve_diagnostics(F.col("v"))), 5)


_ASSIGNED = """WITH c AS (SELECT event_type AS key, user_id AS component, count(*) AS size FROM events GROUP BY ALL),
r AS (SELECT *, sum(size) OVER (PARTITION BY key) AS total, min(size) OVER (PARTITION BY key) AS least, row_number() OVER (PARTITION BY key ORDER BY size, component) AS k,
  sum(size) OVER (PARTITION BY key ORDER BY size, md5('42:' || component), component ROWS UNBOUNDED PRECEDING) AS reached FROM c),
a AS (SELECT key, component, size, (reached <= floor(total * 0.24) AND reached - size < round_even(total * 0.12, 0)) OR (least > floor(total * 0.24) AND k = 1 AND round_even(total * 0.12, 0) > 0) AS held_out FROM r)
"""


@query(_ASSIGNED + "SELECT * FROM a")
def component_split(spark, sf_dir):
    """Whole users as components of each event type."""
    rows = _table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("component"))
    return splits.assign_components(rows, 0.12)


@query(_ASSIGNED + "SELECT key, CAST(sum(size) AS BIGINT) AS n_rows, CAST(coalesce(sum(size) FILTER (held_out), 0) AS BIGINT) AS n_held, round(coalesce(sum(size) FILTER (held_out), 0) / sum(size), 6) AS share, count(*) AS n_components, max(size) AS largest FROM a GROUP BY key")
def split_statistics(spark, sf_dir):
    return rounded(splits.split_statistics(component_split(spark, sf_dir)))


_FLAGS = (
    _GRAMS
    + """, ty AS (SELECT key, origin, list(obs + 0.0) OVER (PARTITION BY key, origin ORDER BY lead_h ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS g FROM targets),
gy AS (SELECT DISTINCT key, origin, g FROM ty WHERE len(g) = 6 AND len(list_distinct(g)) >= 3),
tr AS (SELECT DISTINCT {k}g FROM (SELECT key, origin, g FROM grams UNION ALL SELECT key, origin, g FROM gy) JOIN held USING (key, origin) WHERE NOT out),
e AS (SELECT key, origin, g, 'x' AS part FROM grams UNION ALL SELECT key, origin, g, 'y' FROM gy),
fl AS (SELECT e.key, e.origin, count(*) FILTER (part = 'x' AND tr.g IS NOT NULL) >= 3 AS input_seen, count(*) FILTER (part = 'y' AND tr.g IS NOT NULL) >= 3 AS target_seen FROM e JOIN held ON held.key = e.key AND held.origin = e.origin AND out LEFT JOIN tr ON {j}tr.g = e.g GROUP BY e.key, e.origin)
"""
)
_SAME = _FLAGS.format(k="key, ", j="tr.key = e.key AND ")


def _flags(spark, sf_dir, same_key: bool = True) -> DataFrame:
    windows = _windows(spark, sf_dir)
    held = splits.hold_out_within(windows, "key", "origin", 0.2).withColumnRenamed("id", "origin")
    x, y = (splits.grams(windows, c).join(held, ["key", "origin"]) for c in "xy")
    known = x.where("not held_out").unionByName(y.where("not held_out"))
    return splits.seen_flags(known, x.where("held_out"), y.where("held_out"), same_key=same_key)


@query(PANEL + _SAME + "SELECT * FROM fl")
def seen_flags(spark, sf_dir):
    return _flags(spark, sf_dir)


@query(PANEL + _FLAGS.format(k="", j="") + "SELECT * FROM fl")
def seen_flags_any_key(spark, sf_dir):
    return _flags(spark, sf_dir, same_key=False)


@query(PANEL + _SAME + "SELECT key, count(*) AS n, count(*) FILTER (input_seen) AS n_input, count(*) FILTER (target_seen) AS n_target, round(avg(CAST(input_seen OR target_seen AS INT)), 6) AS rate FROM fl GROUP BY key")
def leak_rates(spark, sf_dir):
    return rounded(splits.leak_rates(_flags(spark, sf_dir)))


@query(
    PANEL + _SAME + """, f AS (SELECT r.key, r.obs, r.decay, coalesce(input_seen, true) AS i, coalesce(target_seen, true) AS t FROM rows r LEFT JOIN fl ON fl.key = r.key AND fl.origin = r.origin),
sub AS (SELECT *, 'clean' AS subset FROM f WHERE NOT (i OR t) UNION ALL SELECT *, 'overlap' FROM f WHERE i OR t UNION ALL SELECT *, 'target_seen' FROM f WHERE t),
m AS (SELECT subset, key, 1 - sum((decay - obs) ** 2) / (var_pop(obs) * count(*)) AS nse FROM sub GROUP BY ALL HAVING var_pop(obs) * count(*) > 1e-10)
SELECT v.subset, count(m.key) AS n_keys, round(median(m.nse), 6) AS median_nse FROM (SELECT unnest(['clean', 'overlap', 'target_seen']) AS subset) v LEFT JOIN m USING (subset) GROUP BY v.subset"""
)
def subset_medians(spark, sf_dir):
    return rounded(compare.subset_medians(_rows(spark, sf_dir, "decay"), _flags(spark, sf_dir), "decay"))


@query(
    PANEL + """d AS (SELECT key, origin, round(avg(abs(persistence - obs)) - avg(abs(decay - obs)), 9) AS d FROM rows GROUP BY ALL),
r AS (SELECT key, d, rank() OVER (PARTITION BY key ORDER BY abs(d)) + (count(*) OVER (PARTITION BY key, abs(d)) - 1) / 2.0 AS k, count(*) OVER (PARTITION BY key, abs(d)) AS t FROM d WHERE d <> 0),
g AS (SELECT key, count(*) AS n, coalesce(sum(k) FILTER (d > 0), 0.0) AS w, sum(t * t - 1) AS ties FROM r GROUP BY key),
z AS (SELECT *, (w - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0) AS z FROM g),
u AS (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS t FROM z),
v AS (SELECT *, exp(-z * z / 2) / 2.5066282746310002 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))) AS upper FROM u)
SELECT key, n, round(w, 6) AS w_plus, round(CASE WHEN z >= 0 THEN upper ELSE 1 - upper END, 6) AS p_value, 'rank' AS test FROM v"""
)
def significance(spark, sf_dir):
    error = lambda k: F.avg(F.abs(F.col(k) - F.col("obs")))
    d = _rows(spark, sf_dir, "persistence", "decay").groupBy("key", "origin").agg(F.round(error("persistence") - error("decay"), 9).alias("d"))
    return rounded(compare.significance(d))


@query(PANEL + "x AS (SELECT 1) SELECT key, origin, lead_h, round((persistence + climatology + decay) / 3, 6) AS p FROM rows")
def ensemble_members(spark, sf_dir):
    """Members as rows, each of which has to cover the same ids."""
    rows = _rows(spark, sf_dir, "persistence", "climatology", "decay")
    names = ("persistence", "climatology", "decay")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("member"), F.col(k).alias("p")) for k in names))).alias("m")
    members = rows.select(F.struct("key", "origin").alias("id"), "lead_h", each).select("m.member", "id", "lead_h", "m.p")
    return rounded(reports.ensemble(members, len(names)).select("id.key", "id.origin", "lead_h", "p"))


@query(PANEL + "a AS (SELECT key, avg(q) AS m, stddev_pop(q) AS s FROM history GROUP BY key), b AS (SELECT key, avg(q) AS m, stddev_pop(q) AS s FROM panel GROUP BY key) SELECT key FROM a FULL JOIN b USING (key) WHERE NOT coalesce(abs(a.m - b.m) <= 1e-6 + 1e-5 * abs(b.m) AND abs(a.s - b.s) <= 1e-6 + 1e-5 * abs(b.s), false)")
def normalizer_differences(spark, sf_dir):
    """The statistics of the windows against those of the panel."""
    stats = lambda df: df.groupBy("key").agg(F.avg("q").alias("mean"), F.stddev_pop("q").alias("std"))
    history = _windows(spark, sf_dir).select("key", F.explode("x").alias("q"))
    return reports.normalizer_differences(stats(history), stats(_panel(spark, sf_dir)))


_SKILL = "count(*) AS n, round(1 - sum((decay - obs) ** 2) / sum((persistence - obs) ** 2), 6) AS skill, round(avg(decay - obs), 6) AS bias"


@query(
    PANEL + f"""s AS (SELECT key, stddev_pop(q) AS std FROM panel GROUP BY key), w AS (SELECT key, origin, (avg(obs) - any_value(persistence)) / any_value(std) AS moved FROM rows JOIN s USING (key) GROUP BY ALL)
SELECT CASE WHEN abs(moved) < 0.25 THEN 'steady' WHEN moved > 0 THEN 'rising' ELSE 'falling' END AS regime, {_SKILL} FROM rows JOIN w USING (key, origin) GROUP BY regime"""
)
def flow_regimes(spark, sf_dir):
    scale = _panel(spark, sf_dir).groupBy("key").agg(F.stddev_pop("q").alias("std"))
    return rounded(diagnostics.by_regime(_rows(spark, sf_dir, "persistence", "decay"), scale, "decay"))


@query(PANEL + f"c AS (SELECT key, quantile_cont(obs, 1.0 / 3) AS lo, quantile_cont(obs, 2.0 / 3) AS hi FROM rows GROUP BY key) SELECT CASE WHEN obs <= lo THEN 'low' WHEN obs >= hi THEN 'high' ELSE 'middle' END AS tercile, {_SKILL} FROM rows JOIN c USING (key) GROUP BY tercile")
def flow_terciles(spark, sf_dir):
    return rounded(diagnostics.by_tercile(_rows(spark, sf_dir, "persistence", "decay"), "decay"))


@query(PANEL + "s AS (SELECT key, sum((decay - obs) ** 2) AS a, sum((persistence - obs) ** 2) AS b, var_pop(obs) * count(*) AS oo FROM rows GROUP BY key) SELECT count(*) AS n, count(*) FILTER (1 - a / oo < 1 - b / oo) AS worse, round(avg(CAST(1 - a / oo < 1 - b / oo AS INT)), 6) AS share FROM s")
def worse_than_persistence(spark, sf_dir):
    rows = _rows(spark, sf_dir, "persistence", "decay")
    a, b = (metrics.score(rows, k).select("key", F.col("nse").alias(k)) for k in ("decay", "persistence"))
    worse = F.col("decay") < F.col("persistence")
    return rounded(a.join(b, "key").agg(F.count("*").alias("n"), F.count_if(worse).alias("worse"), F.avg(worse.cast("int")).alias("share")))


@query(PANEL + "e AS (SELECT round(abs(decay - obs), 6) AS e, row_number() OVER (ORDER BY round(abs(decay - obs), 6) DESC) AS k, count(*) OVER () AS n FROM rows), s AS (SELECT unnest([0.001, 0.01, 0.05]) AS share) SELECT CAST(share AS DOUBLE) AS share, round(sum(e * e) FILTER (k <= greatest(1, round_even(share * n, 0))) / sum(e * e), 6) AS squared, round(sum(e) FILTER (k <= greatest(1, round_even(share * n, 0))) / sum(e), 6) AS absolute FROM e, s GROUP BY share")
def error_concentration(spark, sf_dir):
    return rounded(diagnostics.error_concentration(_rows(spark, sf_dir, "decay"), "decay"))


@query(RUNS + ", d AS (SELECT dev, test FROM runs WHERE state = 'done' AND dev IS NOT NULL AND test IS NOT NULL), r AS (SELECT rank() OVER (ORDER BY dev) + (count(*) OVER (PARTITION BY dev) - 1) / 2.0 AS a, rank() OVER (ORDER BY test) + (count(*) OVER (PARTITION BY test) - 1) / 2.0 AS b FROM d) SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r")
def rank_agreement(spark, sf_dir):
    return rounded(diagnostics.rank_agreement(_runs(spark, sf_dir).where("state = 'done'"), "dev", "test"))


@query(PANEL + "c AS (SELECT key, h, q - avg(q) OVER (PARTITION BY key) >= 0 AS up FROM panel), d AS (SELECT key, up <> lag(up) OVER (PARTITION BY key ORDER BY h) AS x FROM c) SELECT key, count(*) AS n, count(*) FILTER (x) AS crossings, round(CASE WHEN count(*) FILTER (x) > 0 THEN 2 * count(*) / count(*) FILTER (x) END, 6) AS mean_period FROM d GROUP BY key")
def zero_crossings(spark, sf_dir):
    panel = _panel(spark, sf_dir)
    mean = panel.groupBy("key").agg(F.avg("q").alias("mean"))
    centred = panel.join(mean, "key").select("key", "h", (F.col("q") - F.col("mean")).alias("v"))
    return rounded(diagnostics.zero_crossings(centred, "key", "h", "v"))


@query(PANEL + "l AS (SELECT key, q, lag(q) OVER w AS a, lead(q) OVER w AS b FROM panel WINDOW w AS (PARTITION BY key ORDER BY h)) SELECT key, count(*) FILTER (q > a AND q > b) AS maxima, count(*) FILTER (q < a AND q < b) AS minima FROM l GROUP BY key")
def local_extrema(spark, sf_dir):
    return diagnostics.local_extrema(_panel(spark, sf_dir), "key", "h", "q")


@query(PANEL + "x AS (SELECT 1) SELECT key, round(CASE WHEN stddev_pop(q) * stddev_pop(n) > 1e-10 THEN corr(q, n) ELSE 0 END, 6) AS corr, round(sqrt(avg(q * q)), 6) AS rms, round(CASE WHEN count(*) FILTER (n > 3) >= 10 AND count(*) FILTER (n < 2) >= 10 THEN stddev_pop(q) FILTER (n > 3) / nullif(stddev_pop(q) FILTER (n < 2), 0) END, 6) AS swing FROM panel GROUP BY key")
def storm_and_quiet(spark, sf_dir):
    """Correlation, root mean square and swing of the hourly values, driven by the number of events."""
    stats = [diagnostics.guarded_correlation("q", "n").alias("corr"), F.sqrt(F.avg(F.col("q") * F.col("q"))).alias("rms"), diagnostics.swing_ratio(None, "q", "n", 2, 3).alias("swing")]
    return rounded(_panel(spark, sf_dir).groupBy("key").agg(*stats))


@query(PANEL + "d AS (SELECT key, h // 24 AS day, sum(q) + 1 AS v FROM panel GROUP BY ALL), r AS (SELECT key, v / lag(v) OVER (PARTITION BY key ORDER BY day) AS r FROM d) SELECT key, round(exp(avg(ln(r))), 6) AS ratio FROM r GROUP BY key")
def geometric_growth(spark, sf_dir):
    """The geometric mean of each day's ratio to the day before."""
    from pyspark.sql import Window

    days = _panel(spark, sf_dir).groupBy("key", F.expr("h div 24").alias("day")).agg((F.sum("q") + 1).alias("v"))
    ratio = F.col("v") / F.lag("v").over(Window.partitionBy("key").orderBy("day"))
    return rounded(days.select("key", ratio.alias("r")).groupBy("key").agg(F.exp(F.avg(F.log("r"))).alias("ratio")))


@query(PANEL + "x AS (SELECT 1) SELECT key, h * 60 // 720 AS col, round(min(q), 6) AS low, round(max(q), 6) AS high FROM panel GROUP BY ALL")
def plot_columns(spark, sf_dir):
    """The least and largest value in each of 60 columns of a plot."""
    col = F.expr("h * 60 div 720").alias("col")
    return rounded(_panel(spark, sf_dir).groupBy("key", col).agg(F.min("q").alias("low"), F.max("q").alias("high")))


@query(PANEL + "s AS (SELECT key, stddev_pop(q) AS s FROM panel GROUP BY key) SELECT round(sum((s / (s + 0.1)) ** 2 * (decay - obs) ** 2) / count(*), 6) AS weighted_mse FROM rows JOIN s USING (key)")
def weighted_loss(spark, sf_dir):
    """The squared error with each key's weight, which falls where values hardly vary."""
    weight = _panel(spark, sf_dir).groupBy("key").agg(F.pow(F.stddev_pop("q") / (F.stddev_pop("q") + 0.1), F.lit(2.0)).alias("w"))
    e = F.col("decay") - F.col("obs")
    return rounded(_rows(spark, sf_dir, "decay").join(weight, "key").agg(F.avg(F.col("w") * e * e).alias("weighted_mse")))


@query(PANEL + "f AS (SELECT h - origin + 335 AS i, q FROM history) SELECT CAST(i AS INTEGER) AS i, round(avg(q), 6) AS mean, round(CASE WHEN stddev_pop(q) < 1e-8 THEN 1 ELSE stddev_pop(q) END, 6) AS std FROM f GROUP BY i")
def feature_moments(spark, sf_dir):
    """Mean and deviation of each hour of the history over all windows."""
    each = _windows(spark, sf_dir).select(F.posexplode("x").alias("i", "v")).groupBy("i")
    std = F.stddev_pop("v")
    return rounded(each.agg(F.avg("v").alias("mean"), F.when(std < 1e-8, 1.0).otherwise(std).alias("std")))


@query("WITH e AS (SELECT user_id, event_type FROM events) SELECT 'both' AS side, count(*) AS n FROM (SELECT user_id FROM e WHERE event_type = 'click' INTERSECT SELECT user_id FROM e WHERE event_type = 'error') UNION ALL SELECT 'first only', count(*) FROM (SELECT user_id FROM e WHERE event_type = 'click' EXCEPT SELECT user_id FROM e WHERE event_type = 'error') UNION ALL SELECT 'second only', count(*) FROM (SELECT user_id FROM e WHERE event_type = 'error' EXCEPT SELECT user_id FROM e WHERE event_type = 'click')")
def key_sets(spark, sf_dir):
    """Which keys do two sides share? They are disjoint if none, equal if no others."""
    e = _table(spark, sf_dir, "events").where("event_type in ('click', 'error')")
    side = e.groupBy("user_id").agg(F.bool_or(F.col("event_type") == "click").alias("a"), F.bool_or(F.col("event_type") == "error").alias("b"))
    name = F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "first only").otherwise("second only")
    every = spark.createDataFrame([("both",), ("first only",), ("second only",)], "side string")
    found = side.where("user_id is not null").groupBy(name.alias("side")).agg(F.count("*").alias("n"))
    return every.join(found, "side", "left").select("side", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    RUNS.replace(" FROM supplier)", ", s_suppkey, s_acctbal / 1e4 - 0.05e0 AS kge FROM supplier)") + """, h AS (SELECT l_suppkey, avg(CASE WHEN l_quantity <= 40 THEN l_tax * 20 END) AS gradient_norm FROM lineitem GROUP BY l_suppkey)
SELECT row_number() OVER (ORDER BY h37_48 DESC NULLS LAST, run) AS place, run, round(dev, 6) AS median_nse, round(kge, 6) AS median_kge, round(dev - sanval, 6) AS gap,
  CASE WHEN dev - sanval > 0.02 THEN 'higher' WHEN dev - sanval < -0.02 THEN 'lower' WHEN dev IS NOT NULL THEN 'agrees' END AS verdict, round(h37_48, 6) AS ranked, round(gradient_norm, 6) AS gradient_norm FROM runs LEFT JOIN h ON l_suppkey = s_suppkey WHERE state = 'done'"""
)
def comparison_board(spark, sf_dir):
    """All finished runs on one board, ranked by the last hours, with gaps, KGE and mean gradient norms of their histories."""
    runs = _table(spark, sf_dir, "supplier").selectExpr(*(f"{e} AS {n}" for n, e in RUN.items()), "s_suppkey", "s_acctbal / 1e4 - 0.05e0 AS kge")
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.when(F.col("l_quantity") <= 40, F.col("l_tax") * 20).alias("grad_norm"))
    board = reports.comparison(runs, "h37_48", lines, "s_suppkey")
    # a mean may lie at a five in the seventh place: twelve places first, so that the order of summation does not decide
    return rounded(board.withColumn("gradient_norm", F.round("gradient_norm", 12)))


@query(RUNS + ", l AS (SELECT arm, 'dev' AS split, seed, dev AS value FROM runs WHERE state = 'done' AND dev IS NOT NULL UNION ALL SELECT arm, 'test', seed, test FROM runs WHERE state = 'done' AND test IS NOT NULL) SELECT arm, split, seed, round(value, 6) AS value, round(avg(value) OVER w, 6) AS mean, count(*) OVER w AS n FROM l WINDOW w AS (PARTITION BY arm, split)")
def seed_points(spark, sf_dir):
    return rounded(reports.seed_points(_runs(spark, sf_dir)))
