"""Queries of settings, resumable writes and watched folders, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeflow.operators import configs, decisions, folds, scorer, splits
from gaugeflow.plans.boards import DONE, RUN, RUNS, _BOARD
from gaugeflow.plans.catalogue import PANEL, _table, _windows, query, rounded
from gaugeflow.session import Scratch
from gaugeflow.sources.arrays import read_npz, write_npz
from gaugeflow.sources.ledger import Ledger
from gaugeflow.sources.panel import hourly_series, long_targets, series_windows
from gaugeflow.streaming import watch


@query("""WITH e AS (SELECT user_id, event_type, max_by(props, event_id) AS props, max_by(CAST(floor(value * 100) AS BIGINT), event_id) AS cents, max(event_id) AS last FROM events GROUP BY ALL),
c AS (SELECT user_id AS id, '{"by": {' || string_agg('"' || event_type || '": {"cents": ' || cents || ', "props": ' || props || '}', ', ' ORDER BY event_type) || '}, "last": "' || max_by(event_type, last) || '"}' AS config FROM e GROUP BY user_id)
SELECT id, config, substr(sha256(config), 1, 12) AS key FROM c""")
def config_merge(spark, sf_dir):
    """Each event as a layer of its user's nested state: the last of every type stays, in canonical text, with its key."""
    cents = F.floor(F.col("value") * 100).cast("long").cast("string")
    parts = [F.lit('{"last": "'), "event_type", F.lit('", "by": {"'), "event_type", F.lit('": {"props": '), "props", F.lit(', "cents": '), cents, F.lit("}}}")]
    layers = _table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("priority"), F.concat(*parts).alias("config"))
    return configs.merge_configs(layers)


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def resumable_days(spark, sf_dir):
    """Days as pieces of a ledger, in four steps; a second run finds them all done."""
    schema = "day string, event_type string, n long, total double"
    ledger = Ledger(spark, Scratch(spark, "resumable-days").path("table"), schema, "day")
    events = _table(spark, sf_dir, "events").withColumn("day", F.to_date("ts").cast("string"))

    def totals(rows):
        return rows.groupBy("day", "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))

    ledger.run(events, totals, steps=4)
    return rounded(ledger.run(events, totals))


@query(RUNS + _BOARD.format(m="dev", w=DONE.format(m="dev")))
def watched_board(spark, sf_dir):
    """Summaries of runs written to their folders, followed by a stream that publishes the board."""
    scratch = Scratch(spark, "watched-board")
    # runs may share a name, so a folder's has the key behind a dot, which sorts before all that a name goes on with
    runs = _table(spark, sf_dir, "supplier").selectExpr(*(f"{RUN[n]} AS {n}" for n in ("run", "state", "dev")), "s_suppkey").where("state = 'done'")
    done = runs.select(F.concat("run", F.lit("."), "s_suppkey").alias("run"), F.col("dev").alias("dev_median_nse"))
    folders, out = scratch.path("runs"), scratch.path("board")
    text = F.to_json(F.struct("dev_median_nse")).alias("value")
    done.select("run", text).repartition("run").write.partitionBy("run").text(folders)
    found = watch.watch_board(spark, folders, out, 0.5, every=None, files="part-*")
    found.awaitTermination()
    board = watch.current_board(spark, out)
    return rounded(board.withColumn("run", F.regexp_replace("run", r"^run=|\.\d+$", "")))


@query(
    PANEL + """held AS (SELECT key, origin, row_number() OVER (PARTITION BY key ORDER BY md5('42:' || origin), origin) <= 3 AS out FROM origins),
x AS (SELECT key, origin, max(q) FILTER (h = origin) AS last, round(avg(q), 6) AS mean FROM history GROUP BY ALL), y AS (SELECT key, origin, round(sum(obs), 6) AS ahead FROM targets GROUP BY ALL)
SELECT key, origin, round(last, 6) AS last, mean, ahead FROM x JOIN y USING (key, origin) JOIN held USING (key, origin) WHERE out"""
)
def stored_windows(spark, sf_dir):
    """Windows written as npz files of arrays and read back, the validation side by a filter of the reader."""
    windows = _windows(spark, sf_dir)
    held = splits.hold_out_within(windows, "key", "origin", 0.2).withColumnRenamed("id", "origin")
    rows = windows.join(held, ["key", "origin"]).select("key", "origin", F.col("held_out").cast("int").alias("split"), "x", "y")
    path = Scratch(spark, "stored-windows").path("windows")
    write_npz(rows, path)
    back = read_npz(spark, path, "key string, origin long, split int, x array<double>, y array<double>").where("split = 1")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    return rounded(back.select("key", "origin", F.element_at("x", -1).alias("last"), (total("x") / F.size("x")).alias("mean"), total("y").alias("ahead")))


LAGS, AHEAD, FOLDS, PENALTY = 48, 24, 5, 100.0


def _ridge(spark, sf_dir):
    """Users' windows with fold and units, the units and the fold models.

    A user is one row until the windows are cut, so what is joined and written is each hour once, and a user's windows stay together.
    """
    scratch = Scratch(spark, "ridge")
    cut = lambda s: series_windows(s, history=LAGS, ahead=AHEAD)
    series = scratch.table(hourly_series(_table(spark, sf_dir, "events"), "user_id"), "series")
    norm = scratch.table(folds.units(cut(series)), "norm")
    dealt = series.hint("merge").join(folds.with_folds(norm, FOLDS), "key")  # series are small when packed, but not in the driver
    windows = cut(scratch.table(dealt, "dealt"))
    scratch.drop("series")
    return windows, norm, folds.fit_folds(folds.in_units(windows), LAGS, AHEAD, PENALTY)


@query("""WITH k AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS key FROM events), f AS (SELECT (row_number() OVER (ORDER BY md5('42:' || key), key) - 1) % 5 AS fold FROM k)
SELECT CAST(o.fold AS INTEGER) AS fold, 28 * count(*) AS n_fit, true AS certified FROM (SELECT DISTINCT fold FROM f) o JOIN f ON f.fold <> o.fold GROUP BY o.fold""")
def ridge_certificate(spark, sf_dir):
    """Do the weights of every fold solve its normal equations to nine digits? Judged on the windows, not on the sums solved from."""
    windows, _, fits = _ridge(spark, sf_dir)
    found = folds.certificate(folds.in_units(windows), fits, LAGS, AHEAD, PENALTY)
    return found.select("fold", "n_fit", (F.col("residual") < 1e-9).alias("certified"))


@query()
def ridge_out_of_sample(spark, sf_dir):
    """Scores of users by models that have not seen them, in their own units; no SQL twin (linear systems are solved)."""
    windows, norm, fits = _ridge(spark, sf_dir)
    beside = folds.in_units(windows.select("*", F.col("y").alias("obs"), F.element_at("x", -1).alias("last"))).drop("y")
    made = folds.with_forecast(beside, fits)
    plain = F.transform("ridge", lambda v: v * F.col("std") + F.col("mean")).alias("pred")
    made = made.select("key", "origin", F.col("obs").alias("y"), plain, F.array_repeat("last", AHEAD).alias("bar"))
    rows = long_targets(made, "pred", "bar").withColumn("model", F.lit("ridge"))
    return rounded(scorer.score_document(rows, norm, ahead=AHEAD, with_keys=False).select("model", "document.n_basins", "document.n_samples", "document.median_nse", "document.median_nse_persistence", "document.mean_nse_clip"))


# What the runs derived from ``supplier`` have besides: two buckets, skills, a bias, and which files there are of them.
_SHEET = {
    "arm": RUN["arm"], "seed": RUN["seed"], "run": RUN["run"], "state": RUN["state"], "dev": RUN["dev"], "sanval": RUN["sanval"], "h37": RUN["h37_48"], "h25": "s_acctbal / 1e4 - s_suppkey * 31 % 40 / 1e2",
    "beta": "CASE WHEN s_suppkey % 9 <> 0 THEN 0.7e0 + s_suppkey * 13 % 50 / 1e2 END", "e1": "s_suppkey * 17 % 100 / 1e2", "e2": "s_suppkey * 23 % 100 / 1e2", "e3": "s_suppkey * 29 % 100 / 1e2",
    "skilled": "s_suppkey % 4 <> 0", "rescored": "s_suppkey % 6 <> 1", "previous": "concat('exp_', lpad(concat('', CAST(floor(s_suppkey / 3) AS BIGINT) - 1), 4, '0'))", "k": "s_suppkey",
}
_FILES = "SELECT run, arm, seed, {rank} AS rk, dev + {more} AS m, (h25 + h37) / 2 AS h, CASE WHEN {skilled} THEN (e1 + e2 + e3) / 3 END AS e, beta, sanval AS sv FROM s WHERE state = 'done' AND dev IS NOT NULL"


@query(
    "WITH s AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _SHEET.items()) + " FROM supplier), f AS (" + _FILES.format(rank="CASE WHEN skilled THEN 0 ELSE 2 END", more="0", skilled="skilled")
    + " UNION ALL " + _FILES.format(rank="1", more="0.001", skilled="true") + """ AND rescored),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY rk) AS n FROM f) WHERE n = 1),
t AS (SELECT DISTINCT arm, previous FROM s WHERE k >= 3),
p AS (SELECT x.arm, x.seed, x.m - y.m AS dm, x.h - y.h AS dh, x.e - y.e AS de, x.sv - y.sv AS ds FROM t JOIN a x ON x.arm = t.arm JOIN a y ON y.arm = t.previous AND y.seed = x.seed),
g AS (SELECT t.arm, count(dm) AS n, count(dh) AS nh, avg(dm) AS dm, min(dm) AS least, avg(dh) AS dh, max(dm) FILTER (seed = 42) AS dm42, max(de) FILTER (seed = 42) AS de42, max(ds) FILTER (seed = 42) AS ds42, count(dm) FILTER (seed = 42) AS n42,
  coalesce(string_agg('s' || seed || ': ' || printf('%+.4f', dm) || ' (h25-48 ' || coalesce(printf('%+.4f', dh), '-') || ')', '  ' ORDER BY seed), '-') AS pairs FROM t LEFT JOIN p ON p.arm = t.arm GROUP BY t.arm),
b AS (SELECT arm, median(beta) AS beta FROM a GROUP BY arm),
h AS (SELECT event_type AS run, CAST(ts AS DATE) AS day, avg(value) AS nse, (min(value) + max(value)) / 2 AS ema FROM events GROUP BY ALL),
w AS (SELECT run, avg(nse) OVER o AS nse, avg(ema) OVER o AS ema, count(*) OVER o AS n FROM h WINDOW o AS (PARTITION BY run ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
v AS (SELECT count(*) FILTER (ema >= nse) AS votes FROM (SELECT run, max(nse) AS nse, max(ema) AS ema FROM w WHERE n = 3 GROUP BY run))
SELECT 'adopt ' || arm AS rule, n AS n_pairs, round(dm, 6) AS value, CASE WHEN n < 3 OR nh < 3 THEN 'PENDING' WHEN dm >= 0.02 AND least > 0 AND dh >= 0 THEN 'ADOPT' ELSE 'REJECT' END AS verdict, pairs FROM g
UNION ALL SELECT 'pick ' || g.arm, n, round(dm, 6), CASE WHEN n < 3 THEN 'PENDING' WHEN dm >= 0.01 AND coalesce(beta >= 0.9, false) THEN 'MAE' ELSE 'Huber 0.5' END, pairs FROM g LEFT JOIN b ON b.arm = g.arm
UNION ALL SELECT 'gate ' || arm, n42, round(dm42, 6), CASE WHEN dm42 IS NULL OR de42 IS NULL THEN 'PENDING' WHEN dm42 >= 0.01 AND de42 > 0 THEN 'PASS' ELSE 'FAIL' END, pairs FROM g
UNION ALL SELECT 'close ' || arm, n42, round(dm42, 6), CASE WHEN dm42 IS NULL OR ds42 IS NULL THEN 'PENDING' WHEN dm42 < 0.02 AND ds42 < 0.02 THEN 'CLOSE' ELSE 'KEEP' END, pairs FROM g
UNION ALL SELECT 'votes *', 0, CAST(votes AS DOUBLE), CASE WHEN votes >= 4 THEN 'ADOPT' ELSE 'REJECT' END, '-' FROM v"""
)
def decision_sheet(spark, sf_dir):
    """Every arm against the one before it by all rules, from the file of each run that counts, and the votes of curves."""
    scratch = Scratch(spark, "decision-sheet")
    s = _table(spark, sf_dir, "supplier").selectExpr(*(f"{e} AS {n}" for n, e in _SHEET.items()))
    done = s.where("state = 'done' AND dev IS NOT NULL").select(
        "run", "arm", "seed", "sanval", "k", F.col("beta").alias("highflow_beta"), "dev", "skilled", "rescored",
        F.create_map(F.lit("h25_36"), "h25", F.lit("h37_48"), "h37").alias("horizon_nse"), F.array("e1", "e2", "e3").alias("skill"),
    )
    own = done.select("*", F.lit("own").alias("source"), F.col("dev").alias("median_nse"), F.when(F.col("skilled"), F.col("skill")).alias("skill_by_lead"))
    again = done.where("rescored").select("*", F.lit("rescore").alias("source"), (F.col("dev") + 0.001).alias("median_nse"), F.col("skill").alias("skill_by_lead"))
    runs = decisions.resolved(own.unionByName(again), "k")  # runs may share a name: the least key counts
    events = _table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("run"), F.to_date("ts").alias("epoch"))
    curves = events.agg(F.avg("value").alias("nse"), ((F.min("value") + F.max("value")) / 2).alias("ema"))
    found = scratch.table(decisions.metric_rows(runs).unionByName(decisions.ema_votes(curves).withColumn("seed", F.col("seed").cast("int"))), "metrics")
    arms = s.where("k >= 3").select("arm", "previous").distinct()
    arms = arms.join(arms.select("arm"), "arm")  # where names are shared, an arm has several before it, each as often as there are
    kinds = F.explode(F.array(*(F.lit(k) for k in ("adopt", "pick", "gate", "close")))).alias("kind")
    rules = arms.select("*", kinds).select(F.concat("kind", F.lit(" "), "arm").alias("rule"), "kind", F.col("arm").alias("treat"), F.col("previous").alias("ref"))
    rules = rules.union(spark.range(1).select(F.lit("votes *"), F.lit("votes"), F.lit("*"), F.lit("*")))
    # an arm may have several before it: at its one seed the greatest difference counts
    kinds = decisions.KINDS | {k: ([(m, of, "max", *rest) for m, of, _, *rest in decisions.KINDS[k][0]], *decisions.KINDS[k][1:]) for k in ("gate", "close")}
    judged = decisions.decide(rules, found, kinds).join(decisions.pair_texts(rules, found), "rule")
    value = F.coalesce(*(F.try_element_at("values", F.lit(k)) for k in ("median_nse mean", "median_nse max", "votes mean")))
    # means of two six-digit figures end in a five: these are rounded as doubles, as in the SQL, not as decimal texts
    value = F.round(value * 1e6) / 1e6
    return judged.select("rule", F.col("n_pairs").cast("long").alias("n_pairs"), value.alias("value"), "verdict", "pairs")
