import math
import os

import pytest

import numpy as np
from pyspark.sql import functions as F

from gaugeflow.functions import series
from gaugeflow.operators import metrics, ridge, splits
from gaugeflow.operators.graph import connected_components
from gaugeflow.plans import catalogue
from gaugeflow.streaming.statistics import running_statistics

SF = "/root/testdata/sf0.001"


def scores(spark, obs, pred):
    df = spark.createDataFrame([("k", float(o), float(p)) for o, p in zip(obs, pred)], "key string, obs double, p double")
    return metrics.score(df, "p").first()


def test_scores_of_known_series(spark):
    assert scores(spark, [1, 2, 3, 4, 5], [1, 2, 3, 4, 5])["nse"] == 1
    assert scores(spark, [1, 2, 3, 4, 5], [3] * 5)["nse"] == 0
    assert math.isclose(scores(spark, [1, 2, 3, 4, 5], [2, 4, 6, 8, 10])["kge_beta"], 2)
    rng = np.random.default_rng(8)
    y = rng.gamma(2.0, 3.0, 60)
    p = 0.8 * y + rng.normal(0, 1, 60)
    a = scores(spark, y, p)
    r, alpha, beta = np.corrcoef(y, p)[0, 1], p.std() / y.std(), p.mean() / y.mean()
    want = {"mae": np.abs(p - y).mean(), "rmse": np.sqrt(((p - y) ** 2).mean()), "nse": 1 - ((p - y) ** 2).sum() / ((y - y.mean()) ** 2).sum(), "kge": 1 - np.sqrt((r - 1) ** 2 + (alpha - 1) ** 2 + (beta - 1) ** 2)}
    assert all(math.isclose(a[k], v, rel_tol=1e-9) for k, v in want.items())
    assert scores(spark, [2, 2, 2], [1, 2, 3])["nse"] == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_leak_of_shared_runs(spark):
    rows = [("a", 0, [float(x) for x in range(20)]), ("a", 1, [float(x) for x in range(12, 30)]), ("a", 2, [50.0 + x for x in range(12)]), ("b", 3, [float(x) for x in range(20)])]
    g = splits.grams(spark.createDataFrame(rows, "key string, origin long, x array<double>"))
    got = {r["origin"]: (r["n_shared"], r["leaked"]) for r in splits.leaked_windows(g.where("origin = 0"), g.where("origin > 0")).collect()}
    assert got == {1: (3, True), 2: (0, False), 3: (0, False)}


def test_folds_over_series(spark):
    curve = [0.7 - 0.5 / (1 + k) for k in range(9)] + [0.64 - 0.01 * k for k in range(9)]
    df = spark.createDataFrame([(curve,), ([],), (None,), ([1.0],)], "v array<double>")
    v = F.col("v")
    got = df.select(series.early_stop(v, 5).alias("stop"), series.moving_mean(v).alias("mean"), series.peak_of_means(v).alias("peak")).collect()
    best, at, epoch = -math.inf, -1, -1
    for epoch, x in enumerate(curve):
        if x > best + 1e-4:
            best, at = x, epoch
        if epoch - at >= 5:
            break
    assert tuple(got[0]["stop"]) == (best, at, epoch, True) and tuple(got[3]["stop"]) == (1.0, 0, 0, False)
    mean = curve[0]
    for t, x in enumerate(curve[1:], 1):
        d = min(0.999, (1 + t) / (10 + t))
        mean = d * mean + (1 - d) * x
    assert math.isclose(got[0]["mean"], mean) and math.isclose(got[0]["peak"], max(sum(curve[i : i + 3]) / 3 for i in range(16))) and got[3]["mean"] == 1
    assert all(got[k][c] is None for k in (1, 2) for c in ("stop", "mean", "peak")) and got[3]["peak"] is None
    routed = spark.createDataFrame([([0.9, 0.4, 0.02],), ([1.0, 1.0, 1.0],)], "v array<double>").select(series.route_by_entropy(v, 2).alias("r")).collect()
    assert [r["r"] for r in routed] == [[0, 1], [0, 1]]
    given = (0.3, -1.7, 0.0, 2.0, -9.0)
    errors = spark.createDataFrame([(x,) for x in given], "e double")
    want = sum(x * x / 2 if abs(x) <= 2 else 2 * (abs(x) - 1) for x in given) / 5
    assert math.isclose(errors.agg(F.avg(series.huber(F.col("e"), 2.0))).first()[0], want)


def test_ridge_against_a_direct_solution(spark):
    rng = np.random.default_rng(4)
    x, w = rng.normal(size=(50, 6)), rng.normal(size=(4, 2))
    y = x[:, -4:] @ w + 3 + rng.normal(0, 0.1, (50, 2))
    rows = [("k", i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame([*rows, ("k", 99, [1.0], [1.0, 1.0]), ("k", 98, [None] * 6, [1.0, 1.0])], "key string, origin long, x array<double>, y array<double>")
    got = ridge.fit_ridge(df, penalty=0.5, lags=4)
    a = np.hstack([x[:, -4:], np.ones((50, 1))])
    want = np.linalg.solve(a.T @ a + np.diag([0.5] * 4 + [0]), a.T @ y)
    assert np.allclose(got, want)
    out = {r["origin"]: r["ridge"] for r in ridge.with_ridge(df, got).collect()}
    assert out[99] is None and np.allclose([out[i] for i in range(50)], a @ want)
    with pytest.raises(ValueError):
        ridge.fit_ridge(df.limit(0))


def test_statistics_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", None), ("a", 8.0)], "k string, v double")
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = running_statistics(stream, "k", "v").writeStream.format("memory").queryName("running").outputMode("complete").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert sorted(spark.table("running").collect()) == sorted(running_statistics(df, "k", "v").collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", ["panel_hourly", "score_decay", "leak_flags", "split_basin_holdout", "aggregate_summary", "loss_means", "quick_nse", "subset_nse", "signed_rank", "statistics_by_type", "series_peaks"])
def test_same_rows_as_duckdb(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("events", "lineitem"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(catalogue.ORACLE_SQL[name]).df()
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    key = lambda df: sorted(tuple(round(float(v), 5) if isinstance(v, float) else str(v) for v in r) for r in df[columns].itertuples(index=False))
    assert key(got) == key(want)


def test_ridge_scores_use_the_whole_standardised_history(spark, monkeypatch):
    from gaugeflow.plans import catalogue

    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 40)) * np.geomspace(0.01, 1000, 40) + 5
    x[:, 7] = 5.0
    y = np.stack([x[:, 0] * 30 + 2, x[:, 3] - x[:, 39] / 100], axis=1) + rng.normal(0, 0.1, (80, 2))
    df = spark.createDataFrame([("k", i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], "key string, origin long, x array<double>, y array<double>")
    std = x.std(axis=0)
    z = np.hstack([(x - x.mean(axis=0)) / np.where(std < 1e-8, 1, std), np.ones((80, 1))])
    want = z @ np.linalg.solve(z.T @ z + np.diag([1.0] * 40 + [0]), z.T @ y)
    seen = {}
    monkeypatch.setattr(catalogue, "_windows", lambda spark, sf_dir: df)
    monkeypatch.setattr(catalogue.metrics, "score", lambda long, name: seen.setdefault("rows", long))
    catalogue.QUERIES["ridge_scores"](spark, "")
    got = {(r["origin"], r["lead_h"]): r["ridge"] for r in seen["rows"].collect()}
    assert np.allclose([[got[i, 1], got[i, 2]] for i in range(80)], want, atol=1e-6)
