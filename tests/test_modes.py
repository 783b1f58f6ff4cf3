import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.functions import modes, series
from gaugeflow.operators import decompose
from gaugeflow.sources import runs

T = np.arange(336)
WAVES = np.sin(2 * np.pi * T / 12) + 0.5 * np.sin(2 * np.pi * T / 60) + 0.02 * T


def spline_by_one_system(x, v, at):
    """All coefficients of all cubics from one dense linear system."""
    n = len(x) - 1
    a, b, row = np.zeros((4 * n, 4 * n)), np.zeros(4 * n), 0
    for i in range(n):
        h = x[i + 1] - x[i]
        for powers, want in (([1, 0, 0, 0], v[i]), ([1, h, h**2, h**3], v[i + 1])):
            a[row, 4 * i : 4 * i + 4], b[row] = powers, want
            row += 1
        if i + 1 < n:
            for powers, order in (([0, 1, 2 * h, 3 * h * h], 1), ([0, 0, 2, 6 * h], 2)):
                a[row, 4 * i : 4 * i + 4], a[row, 4 * i + 4 + order] = powers, -math.factorial(order)
                row += 1
    for i in (0, n - 2):
        if row < 4 * n and n > 1:
            a[row, 4 * i + 3], a[row, 4 * i + 7] = 1, -1
            row += 1
    c = np.linalg.lstsq(a, b, rcond=None)[0].reshape(n, 4)
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 1)
    d = at - x[i]
    return c[i, 0] + c[i, 1] * d + c[i, 2] * d**2 + c[i, 3] * d**3


def test_envelopes_against_one_dense_system():
    rng = np.random.default_rng(3)
    y = np.vstack([rng.normal(size=(4, 40)), np.sin(np.arange(40) / 7)[None], -np.abs(np.arange(40) - 17.0)[None]])
    top = modes.peaks(y)
    for edge in ("anchor", "mirror"):
        got = modes.envelopes(y, top, edge)
        for row, own, g in zip(y, top, got):
            at = np.flatnonzero(own)
            if edge == "mirror" and len(at) >= 2:
                x, v = np.r_[-at[1::-1], at, 78 - at[: -3 : -1]], np.r_[row[at[1::-1]], row[at], row[at[: -3 : -1]]]
            else:
                x = np.r_[0, at, 39]
                v = row[x]
            if len(x) > 3:
                assert np.allclose(g, spline_by_one_system(x.astype(float), v, np.arange(40)), atol=1e-6)
            else:
                assert np.allclose(g, np.polyval(np.polyfit(x, v, 2), np.arange(40)))


def test_modes_sum_to_the_series():
    for f in (modes.modes, lambda x: modes.noise_assisted_modes(x, trials=10)):
        found, count, rest = f(np.vstack([WAVES, np.random.default_rng(1).normal(size=336)]))
        assert np.abs(found.sum(1) + rest - [WAVES, np.random.default_rng(1).normal(size=336)]).max() < 1e-9 and count.min() >= 2
    alone, _, _ = modes.noise_assisted_modes(WAVES[None], trials=10)
    beside, _, _ = modes.noise_assisted_modes(np.vstack([WAVES[::-1], WAVES]), trials=10)
    assert np.allclose(alone[0], beside[1], atol=1e-9)


def test_entropy_against_counting_pairs():
    def plain(x, m):
        r, counts = 0.2 * np.std(x), []
        for k in (m, m + 1):
            w = [x[i : i + k] for i in range(len(x) - k + 1)]
            counts.append(sum(np.abs(a - b).max() <= r for i, a in enumerate(w) for j, b in enumerate(w) if i != j))
        return min(3.0, math.log(counts[0] / counts[1])) if all(counts) else 3.0

    rng = np.random.default_rng(5)
    for x in (rng.normal(size=80), np.sin(np.arange(90) / 4), np.round(rng.normal(size=60), 1)):
        assert modes.sample_entropy(x) == pytest.approx(plain(x, 2))
    assert modes.sample_entropy(np.ones(50)) == 0 and modes.sample_entropy(np.array([1.0, 2, 3])) == 0
    assert modes.sample_entropy(np.sin(T / 5)) < modes.sample_entropy(rng.normal(size=336))
    assert modes.bands(np.array([1.0, 1.1, 0.4, 0.5, 0.0]), 3) == [(0, 2), (2, 4), (4, 5)]


def test_decomposition_of_windows_and_resumed_cache(spark, tmp_path):
    rows = [("a", 1, WAVES.tolist()), ("a", 2, [0.37] * 336), ("a", 3, (T / 335).tolist()), ("b", 4, None), ("b", 5, []), ("b", 6, [1.0, None, 2.0]), ("b", 7, [1.0, 5.0, 2.0, 4.0])]
    df = spark.createDataFrame(rows, "key string, origin long, x array<double>")
    path = str(tmp_path / "cache")
    first = decompose.fill_cache(df.where("origin = 1"), ["key", "origin"], path, trials=10)
    assert first.count() == 1
    found = decompose.fill_cache(df, ["key", "origin"], path, trials=10)
    assert spark.read.parquet(path).count() == 4
    got = {r["origin"]: r for r in df.join(found, ["key", "origin"]).select("*", decompose.band_error(F.col("x"), F.col("bands").cast("array<array<double>>")).alias("e")).collect()}
    assert set(got) == {1, 2, 3, 7} and all(r["e"] < 1e-5 and len(r["bands"]) == 3 for r in got.values())
    assert (got[2]["code"], got[2]["n_modes"], got[2]["entropy"]) == (1, 0, 0)
    z = df.where("origin = 2").join(found, ["key", "origin"]).select(decompose.normalised_bands(F.col("bands"), F.lit(0.1), F.lit(0.5)).alias("z")).first()["z"]
    assert abs(sum(b[0] for b in z) - 0.27 / 0.5) < 1e-6
    assert df.select(series.sample_entropy(F.col("x")).alias("s")).where("s is null").count() == 2
    assert decompose.plain_modes(df.where("origin = 1"), ["key", "origin"]).count() >= 3


def test_folders_of_runs(spark, tmp_path):
    def put(run, name, text):
        (tmp_path / run).mkdir(exist_ok=True)
        (tmp_path / run / name).write_text(text)

    put("exp 1+", "metrics_dev.json", json.dumps({"median_nse": 0.5, "horizon_nse": {"h1_12": 0.9}, "per_basin": [{"basin_id": 3, "nse": 0.4}]}, indent=1))
    put("exp 1+", "summary.json", json.dumps({"dev_median_nse": 0.5, "dev_horizon_nse": {"h1_12": 0.9}}))
    put("exp_2", "metrics_dev.json", "{ broken")
    put("exp_3", "history.csv", "epoch,train_loss,sanval_nse,lr,grad_norm,elapsed_s\n0,1.5,nan,0.1,,3\n1,1.2,0.4,0.1,2.0,3\n")
    put("exp_4", "history.csv", "epoch,train_loss,sanval_nse,sanval_nse_ema,lr\n0,1.0,0.5,0.6,0.2\n")
    root = f"file://{tmp_path}"
    metrics = runs.read_metrics(spark, root)
    by = {r["run"]: r for r in metrics.collect()}
    assert by["exp 1+"]["per_basin"][0]["nse"] == 0.4 and by["exp 1+"]["median_fhv"] is None and by["exp_2"]["corrupt"]
    assert [r["run"] for r in runs.read_metrics(spark, root, holds="1+").collect()] == ["exp 1+"]
    summaries = runs.read_summaries(spark, root)
    assert summaries.first()["horizon_nse"] == {"h1_12": 0.9}
    history = runs.read_history(spark, root)
    h = {(r["run"], r["epoch"]): r for r in history.collect()}
    assert math.isnan(h["exp_3", 0]["sanval_nse"]) and h["exp_3", 0]["grad_norm"] is None and h["exp_4", 0]["sanval_nse_ema"] == 0.6 and h["exp_4", 0]["lr"] == 0.2
    names = spark.createDataFrame([("exp 1+",), ("exp_2",), ("exp_3",), ("exp_5",)], "run string")
    states = runs.run_states(names, summaries, metrics, history).collect()
    assert {r["run"]: (r["state"], r["median_nse"]) for r in states} == {"exp 1+": ("done", 0.5), "exp_2": ("corrupt", None), "exp_3": ("running", None), "exp_5": ("empty", None)}


def test_target_contract(spark, tmp_path):
    hours = [f"q_{k:02d}" for k in range(1, 49)]
    lines = [",".join(["Id", *hours])] + [",".join([str(i)] + [str(i + 0.1)] * 48) for i in (2, 0, 1)]
    (tmp_path / "ok.csv").write_text("\n".join(lines))
    (tmp_path / "bad.csv").write_text("\n".join([*lines[:3], "7," + ",".join(["-1.0"] * 47 + ["NaN"])]))
    windows = spark.createDataFrame([(i, [9.0, float(i)]) for i in range(3)], "sample_id long, x array<double>")
    ok = runs.target_faults(runs.read_targets(spark, str(tmp_path / "ok.csv")), windows).first()
    assert ok["valid"] and ok["corr"] > 0.999
    bad = runs.target_faults(runs.read_targets(spark, str(tmp_path / "bad.csv")), windows).first()
    assert (bad["missing"], bad["unknown"], bad["repeated"], bad["not_finite"], bad["negative"], bad["valid"]) == (1, 1, 0, 1, 47, False)


def test_mode_groups_uses_the_whole_ensemble(spark, monkeypatch):
    from gaugeflow.operators import decompose
    from gaugeflow.plans import catalogue

    rng = np.random.default_rng(3)
    rows = [("k", i, (np.sin(np.arange(120) / 4) + rng.normal(0, 0.5, 120)).tolist()) for i in range(2)]
    df = spark.createDataFrame(rows, "key string, origin long, x array<double>")
    monkeypatch.setattr(catalogue, "_windows", lambda spark, sf_dir: df)
    got, whole, fifth = (
        {r["origin"]: [round(float(e), 4) for e in r["band_entropy"]] for r in found.collect()}
        for found in (catalogue.QUERIES["mode_groups"](spark, ""), decompose.decompose(df, ["key", "origin"], trials=100), decompose.decompose(df, ["key", "origin"], trials=20))
    )
    assert whole != fifth and all(np.allclose(got[i], whole[i], atol=2e-4) for i in whole)
