"""Ridge models of other keys' windows against numpy, and the certificate of their normal equations."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from test_correlation import moved

from gaugeflow.operators import folds
from gaugeflow.operators.folds import Fit
from gaugeflow.plans import flows

LAGS, AHEAD = 7, 3


def table(spark, seed=0, keys=6, per_key=9, extra=()):
    rng = np.random.default_rng(seed)
    rows = [(f"k{k}", i, [float(v) for v in rng.normal(3 * k, 1 + k, LAGS)], [float(v) for v in rng.normal(3 * k, 1 + k, AHEAD)]) for k in range(keys) for i in range(per_key)]
    return rows, spark.createDataFrame([*rows, *extra], "key string, origin long, x array<double>, y array<double>")


def plain_ridge(x, y, penalty):
    mean, std = x.mean(axis=0), x.std(axis=0)
    std[std < 1e-8] = 1.0
    z = np.hstack([(x - mean) / std, np.ones((len(x), 1))])
    w = np.linalg.solve(z.T @ z + penalty * np.diag([1.0] * x.shape[1] + [0.0]), z.T @ y)
    return lambda new: np.hstack([(new - mean) / std, np.ones((len(new), 1))]) @ w


@pytest.mark.parametrize("block", [2, 256])
def test_models_of_the_other_folds(spark, block):
    bad = [("k0", 90, [1.0] * (LAGS - 1), [1.0] * AHEAD), ("k1", 91, [None] * LAGS, [1.0] * AHEAD), ("k2", 92, [float("nan")] * LAGS, [1.0] * AHEAD)]
    rows, windows = table(spark, extra=bad)
    dealt = folds.with_folds(windows, 3).repartition(5).cache()
    fold = {r.key: r.fold for r in dealt.select("key", "fold").distinct().collect()}
    assert sorted(fold.values()) == [0, 0, 1, 1, 2, 2]
    fits = folds.fit_folds(dealt, LAGS, AHEAD, 2.5, block=block, width=2)
    got = {(r.key, r.origin): r.ridge for r in folds.with_forecast(dealt, fits).collect()}
    for f, fit in fits.items():
        x, y = (np.array([r[c] for r in rows if fold[r[0]] != f]) for c in (2, 3))
        model = plain_ridge(x, y, 2.5)
        assert fit.n == len(x)
        for r in rows:
            if fold[r[0]] == f:
                assert got[r[0], r[1]] == pytest.approx(model(np.array([r[2]]))[0].tolist(), rel=1e-8, abs=1e-8)
    assert got["k0", 90] is None
    judged = {r.fold: (r.n_fit, r.residual) for r in folds.certificate(dealt, fits, LAGS, AHEAD, 2.5).collect()}
    assert all(judged[f][0] == fits[f].n and judged[f][1] < 1e-10 for f in fits)
    spoilt = {f: Fit(fit.weights * (1 + 1e-3), fit.mean, fit.std, fit.n) for f, fit in fits.items()}
    assert all(r.residual > 1e-6 for r in folds.certificate(dealt, spoilt, LAGS, AHEAD, 2.5).collect())


def test_units_of_keys_and_constant_columns(spark):
    rows, windows = table(spark, extra=[("flat", i, [4.0] * LAGS, [5.0] * AHEAD) for i in range(3)])
    scaled, norm = folds.normalised(windows)
    stats = {r.key: (r.mean, r.std) for r in norm.collect()}
    assert stats["flat"] == (4.0, 1.0)
    for r in scaled.collect():
        if r.key == "flat":
            assert set(r.x) == {0.0} and set(r.y) == {1.0}
    own = np.concatenate([r.x for r in scaled.collect() if r.key == "k3"])
    assert own.mean() == pytest.approx(0, abs=1e-12) and own.std() == pytest.approx(1)
    one = spark.createDataFrame([("a", 0, [1.0] * LAGS, [2.0] * AHEAD, 0), ("b", 0, [1.0] * LAGS, [4.0] * AHEAD, 1)], "key string, origin long, x array<double>, y array<double>, fold int")
    fits = folds.fit_folds(one, LAGS, AHEAD, 0.0)  # singular: nothing varies, so the mean is forecast
    assert [folds.with_forecast(one, fits).where(f"key = '{k}'").first().ridge for k in "ab"] == [[4.0] * AHEAD, [2.0] * AHEAD]


def test_a_capped_fit_takes_the_same_windows_every_time(spark):
    rows, windows = table(spark)
    some = {(r.key, r.origin) for r in folds.first_by_hash(windows, 10).collect()}
    assert len(some) == 10 and some == {(r.key, r.origin) for r in folds.first_by_hash(windows.repartition(7), 10).collect()}
    assert folds.first_by_hash(windows, 1000).count() == len(rows)


def test_more_folds_than_sums_are_held(spark, monkeypatch):
    rows, windows = table(spark)
    dealt = folds.with_folds(windows, 6).repartition(3).cache()
    whole = folds.fit_folds(dealt, LAGS, AHEAD, 2.5)
    monkeypatch.setattr(folds, "HELD", 1)
    for fold, fit in folds.fit_folds(dealt, LAGS, AHEAD, 2.5).items():
        assert fit.n == whole[fold].n and fit.weights == pytest.approx(whole[fold].weights, rel=1e-9, abs=1e-12)


def test_windows_are_not_shuffled(spark, tmp_path):
    rng = np.random.default_rng(5)
    first, users = datetime(2024, 1, 1), 24
    hours = {u: [0, *rng.choice(range(1, 719), 30, replace=False).tolist(), 719] for u in range(users)}
    events = [(u, first + timedelta(hours=int(h)), float(rng.normal(u, 1))) for u in hours for h in hours[u]]
    spark.createDataFrame(events, "user_id long, ts timestamp, value double").write.parquet(str(tmp_path / "events.parquet"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large for it
    try:
        before = moved(spark)
        got = flows.ridge_out_of_sample(spark, str(tmp_path)).first()
        shuffled = moved(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert (got.n_basins, got.n_samples) == (users, 28 * users)
    # each event twice and the users' scores at 24 lead hours, but not 28 windows for each join
    assert shuffled < 2 * len(events) + 3 * 24 * users
