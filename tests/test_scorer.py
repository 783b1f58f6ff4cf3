"""The whole scorer against numpy, from the same rows by another way."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import scorer
from gaugeflow.operators.metrics import high_flow

AHEAD = 48


def nse(o, p):
    total = ((o - o.mean()) ** 2).sum()
    return 1 - ((o - p) ** 2).sum() / total if total > 1e-10 else None


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(7)
    obs, pred, bar = {}, {}, {}
    for k, key in enumerate(["a", "b", "c", "flat"]):
        for origin in range(6):
            y = rng.gamma(2, 3, AHEAD) + 1000 * k if key != "flat" else np.full(AHEAD, 4.0)
            if key == "b":
                y[12:24] = 5.0  # no variation in one bucket of any window
            obs[key, origin], pred[key, origin], bar[key, origin] = y, y + rng.normal(0, 1, AHEAD), y + rng.normal(0, 2, AHEAD)
    rows = [("m", k, o, h + 1, float(obs[k, o][h]), float(pred[k, o][h]), float(bar[k, o][h])) for k, o in obs for h in range(AHEAD)]
    rows += [("perfect", k, o, h, y, y, b) for _, k, o, h, y, _, b in rows]
    table = spark.createDataFrame(rows, "model string, key string, origin long, lead_h int, obs double, pred double, bar double")
    flags = [(k, o, o % 2 == 0, o % 3 == 0) for k in "abc" for o in range(5)]  # windows 5 and key flat have none: seen
    std = {k: float(2 + i) for i, k in enumerate(["a", "b", "c", "flat"])}
    return obs, pred, bar, table, spark.createDataFrame(flags, "key string, origin long, input_seen boolean, target_seen boolean"), spark.createDataFrame(list(std.items()), "key string, std double"), std


def pooled(x, key, lo=0, hi=AHEAD, keep=lambda o: True):
    return np.concatenate([v[lo:hi] for (k, o), v in x.items() if k == key and keep(o)] or [np.zeros(0)])


def test_document_equals_numpy(spark, case):
    obs, pred, bar, table, flags, scale, std = case
    tails = high_flow(table, "pred", "model", "key")
    docs = {r.model: r.document.asDict(recursive=True) for r in scorer.evaluate(table, scale, "dev", flags, tails).collect()}
    d, keys = docs["m"], ["a", "b", "c", "flat"]
    whole = [nse(pooled(obs, k), pooled(pred, k)) or 0.0 for k in keys]
    assert (d["n_basins"], d["n_basins_total"], d["n_samples"]) == (4, 4, 24)
    assert [d["median_nse"], d["mean_nse"], d["std_nse"]] == pytest.approx([np.median(whole), np.mean(whole), np.std(whole)], rel=1e-9)
    assert d["mean_nse_clip"] == pytest.approx(np.mean(np.maximum(whole, -1)))
    assert d["pct_nse_05"] == pytest.approx(100 * np.mean(np.array(whole) > 0.5))
    for name, lo in (("h1-12", 0), ("h13-24", 12), ("h25-36", 24), ("h37-48", 36)):
        for field, x in (("horizon_nse", pred), ("horizon_nse_persistence", bar)):
            each = [nse(pooled(obs, k, lo, lo + 12), pooled(x, k, lo, lo + 12)) for k in keys]
            assert d[field][name] == pytest.approx(np.median([v for v in each if v is not None]), rel=1e-9)
    error = lambda x, h: sum(((x[k, o][h] - obs[k, o][h]) / std[k]) ** 2 for k, o in obs)
    assert d["skill_by_lead"] == pytest.approx([1 - error(pred, h) / error(bar, h) for h in range(AHEAD)], rel=1e-9)
    states = {"dev_clean": lambda o: o < 5 and not (o % 2 == 0 or o % 3 == 0), "dev_overlap": lambda o: o == 5 or o % 2 == 0 or o % 3 == 0, "dev_target_seen": lambda o: o == 5 or o % 3 == 0}
    for name, keep in states.items():
        each = [nse(pooled(obs, k, keep=keep), pooled(pred, k, keep=keep)) for k in "abc"]
        assert d["subset_median_nse"][name] == pytest.approx(np.median([v for v in each if v is not None]), rel=1e-9)
    by_key = {x["key"]: x for x in d["per_basin"]}
    assert [x["key"] for x in d["per_basin"]] == sorted(keys) and "h13-24" not in by_key["b"]["horizon"] and not by_key["flat"]["horizon"]
    o, p = pooled(obs, "c"), pooled(pred, "c")  # a mean of 2000 and a deviation of some units: centred moments keep the digits
    r, alpha, beta = np.corrcoef(o, p)[0, 1], p.std() / o.std(), p.mean() / o.mean()
    assert by_key["c"]["kge"] == pytest.approx(1 - np.sqrt((r - 1) ** 2 + (alpha - 1) ** 2 + (beta - 1) ** 2), rel=1e-9)
    assert [by_key["c"]["rmse"], by_key["c"]["mae"]] == pytest.approx([np.sqrt(((p - o) ** 2).mean()), np.abs(p - o).mean()])
    assert by_key["flat"]["nse"] == 0.0 and docs["perfect"]["mean_nse"] == 0.75 and docs["perfect"]["median_fhv"] == pytest.approx(0)


def test_subsets_are_of_the_dev_split_and_keys_can_be_left_out(spark, case):
    *_, table, flags, scale, _ = case
    test = scorer.evaluate(table.where("model = 'm'"), scale, "test", flags).first().document
    assert test.subset_median_nse == {} and test.median_fhv is None and len(test.skill_by_lead) == AHEAD
    assert "per_basin" not in scorer.score_document(table, scale, with_keys=False).first().document.asDict()
    rows = scorer.key_scores(scorer.moments_cube(table, flags), scale)
    assert rows.where("key is not null").count() == 8
    assert scorer.score_document(table.limit(0), scale).count() == 0


def test_document_reads_its_rows_once(spark, case):
    """One look at the rows: the plan of the document holds a single scan of them."""
    *_, table, flags, scale, _ = case
    import tempfile

    path = tempfile.mkdtemp()
    table.write.mode("overwrite").parquet(path)
    plan = scorer.score_document(spark.read.parquet(path), scale, flags)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


def test_baseline_rows_hold_every_model(spark):
    x = [float(i % 7) for i in range(336)]
    windows = spark.createDataFrame([("a", 335, x, [1.0] * AHEAD)], "key string, origin long, x array<double>, y array<double>")
    rows = scorer.baseline_rows(windows)
    assert rows.groupBy("model").count().where("count <> 48").count() == 0 and rows.select("model").distinct().count() == 4
    assert rows.where("model = 'persistence'").agg(F.min("pred"), F.max("pred"), F.max("bar")).first() == (x[-1], x[-1], x[-1])
