"""Order statistics by refined histograms against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.operators.metrics import high_flow
from gaugeflow.operators.selection import medians, order_statistics, quantiles, top_sums

KIND = "key string, v double, w double"


def values(seed=0):
    rng = np.random.default_rng(seed)
    by_key = {
        "ties": rng.integers(-2, 3, 400) * 1.0,
        "zeros": np.concatenate([np.zeros(300), rng.random(30)]),
        "close": 1 + rng.integers(0, 2000, 500) * 2.0**-52,
        "wide": rng.choice([-1, 1], 300) * 10.0 ** rng.integers(-300, 300, 300),
        "one": np.array([7.5]),
        "two": np.array([-3.0, 4.0]),
        "ends": np.array([float("-inf"), -1.0, 2.0, 5e-324, -5e-324, 1.7e308, -1.7e308, float("inf"), float("inf")]),
    }
    rows = [(k, float(x), float(rng.integers(0, 9))) for k, xs in by_key.items() for x in xs]
    rows += [("ties", None, 1.0), ("ties", float("nan"), 2.0), ("none", None, 1.0), ("none", float("nan"), 1.0), (None, 1.0, 1.0), ("zeros", -0.0, 3.0)]
    return [rows[i] for i in rng.permutation(len(rows))]


def fine(rows, key):
    return [(v, w) for k, v, w in rows if k == key and v is not None and not math.isnan(v)]


@pytest.mark.parametrize("few", [1, 8, 4096])
def test_ranks_and_sums(spark, few):
    rows = values()
    table = spark.createDataFrame(rows, KIND)
    ranks = {"first": F.lit(1), "mid": F.floor((F.col("n_rows") + 1) / 2), "late": F.ceil(F.col("n_rows") * 0.9), "out": F.col("n_rows") + 1}
    got = {(r["key"], r["name"]): r for r in order_statistics(table, ["key"], "v", ranks, ["w"], few=few).collect()}
    keys = {k for k, *_ in rows} - {"none", None}
    assert set(got) == {(k, n) for k in keys for n in ("first", "mid", "late")}
    for (key, name), r in got.items():
        own = fine(rows, key)
        xs = sorted(v for v, _ in own)
        rank = {"first": 1, "mid": (len(xs) + 1) // 2, "late": math.ceil(len(xs) * 0.9)}[name]
        assert (r["n_rows"], r["rank"], r["value"]) == (len(xs), rank, xs[rank - 1])
        assert (r["below"], r["equal"]) == (sum(x < r["value"] for x in xs), sum(x == r["value"] for x in xs))
        assert r["above_w"] == sum(w for v, w in own if v > r["value"]) and r["equal_w"] == sum(w for v, w in own if v == r["value"])


def test_quantiles_and_medians_skip_nan(spark):
    rows = [r for r in values(1) if r[0] != "ends"]
    table = spark.createDataFrame(rows, KIND)
    for r in quantiles(table, ["key"], "v", {"q0": 0.0, "q3": 0.3, "q1": 1.0}, few=2).collect():
        own = [v for v, _ in fine(rows, r["key"])]
        assert [r["q0"], r["q3"], r["q1"]] == pytest.approx(list(np.quantile(own, [0, 0.3, 1])), rel=1e-12)
    for r in medians(table, ["key"], ["v", "w"]).collect():
        own = [x for k, v, w in rows for x in [v if r["column"] == "v" else w] if k == r["key"] and x is not None]
        assert r["median"] == pytest.approx(float(np.nanmedian(own)), rel=1e-12)
    whole = quantiles(table, [], "w", {"m": 0.5}, few=1).collect()
    assert [(r["n_rows"], r["m"]) for r in whole] == [(len(rows), float(np.median([w for *_, w in rows])))]
    assert quantiles(table.limit(0), [], "w", {"m": 0.5}).count() == 0 and quantiles(table.limit(0), ["key"], "w", {"m": 0.5}).count() == 0


def test_top_sums_take_as_many_of_equal_values_as_asked(spark):
    rows = [("a", float(x), 0.0) for x in [5, 5, 5, 4, 1, 1]] + [("b", -2.0, 0.0)]
    got = top_sums(spark.createDataFrame(rows, KIND), ["key"], "v", F.least(F.lit(2), F.col("n_rows")), few=1)
    assert sorted(map(tuple, got.collect())) == [("a", 2, 10.0), ("b", 1, -2.0)]


def test_a_hot_key(spark):
    table = spark.range(200_000).select(F.when(F.col("id") % 50 > 0, "hot").otherwise(F.col("id").cast("string")).alias("key"), F.hash("id").cast("double").alias("v"))
    found = quantiles(table, ["key"], "v", {"m": 0.5}).where("key = 'hot'").collect()
    want = table.where("key = 'hot'").agg(F.expr("percentile(v, 0.5)")).first()[0]
    assert found[0]["m"] == want


def test_high_flow_by_hand(spark):
    """The top tercile of ten values begins at the interpolated quantile; the top 2 % are one value, of each side's own order."""
    rng = np.random.default_rng(2)
    rows = []
    for key, obs in {"a": list(rng.random(300)), "b": [1.0] * 7 + [2.0] * 3, "c": [0.0] * 5, "d": [3.0]}.items():
        rows += [(key, float(o), float(o * 0.8 + 0.1)) for o in obs]
    got = {r["key"]: (r["highflow_beta"], r["fhv"]) for r in high_flow(spark.createDataFrame(rows, "key string, obs double, p double"), "p").collect()}
    for key, (beta, fhv) in got.items():
        o, p = (np.array([r[i] for r in rows if r[0] == key]) for i in (1, 2))
        top = o >= np.quantile(o, 2 / 3)
        k = max(1, round(0.02 * len(o)))
        a, b = np.sort(o)[-k:].sum(), np.sort(p)[-k:].sum()
        if key == "c":
            assert (beta, fhv) == (None, None)
        else:
            assert beta == pytest.approx(p[top].sum() / o[top].sum()) and fhv == pytest.approx((b - a) / a * 100)
