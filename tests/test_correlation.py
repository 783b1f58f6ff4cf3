"""Correlations of many series against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.operators.correlation import correlations, energy_shares


def series(spark, rows):
    return spark.createDataFrame([(k, [float(v) for v in s]) for k, s in rows.items()], "key string, s array<double>")


@pytest.mark.parametrize(("block", "chunk"), [(256, 4096), (4, 7)])
def test_matrix(spark, block, chunk):
    rng = np.random.default_rng(1)
    base = rng.normal(size=40)
    rows = {f"k{i:02d}": 1e6 * (i % 3) + base * (i % 5) + rng.normal(size=40) for i in range(15)} | {"flat": [7.0] * 40, "twin": base, "minus": -base}
    got = {(r.a, r.b): r.corr for r in correlations(series(spark, rows), block, chunk).collect()}
    names = sorted(rows)
    assert sorted(got) == [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    for (a, b), c in got.items():
        want = 0.0 if "flat" in (a, b) else np.corrcoef(rows[a], rows[b])[0, 1]
        assert c == pytest.approx(want, abs=1e-9)
    assert got["minus", "twin"] == pytest.approx(-1)


def test_other_shapes(spark):
    assert correlations(series(spark, {"a": [1, 2]})).count() == 0
    assert correlations(series(spark, {}).limit(0)).count() == 0
    with pytest.raises(ValueError):
        correlations(series(spark, {"a": [1, 2], "b": [1]}))


def test_energy_shares(spark):
    rng = np.random.default_rng(2)
    flood = rng.normal(size=50)
    rows = {"flood": flood, "m1": flood * 2, "m2": -flood, "m3": rng.normal(size=50), "flat": [1.0] * 50}
    got = {r.key: r for r in energy_shares(series(spark, rows), "flood").collect()}
    weight = {k: abs(np.corrcoef(rows[k], flood)[0, 1]) * np.std(rows[k]) if k != "flat" else 0.0 for k in rows if k != "flood"}
    total = sum(weight.values())
    for k, w in weight.items():
        assert [got[k].weight, got[k].share, got[k].rms] == pytest.approx([w, w / total, np.sqrt(np.mean(np.square(rows[k])))])
    best = sorted(weight, key=lambda k: -weight[k])[:2]
    assert {k: got[k]["rank"] for k in weight} == {k: best.index(k) + 1 if k in best else None for k in weight}
    assert [r.top_share for r in got.values()] == pytest.approx([sum(weight[k] for k in best) / total] * 4)


def moved(spark):
    """Rows that all stages so far have shuffled."""
    context, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    context.listenerBus().waitUntilEmpty()
    none = spark.sparkContext._jvm.java.util.ArrayList()
    stages = context.statusStore().stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_series_are_not_shuffled_for_each_pair(spark):
    rng = np.random.default_rng(3)
    rows = series(spark, {f"k{i:03d}": rng.normal(size=12) for i in range(160)})
    before = moved(spark)
    found = correlations(rows, 4, 5).collect()  # 40 blocks, 3 chunks
    assert len({(r.a, r.b) for r in found}) == len(found) == 160 * 159 // 2
    assert moved(spark) - before < 3 * 160 * 3


def test_a_task_gives_its_rows_in_ascending_order(spark):
    """Equal figures have to lie together, else a result of pairs takes eight bytes a figure on disk."""
    rng = np.random.default_rng(4)
    rows = series(spark, {f"k{i:03d}": rng.normal(size=12) for i in range(60)})
    tasks = {}
    for r in correlations(rows, 8).withColumn("task", F.spark_partition_id()).collect():
        tasks.setdefault(r.task, []).append(r)
    assert len(tasks) > 4 and all(t == sorted(t, key=lambda r: r.corr) for t in tasks.values())
    whole = sorted((r.a, r.b, r.corr) for t in tasks.values() for r in t)
    assert len(whole) == 60 * 59 // 2 and all(a < b for a, b, _ in whole)
    assert sorted(map(tuple, correlations(rows, 8, rows=100).collect())) == whole  # two pairs of blocks at a time


def test_no_pair_is_lost_to_a_value_that_is_not_a_number(spark):
    got = {(r.a, r.b): r.corr for r in correlations(series(spark, {"a": [1, 2, 4], "b": [1, float("nan"), 3], "c": [4, 2, 1], "d": [3, 1, 2]}), 2, rows=1).collect()}
    assert sorted(got) == [("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d")]
    assert all(np.isnan(c) == ("b" in pair) for pair, c in got.items())
