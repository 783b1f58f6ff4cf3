"""The split builder: components, dense labels, packing and the proof that nothing leaks."""

import random

import numpy as np
import pytest

from gaugeflow.operators import splits
from gaugeflow.operators.ranks import dense_labels, running

WINDOW = "key string, origin long, x array<double>"


def windows(spark, rows):
    return spark.createDataFrame([(k, o, [float(v) for v in x]) for k, o, x in rows], WINDOW)


def chained(key, start):
    base = list(range(start, start + 400))
    return [(key, 5, base[0:336]), (key, 7, base[24:360]), (key, 9, base[48:384]), (key, 11, [-1] * 336)]


def test_a_chain_merges_and_constant_runs_do_not(spark):
    rows = [*chained("a", 0), *chained("b", 0), ("c", 1, [3.0] * 4), ("c", 2, [-1.0] * 336), ("c", 3, [0.0, -0.0] * 168), ("c", 4, [-0.0, 0.0] * 168)]
    got = {(r.key, r.origin): r.component for r in splits.overlap_components(windows(spark, rows)).collect()}
    for key in "ab":
        assert [got[key, o] for o in (5, 7, 9, 11)] == [5, 5, 5, 11]
    assert [got["c", o] for o in (1, 2, 3, 4)] == [1, 2, 3, 4]  # short, constant, and zeros of either sign are no fingerprints


def test_labels_are_dense_by_first_appearance(spark):
    rng = random.Random(3)
    rows = [(k, rng.randrange(9) * 1000, i) for k in ("a", None) for i in range(60)]
    table = spark.createDataFrame(rng.sample(rows, len(rows)), "key string, component long, at long").repartition(7)
    got = {(r.key, r.component): r.label for r in dense_labels(table, ["key"], "component", "at").collect()}
    want, seen = {}, {"a": 0, None: 0}
    for k, c, _ in rows:
        if (k, c) not in want:
            want[k, c] = seen[k]
            seen[k] += 1
    assert got == want


def test_running_sums_over_ranges_of_one_hot_key(spark):
    rng = np.random.default_rng(4)
    rows = [("hot" if i % 10 else None, int(v), i) for i, v in enumerate(rng.integers(0, 50, 900))]
    got = running(spark.createDataFrame(rows, "key string, size long, id long"), ["key"], ["size", "id"], ["size"])
    for key in ("hot", None):
        own = sorted((r[1], r[2]) for r in rows if r[0] == key)
        found = sorted((r["rank"], r["size"], r["id"], r["upto_size"]) for r in got.collect() if r["key"] == key)
        assert found == [(k + 1, s, i, sum(x for x, _ in own[: k + 1])) for k, (s, i) in enumerate(own)]
    assert running(spark.createDataFrame([], "key string, size long"), ["key"], ["size"]).count() == 0


def test_split_holds_out_whole_components_without_leaks(spark):
    rng = np.random.default_rng(5)
    series = rng.random(9000)
    starts = [10 * i for i in range(4)] + [100, 105, 200, 205, 300, 400]
    rows = [("many", s, series[s : s + 20]) for s in starts] + [("one", s, series[s : s + 20]) for s in range(500, 510)]
    table = windows(spark, rows)
    split = splits.build_split(table, 0.2).cache()
    got = {(r.key, r.origin): (r.label, r["size"], r.held_out) for r in split.collect()}
    assert [got["many", s][0] for s in starts] == [0, 0, 0, 0, 1, 1, 2, 2, 3, 4]
    assert {got["one", s] for s in range(500, 510)} == {(0, 10, True)}  # nothing but one component: it is taken
    sides = {}
    for (key, _), (label, _, held) in got.items():
        sides.setdefault((key, label), set()).add(held)
    assert all(len(s) == 1 for s in sides.values())
    report = {r.key: r.asDict() for r in splits.split_report(table, split, fail=True).collect()}
    assert report["many"]["n_components"] == 5 and report["many"]["largest"] == 4 and report["many"]["n_leaked"] == 0
    assert 1 <= report["many"]["n_held"] <= 4 and report["one"]["share"] == 1.0
    assert splits.build_split(table.limit(0)).count() == 0
    whole = splits.build_split(table, 0.5, mode="basin")
    assert whole.select("key", "held_out").distinct().count() == 2 and whole.count() == len(rows)
    with pytest.raises(ValueError):
        splits.build_split(table, mode="other")


def test_a_leak_is_counted_and_raised(spark):
    table = windows(spark, chained("a", 0))
    bad = spark.createDataFrame([("a", 5, 0, 2, True), ("a", 7, 0, 2, False), ("a", 9, 1, 1, False), ("a", 11, 2, 1, False)], "key string, origin long, label long, size long, held_out boolean")
    assert splits.split_report(table, bad).first()["n_leaked"] == 1
    with pytest.raises(Exception, match="windows leak: a"):
        splits.split_report(table, bad, fail=True).collect()


def test_runs_are_dealt_without_broadcasts(spark):
    """What runs explode to is far larger than the planner takes it for, so it must not be broadcast through the driver."""
    table = windows(spark, [*chained("a", 0), *chained("b", 0)])
    split = spark.createDataFrame([("a", 5, 0, 2, True)], "key string, origin long, label long, size long, held_out boolean")
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    report = plan(splits.split_report(table, split))
    assert report.count("Generate explode") == 1 and "SortMergeJoin [key" in report
    flags = plan(splits.leaked_windows(splits.grams(table.where("origin < 9")), splits.grams(table.where("origin > 7"))))
    assert "SortMergeJoin [key" in flags and ", LeftSemi, BuildRight" not in flags


def test_short_series_have_no_windows(spark):
    from gaugeflow.sources.panel import series_windows

    rows = spark.createDataFrame([("short", [1.0] * 5), ("long", [float(i) for i in range(12)]), ("none", None)], "key string, s array<double>")
    got = sorted((r.key, r.origin, r.x, r.y) for r in series_windows(rows, 4, 2, 3).collect())
    assert got == [("long", o, [float(i) for i in range(o - 3, o + 1)], [float(o + 1), float(o + 2)]) for o in (3, 6, 9)]
