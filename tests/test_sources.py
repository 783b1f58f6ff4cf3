"""Round trips of files through the Python data sources, and what failed jobs leave behind."""

import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.sources import arrays, documents, runs
from gaugeflow.sources.two_phase import MANIFEST


def windows_file(path, n=50, test=False):
    rng = np.random.default_rng(1)
    members = {"X": rng.random((n, 8, 3), np.float32), "basin_id": (np.arange(n) % 4).astype(np.int32)}
    if not test:
        members |= {"split": (np.arange(n) % 5 == 0).astype(np.int8), "y": rng.random((n, 2), np.float32), "y_aux": rng.random((n, 2, 2))}
    np.savez(path, **members)
    return members


def test_split_aware_reader(spark, tmp_path):
    names = ("rain", "wind", "flow")
    members = windows_file(f"{tmp_path}/train.npz")
    for split, keep in (("train", members["split"] == 0), ("validation", members["split"] == 1), ("all", np.ones(50, bool))):
        found = arrays.read_windows(spark, f"{tmp_path}/train.npz", split, ("flow", "rain"), names)
        got = {r.row: r for r in found.collect()}
        assert sorted(got) == np.flatnonzero(keep).tolist() and found.columns == ["row", "basin_id", "split", "y", "flow", "rain"]
        for i, r in got.items():
            assert r.flow == members["X"][i, :, 2].tolist() and r.rain == members["X"][i, :, 0].tolist() and r.y == members["y"][i].tolist()
            assert (r.basin_id, r.split) == (i % 4, int(members["split"][i]))
    windows_file(f"{tmp_path}/test.npz", 7, test=True)
    assert arrays.read_windows(spark, f"{tmp_path}/test.npz", "test", ("flow",), names).count() == 7
    for path, split, channel in (("train", "test", "flow"), ("train", "dev", "flow"), ("test", "train", "flow"), ("train", "train", "snow")):
        with pytest.raises(ValueError):
            arrays.read_windows(spark, f"{tmp_path}/{path}.npz", split, (channel,), names)


def test_the_split_is_filtered_by_the_reader(spark, tmp_path):
    windows_file(f"{tmp_path}/train.npz")
    found = arrays.read_npz(spark, f"{tmp_path}/train.npz", "row long, split int").where("split in (1, 7)")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Filter (split" not in plan and found.count() == 10
    assert arrays.read_npz(spark, f"{tmp_path}/train.npz", "row long, split int").where("split = 1 and row >= 25").count() == 5


@pytest.mark.parametrize("per_file", [3, 1000])
def test_npz_round_trip(spark, tmp_path, per_file):
    rows = [(i, i % 2 == 0, f"n{i}é" * (i % 3), float(i) if i % 4 else None, [[float(i), -1.5], [2.0, float("nan")], [0.0, float("inf")]], [i, 2 * i]) for i in range(40)]
    table = spark.createDataFrame(rows, "id long, even boolean, name string, v double, x array<array<double>>, k array<int>").repartition(3)
    path = f"{tmp_path}/t"
    arrays.write_npz(table, path, per_file=per_file)
    back = arrays.read_npz(spark, path)
    assert {f.name: f.dataType for f in back.schema.fields if f.name != "row"} == {f.name: f.dataType for f in table.schema.fields} | {"x": back.schema["x"].dataType}
    got = sorted((tuple(r)[1:] for r in back.select("row", *table.columns).collect()), key=lambda r: r[0])
    for a, b in zip(got, rows, strict=True):
        assert a[:3] == b[:3] and a[5] == b[5] and (a[3] == b[3] or math.isnan(a[3]) and b[3] is None)
        np.testing.assert_array_equal(a[4], b[4])
    arrays.write_npz(table.where("id < 5"), path, mode="append")
    assert arrays.read_npz(spark, path).count() == 45
    arrays.write_npz(table.where("id < 5"), path)
    assert arrays.read_npz(spark, path).count() == 5
    left = {f for _, _, files in os.walk(path) for f in files}
    assert left == {MANIFEST, *json.load(open(f"{path}/{MANIFEST}"))["files"]}


def test_failed_tasks_leave_the_table_as_it_was(spark, tmp_path):
    path = f"{tmp_path}/t"
    good = spark.range(20).select("id", F.array("id", "id").alias("x")).repartition(2)
    arrays.write_npz(good, path)
    before = {f for _, _, files in os.walk(path) for f in files}
    ragged = spark.range(20).select("id", F.array_repeat("id", F.when(F.col("id") == 17, 3).otherwise(2)).alias("x")).repartition(4)
    with pytest.raises(Exception, match="differ in length"):
        arrays.write_npz(ragged, path, per_file=4)
    assert {f for _, _, files in os.walk(path) for f in files} == before and not os.path.exists(f"{path}/_temporary")
    assert arrays.read_npz(spark, path).count() == 20
    with pytest.raises(Exception, match="holds nulls"):
        arrays.write_npz(spark.createDataFrame([(None,), (1,)], "id long"), path)
    open(f"{path}/part-stray.npz", "wb").close()  # a dead job's file that no manifest names
    assert arrays.read_npz(spark, path).count() == 20


def test_normalizer_files(spark, tmp_path):
    np.savez(f"{tmp_path}/norm.npz", mean=np.arange(6.0).reshape(2, 3), std=np.ones((2, 3)), strategy=np.array("per_basin_zscore"))
    norm = arrays.read_normalizer(spark, f"{tmp_path}/norm.npz")
    assert sorted(tuple(r) for r in norm.collect()) == [(b, c, 3.0 * b + c, 1.0, "per_basin_zscore") for b in range(2) for c in range(3)]
    shifted = norm.select((F.col("basin_id") + 7).alias("basin_id"), "channel", "mean", "std")
    arrays.write_normalizer(shifted, f"{tmp_path}/back", "global_zscore")
    again = sorted(tuple(r) for r in arrays.read_normalizer(spark, f"{tmp_path}/back").collect())
    assert again == [(b + 7, c, 3.0 * b + c, 1.0, "global_zscore") for b in range(2) for c in range(3)]


def test_documents_are_read_as_runs_again(spark, tmp_path):
    schema = "folder string, file string, median_nse double, mean_nse double, n_basins int, horizon_nse map<string,double>, skill_by_lead array<double>, per_basin array<struct<basin_id:int, nse:double>>, day date"
    rows = [("a", "metrics_dev.json", 0.5, float("nan"), 3, {"h1-12": 0.9, "h13-24": float("-inf")}, [0.1, None], [(1, 0.25)], None), ("b c", "metrics_dev.json", None, 1e-7, None, {}, [], [], None)]
    table = spark.createDataFrame(rows, schema)
    documents.write_documents(table.repartition(2), f"{tmp_path}/runs")
    text = json.load(open(f"{tmp_path}/runs/a/metrics_dev.json"))
    assert text["mean_nse"] is None and text["horizon_nse"] == {"h1-12": 0.9, "h13-24": None} and text["per_basin"] == [{"basin_id": 1, "nse": 0.25}]
    got = {r.run: r for r in runs.read_metrics(spark, f"{tmp_path}/runs").collect()}
    assert got["a"].median_nse == 0.5 and got["a"].corrupt is None and got["b c"].mean_nse == 1e-7 and got["b c"].median_nse is None
    documents.write_documents(table.where("folder = 'a'").withColumn("median_nse", F.lit(0.75)), f"{tmp_path}/runs")
    assert json.load(open(f"{tmp_path}/runs/a/metrics_dev.json"))["median_nse"] == 0.75 and os.path.exists(f"{tmp_path}/runs/b c/metrics_dev.json")
    documents.write_documents(table.where("folder = 'a'"), f"{tmp_path}/runs", mode="overwrite")
    assert not os.path.exists(f"{tmp_path}/runs/b c/metrics_dev.json")
    for folder in ("../x", "", "_y"):
        with pytest.raises(Exception, match="no name for a file"):
            documents.write_documents(table.limit(1).withColumn("folder", F.lit(folder)), f"{tmp_path}/runs")


def test_markdown_table(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"run|{i}", 0.5 + i / 7, None if i == 2 else i) for i in range(40)], "place long, run string, test double, n int").repartition(5).orderBy("place")
    documents.write_markdown(rows, f"{tmp_path}/RESULTS.md", "Results", bold="test")
    documents.write_markdown(rows, f"{tmp_path}/RESULTS.md", "Results", bold="test")  # again: replaced
    lines = open(f"{tmp_path}/RESULTS.md").read().split("\n")
    assert lines[:4] == ["# Results", "", "| place | run | test | n |", "|---:|---|---:|---:|"]
    assert lines[4:-1] == [f"| {i} | run\\|{i} | **{0.5 + i / 7:.4f}** | {'' if i == 2 else i} |" for i in range(40)]
    assert os.listdir(tmp_path) == ["RESULTS.md"]
    documents.write_markdown(rows.limit(0), f"{tmp_path}/empty.md")
    assert open(f"{tmp_path}/empty.md").read() == "| place | run | test | n |\n|---:|---|---:|---:|\n"
