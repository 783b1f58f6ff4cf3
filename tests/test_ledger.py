"""Pieces that are written once, whatever is killed in between; folders that are watched."""

import json
import os

import pytest
from pyspark.sql import functions as F

from gaugeflow.operators.configs import merge_configs
from gaugeflow.sources.ledger import Ledger, append_rows, cached, settings_key
from gaugeflow.streaming import watch

ROW = "piece string, v long"


def totals(rows):
    return rows.groupBy("piece").agg(F.sum("v").alias("v"))


def test_killed_between_write_and_commit(spark, tmp_path, monkeypatch):
    inputs = spark.createDataFrame([(f"p{i % 9}/x=1 ", i) for i in range(90)], ROW)
    ledger = Ledger(spark, f"file://{tmp_path}/t", ROW, "piece")
    commit, calls = Ledger.commit, []

    def dies(self, pieces):
        calls.append(1)
        if len(calls) == 2:
            raise KeyboardInterrupt
        commit(self, pieces)

    monkeypatch.setattr(Ledger, "commit", dies)
    with pytest.raises(KeyboardInterrupt):
        ledger.run(inputs, totals, steps=4)
    first = {r.piece: r.v for r in ledger.read().collect()}
    on_disk = spark.read.parquet(f"file://{tmp_path}/t/data").count()
    assert 0 < len(first) < on_disk  # the second step's rows are there, but nobody reads them
    made = []

    def counted(rows):
        made.extend(r.piece for r in rows.select("piece").distinct().collect())
        return totals(rows)

    again = Ledger(spark, f"file://{tmp_path}/t", ROW, "piece").run(inputs, counted, steps=4)
    want = {r.piece: r.v for r in totals(inputs).collect()}
    assert {r.piece: r.v for r in again.collect()} == want and again.count() == 9
    assert set(made) == set(want) - set(first)  # what was done stays done
    assert ledger.run(inputs, lambda rows: 1 / 0).count() == 9


def test_a_piece_done_twice_is_replaced_and_empty_pieces_count(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/t", ROW, "piece")
    assert ledger.read().count() == 0
    ledger.write(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], ROW))
    ledger.write(spark.createDataFrame([("a", 7)], ROW))
    ledger.write(spark.createDataFrame([], ROW), spark.createDataFrame([("c",)], "piece string"))
    assert sorted(map(tuple, ledger.read().collect())) == [("a", 7), ("b", 3)]
    assert sorted(r.piece for r in ledger.committed().collect()) == ["a", "b", "c"]


def test_cache_is_named_by_settings(spark, tmp_path):
    root, made = f"file://{tmp_path}", []

    def make():
        made.append(1)
        return spark.range(3)

    for settings in ({"seed": 1, "f": 0.12}, {"f": 0.12, "seed": 1}, {"seed": 2, "f": 0.12}):
        assert cached(spark, root, "split", settings, make).count() == 3
    assert len(made) == 2
    cached(spark, root, "split", {"seed": 1, "f": 0.12}, make, force=True)
    os.remove(f"{tmp_path}/split_{settings_key({'seed': 2, 'f': 0.12})}/_SUCCESS")  # a killed writer leaves none
    cached(spark, root, "split", {"seed": 2, "f": 0.12}, make)
    assert len(made) == 4
    layers = spark.createDataFrame([(1, 1, '{"seed": 1}'), (1, 2, '{"f": 0.12}')], "id long, priority int, config string")
    assert merge_configs(layers).first()["key"] == settings_key({"seed": 1, "f": 0.12})


def test_appended_rows(spark, tmp_path):
    for epoch in range(3):
        append_rows(spark.createDataFrame([(epoch, 0.5 + epoch, None)], "epoch int, nse double, ema double"), f"file://{tmp_path}/h")
        got = spark.read.csv(f"file://{tmp_path}/h", header=True, schema="epoch int, nse double, ema double")
        assert sorted(r.epoch for r in got.collect()) == list(range(epoch + 1))


def put(root, run, score, name="summary.json"):
    os.makedirs(f"{root}/{run}", exist_ok=True)
    with open(f"{root}/{run}/.{name}", "w") as f:
        f.write(score if isinstance(score, str) else json.dumps({"dev_median_nse": score, "more": [1]}, indent=1))
    os.rename(f"{root}/{run}/.{name}", f"{root}/{run}/{name}")


def boards(spark, out):
    return [(r.place, r.run, r.value, r["class"]) for r in watch.current_board(spark, out).orderBy("place").collect()]


def test_board_of_a_watch_that_is_killed_and_restarted(spark, tmp_path, monkeypatch):
    root, out = f"{tmp_path}/runs", f"file://{tmp_path}/out"
    put(root, "a", 0.4)
    put(root, "b", 0.605)
    put(root, "none", None)
    watch.watch_board(spark, root, out, 0.6, every=None).awaitTermination()
    assert boards(spark, out) == [(1, "b", 0.605, "level"), (2, "a", 0.4, "worse")]
    put(root, "c 1", 0.9)
    put(root, "a", 0.7, "summary_2.json")  # scored again
    os.utime(f"{root}/a/summary_2.json", (2e9, 2e9))
    write, calls = Ledger.write, []

    def dies(self, *args):
        write(self, *args)
        calls.append(1)
        if len(calls) == 1:  # the summaries are committed, the board is not
            raise RuntimeError("killed")

    monkeypatch.setattr(Ledger, "write", dies)
    with pytest.raises(Exception, match="killed"):
        watch.watch_board(spark, root, out, 0.6, every=None).awaitTermination()
    assert [b[1] for b in boards(spark, out)] == ["b", "a"]  # still the board before
    watch.watch_board(spark, root, out, 0.6, every=None).awaitTermination()
    assert boards(spark, out) == [(1, "c 1", 0.9, "better"), (2, "a", 0.7, "better"), (3, "b", 0.605, "level")]
    assert Ledger(spark, f"{out}/seen", watch.SEEN, "batch").read().count() == 5
    watch.watch_board(spark, root, out, 0.6, every=None).awaitTermination()
    assert len(boards(spark, out)) == 3


def test_waiting_for_files_survives_failures(spark, tmp_path):
    folder, out, ran = f"{tmp_path}/in", f"file://{tmp_path}/out", []
    os.makedirs(folder)
    wait = lambda action: watch.wait_for_files(spark, folder, ["x.txt", "y.txt"], action, out, every=0.1, rounds=1)
    open(f"{folder}/x.txt", "w").close()
    assert not wait(lambda: ran.append("early"))
    open(f"{folder}/y.txt", "w").close()
    with pytest.raises(ZeroDivisionError):
        wait(lambda: 1 / 0)
    assert wait(lambda: ran.append("once")) and wait(lambda: ran.append("twice")) and ran == ["once"]


def test_ages_of_files(spark, tmp_path):
    put(f"{tmp_path}/r", "a", 0.1)
    os.makedirs(f"{tmp_path}/r/b")
    open(f"{tmp_path}/r/b/summary.json", "w").close()
    for run in "ab":
        os.utime(f"{tmp_path}/r/{run}/summary.json", (1_700_000_000, 1_700_000_000))
    got = watch.file_ages(spark, f"{tmp_path}/r/*/summary.json", "2023-11-14 22:43:20").collect()
    assert sorted((r.run, r.file, r.minutes) for r in got) == [("a", "summary.json", 30.0)]  # b's has no content
