import collections
import fractions
import itertools
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.functions import modes
from gaugeflow.functions.series import sample_entropy
from gaugeflow.operators import compare, reports, splits
from gaugeflow.plans import boards, catalogue

SF = "/root/testdata/sf0.001"


def test_components_are_packed_whole_under_the_cap(spark):
    rng = random.Random(3)
    rows = [(k, f"c{c}") for k, sizes in {"a": [1, 2, 3, 9, 40], "b": [60, 50], "c": [1] * 30, "d": [7]}.items() for c, n in enumerate(sizes) for _ in range(n)]
    rng.shuffle(rows)
    got = collections.defaultdict(list)
    for r in splits.assign_components(spark.createDataFrame(rows, "key string, component string"), 0.12).collect():
        got[r["key"]].append((r["size"], r["held_out"]))
    held = {k: sorted(s for s, h in v if h) for k, v in got.items()}
    # of 55 rows 7 are wanted and 13 at most; b's and d's smallest exceed the cap and stand alone; of 30 rows 4 are wanted
    assert held == {"a": [1, 2, 3], "b": [50], "c": [1] * 4, "d": [7]}
    assert splits.assign_components(spark.createDataFrame([], "key string, component string"), 0.12).count() == 0


def test_held_out_rows_by_hash_ranges(spark):
    import hashlib

    rows = [(k, i) for k, n in (("a", 500), ("b", 7), ("c", 1)) for i in range(n)] + [(None, 1)]
    got = {(r["key"], r["id"]): r["held_out"] for r in splits.hold_out_within(spark.createDataFrame(rows, "k string, i long"), "k", "i", 0.12).collect()}
    for k, n in (("a", 500), ("b", 7), ("c", 1)):
        order = sorted(range(n), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
        assert {i for i in range(n) if got[k, i]} == set(order[: max(1, int(n * 0.12))])


def test_significance_of_few_and_many_pairs(spark):
    few = [0.4, 0.1, -0.2, 0.3]
    many = [0.1 * k - 0.3 for k in range(1, 11)]
    rows = [("few", d) for d in few] + [("many", d) for d in many] + [("none", 0.0)]
    got = {r["key"]: r for r in compare.significance(spark.createDataFrame(rows, "key string, d double")).collect()}
    assert math.isclose(got["few"]["p_value"], (4 + 1) / 16) and got["few"]["test"] == "sign" and got["none"]["p_value"] == 1
    sizes = sorted(abs(round(d, 9)) for d in many if abs(d) > 1e-9)
    rank = lambda d: sizes.index(abs(round(d, 9))) + (sizes.count(abs(round(d, 9))) + 1) / 2
    ranks = [rank(d) for d in many if abs(d) > 1e-9]
    w = sum(r for r, d in zip(ranks, [d for d in many if abs(d) > 1e-9]) if d > 0)
    exact = sum(sum(r for r, s in zip(ranks, signs) if s) >= w for signs in itertools.product((0, 1), repeat=len(ranks))) / 2 ** len(ranks)
    assert abs(got["many"]["p_value"] - exact) < 0.02


def test_rules_wait_for_what_is_missing(spark):
    pairs = lambda rows: reports.adopt(spark.createDataFrame(rows, "d double, late double")).first()["adopt"]
    assert pairs([(0.05, 0.1), (0.03, 0.0), (0.02, 0.1)]) is True and pairs([(0.05, 0.1), (0.03, 0.0)]) is None
    assert pairs([(0.05, -0.3), (0.03, 0.0), (0.02, 0.1)]) is False and pairs([(0.09, 0.1), (0.03, 0.0), (-0.01, 0.1)]) is False


def test_members_must_cover_the_same_ids(spark):
    rows = [(m, i, h, float(m + i + h)) for m in range(3) for i in range(2) for h in range(2)]
    df = lambda rows: spark.createDataFrame(rows, "member int, id int, lead_h int, p double")
    assert {(r["id"], r["lead_h"]): r["p"] for r in reports.ensemble(df(rows), 3).collect()} == {(i, h): 1.0 + i + h for i in range(2) for h in range(2)}
    for wrong in (rows[1:], [*rows[1:], rows[1]]):
        with pytest.raises(Exception, match="members differ"):
            reports.ensemble(df(wrong), 3).collect()


def test_settings_are_coerced(spark):
    texts = ["True", "none", "12", "-0.5", "1e-3", "sum", "nan-ish", ""]
    got = [tuple(r["c"]) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(reports.coerced(boards.F.col("t")).alias("c")).collect()]
    assert [k for k, _ in got] == ["bool", "null", "int", "float", "float", "str", "str", "str"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", ["run_horizon_board", "seed_table", "gate_rule", "run_lookup", "grid_problems", "component_split", "seen_flags", "subset_medians", "error_concentration", "adopt_rule", "split_basin_holdout", "split_random_within"])
def test_same_rows_as_duckdb(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("events", "supplier"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(catalogue.ORACLE_SQL[name]).df()
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda v: "null" if v is None or v != v or str(v) == "<NA>" else round(float(v), 5) if isinstance(v, float) else str(v)
    key = lambda df: sorted(str(tuple(map(plain, r))) for r in df[columns].astype(object).itertuples(index=False))
    assert key(got) == key(want)


def test_lookup_through_parts_of_names(spark):
    names = ["exp_001", "exp_001_s42", "exp_010", "b", "exp", "日本語の名", "x_exp_001"]
    asked = ["exp_001", "001_s", "exp", "ex", "", "b", "p_0", "zz", "nothing of it", "本語", "語の名", "exp_001_s43", "_exp_0", "名"]
    found = reports.lookup(spark.createDataFrame([(n,) for n in names], "run string"), spark.createDataFrame([(a,) for a in asked], "asked string"))
    want = {a: a if a in names else min((n for n in names if a in n), default=None) for a in asked}
    assert {r.asked: r.run for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_entropy_of_arrays_equals_that_of_pairs(spark):
    rng = np.random.default_rng(3)
    series = [rng.normal(size=60), np.sin(np.arange(80) / 3), np.ones(20), np.array([1.0, 2.0]), np.repeat(rng.integers(0, 3, 30), 2), np.arange(50.0) ** 3]
    rows = [(i, [float(v) for v in s]) for i, s in enumerate(series)] + [(10, None), (11, [1.0, None, 2.0, 3.0]), (12, [])]
    got = {r.i: r.e for r in spark.createDataFrame(rows, "i int, x array<double>").select("i", sample_entropy(F.col("x")).alias("e")).collect()}
    assert [got[i] for i in range(len(series))] == pytest.approx([modes.sample_entropy(np.asarray(s, float)) for s in series], rel=1e-12)
    assert got[10] is None and got[11] is None and got[12] == 0.0


def test_comparison_and_seed_points(spark):
    runs = [("a", "a", 42, "done", 0.6, 0.5, 0.7, 0.1, 0.4), ("a_s7", "a", 7, "done", 0.8, 0.9, None, 0.3, None), ("c", "c", 42, "running", 0.9, 0.9, 0.9, 0.9, 0.9)]
    table = spark.createDataFrame(runs, "run string, arm string, seed int, state string, dev double, sanval double, test double, kge double, h37_48 double")
    norms = spark.createDataFrame([("a", 1.0), ("a", None), ("a", float("nan")), ("a", 2.0)], "run string, grad_norm double")
    got = [(r.place, r.run, r.verdict, r.gradient_norm) for r in reports.comparison(table, "h37_48", norms).orderBy("place").collect()]
    assert got == [(1, "a", "higher", 1.5), (2, "a_s7", "lower", None)]
    points = sorted((r.arm, r.split, r.seed, r.n) for r in reports.seed_points(table).collect())
    assert points == [("a", "dev", 7, 2), ("a", "dev", 42, 2), ("a", "test", 42, 1)]


def test_a_mean_norm_does_not_show_the_order_of_its_lines(spark, tmp_path):
    rng = random.Random(3)
    tax = [rng.randrange(9) for _ in range(128)]
    exact = fractions.Fraction(sum(tax), 5) / 128
    assert exact * 2 * 10**6 % 2 == 1  # a five in the seventh place
    lines = [(key, 1.0, t / 100) for key, some in ((3, tax), (4, sorted(tax)), (25, sorted(tax)[::-1])) for t in some]
    spark.createDataFrame(lines, "l_suppkey long, l_quantity double, l_tax double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, 5000.0) for k in (3, 4, 25)], "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r.gradient_norm for r in catalogue.QUERIES["comparison_board"](spark, str(tmp_path)).collect()}
    assert got == {math.ceil(exact * 10**6) / 10**6}
