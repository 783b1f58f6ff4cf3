import math
import os
import random

import pytest
from pyspark.sql import functions as F

from gaugeflow.functions import series
from gaugeflow.operators import diagnostics
from gaugeflow.plans import catalogue, studies  # noqa: F401
from gaugeflow.streaming.folds import follow_runs

SF = "/root/testdata/sf0.001"


def test_runs_followed_as_a_stream_equal_their_arrays(spark, tmp_path):
    rng = random.Random(5)
    curves = {k: [rng.uniform(0, 1) + i / 40 for i in range(n)] for k, n in (("a", 25), ("b", 3), ("c", 40))}
    rows = [(k, i, v) for k, c in curves.items() for i, v in enumerate(c)]
    kind = "run string, at int, v double"
    for part in ([r for r in rows if r[1] < 9], [r for r in rows if r[1] >= 9]):
        rng.shuffle(part)
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    sink = follow_runs(stream, "run", "at", "v", patience=4).writeStream.format("memory").queryName("followed").outputMode("update")
    query = sink.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = {r["key"]: r["s"] for r in spark.table("followed").groupBy("key").agg(F.max_by(F.struct("*"), "n").alias("s")).collect()}
    arrays = spark.createDataFrame(list(curves.items()), "key string, s array<double>")
    want = arrays.select("key", series.early_stop(F.col("s"), 4).alias("e"), series.moving_mean(F.col("s")).alias("mean")).select("key", "e.*", "mean").collect()
    assert len(got) == len(want) == 3
    for w in want:
        g = got[w["key"]]
        assert [g[c] for c in ("best_epoch", "epoch", "stopped")] == [w[c] for c in ("best_epoch", "epoch", "stopped")]
        assert math.isclose(g["best"], w["best"]) and math.isclose(g["mean"], w["mean"]) and g["n"] == len(curves[w["key"]])


def test_branches_replace_one_channel_or_stand_alone(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]], [[5.0, 6.0], [7.0, 8.0]], [1, 0, 9])], "c array<array<double>>, b array<array<double>>, p array<int>")
    row = df.select(series.branch_inputs(*map(F.col, "cbp"), target=1).alias("r"), series.branch_inputs(*map(F.col, "cbp"), replace=False).alias("u")).first()
    assert row["r"] == [[[1.0, 2.0], [7.0, 8.0]], [[1.0, 2.0], [5.0, 6.0]], [[1.0, 2.0], None]]
    assert row["u"] == [[[7.0, 8.0]], [[5.0, 6.0]], [None]]


def test_bootstrap_without_rows_and_with_one_key(spark):
    kind = "key string, a double, b double"
    assert diagnostics.bootstrap_medians(spark.createDataFrame([("x", None, 1.0)], kind), "key", "a", "b", 50).first()["n"] == 0
    one = diagnostics.bootstrap_medians(spark.createDataFrame([("x", 3.0, 1.0), ("y", None, 9.0)], kind), "key", "a", "b", 50).first()
    assert tuple(one) == (50, 2.0, 2.0, 2.0, 1.0)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", ["stopping_days", "learning_rates", "routing_disagreement", "branch_powers", "bootstrap_medians"])
def test_same_rows_as_duckdb(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("events", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(catalogue.ORACLE_SQL[name]).df()
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want) > 0
    columns = sorted(got.columns)
    key = lambda df: sorted(tuple(round(float(v), 4) if isinstance(v, float) else str(v) for v in r) for r in df[columns].itertuples(index=False))
    assert key(got) == key(want)
