"""Samples that repeat, capped scans, counts, and panels over the days that events are from."""

import datetime as dt
import hashlib

from pyspark.sql import functions as F

from gaugeflow.functions.series import patience, with_last_added
from gaugeflow.operators import sampling, scorer
from gaugeflow.sources.panel import cut_windows, hourly_panel, hourly_series, series_windows


def test_samples_are_the_first_by_hash(spark):
    rows = [(k, i) for k in "ab" for i in range(40)] + [("c", 1), ("c", 2)]
    table = spark.createDataFrame(rows, "key string, id long")
    want = {(k, i) for k in "abc" for i in sorted((i for q, i in rows if q == k), key=lambda i: (hashlib.md5(f"5:{i}".encode()).hexdigest(), str(i)))[:6]}
    for parts in (1, 7):
        assert {tuple(r) for r in sampling.sample_exactly(table.repartition(parts), "id", 6, 5, ["key"]).collect()} == want
    assert sampling.sample_exactly(table.limit(0), "id", 6).count() == 0
    assert sorted(map(tuple, sampling.first_rows(table, 2, 3, "id").collect())) == [(k, i) for k in "ab" for i in range(3)]


def test_coverage_and_histogram(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("x",), (None,)], "key string")
    assert tuple(sampling.coverage(rows, spark.createDataFrame([("a",), ("b",), ("b",)], "key string")).first()) == (2, 1, 1)
    codes = spark.createDataFrame([(0,), (2,), (2,), (7,)], "code short")
    assert sorted(map(tuple, sampling.code_histogram(codes, "code", 3).collect())) == [(0, 1), (1, 0), (2, 2), (7, 1)]


def test_known_and_unseen_keys(spark):
    scores = spark.createDataFrame([("m", k, v) for k, v in (("a", 0.1), ("b", 0.3), ("c", 0.9), ("d", None))], "model string, key string, nse double")
    found = scorer.known_and_unseen(scores, spark.createDataFrame([("a",), ("b",), ("b",), ("z",)], "key string"))
    assert sorted(tuple(r) for r in found.collect()) == [("m", False, 1, 0.9), ("m", True, 2, 0.2)]


def test_residuals_and_patience(spark):
    got = spark.range(1).select(with_last_added(F.array(F.lit(1.0), F.lit(-2.0)), F.lit(5.0)).alias("p"), patience(F.lit(5), F.lit(21), F.lit(True)).alias("a"), patience(F.lit(12), F.lit(21), F.lit(True)).alias("b"), patience(F.lit(5), F.lit(21), F.lit(False)).alias("c")).first()
    assert (got.p, got.a, got.b, got.c) == ([6.0, 3.0], 10, 12, 5)


def test_panels_cover_all_days_of_the_events(spark):
    """Events of three months, of which two are outside any fixed window; panel and series agree with a plain count."""
    at = [dt.datetime(2023, 11, 30, 23, 59, 59), dt.datetime(2023, 12, 1, 0, 0), dt.datetime(2024, 1, 15, 12, 30), dt.datetime(2024, 2, 2, 3, 0)]
    rows = [(t, k, float(i + 1)) for i, t in enumerate(at) for k in ("a", "b") if (i, k) != (3, "b")] + [(at[0], None, 1.0), (None, "a", 1.0), (at[1], "a", None)]
    events = spark.createDataFrame(rows, "ts timestamp_ntz, event_type string, value double")
    hours = 24 * 65
    want = {k: [0.0] * hours for k in "ab"}
    for t, k, v in rows:
        if t is not None and k is not None and v is not None:
            want[k][int((t - dt.datetime(2023, 11, 30)).total_seconds() // 3600)] += v
    panel = hourly_panel(events)
    got = {k: [0.0] * hours for k in "ab"}
    for r in panel.collect():
        got[r.key][r.h] = r.q
    assert panel.count() == 2 * hours and got == want
    assert {r.key: r.s for r in hourly_series(events).collect()} == want
    cut = hourly_series(events, start="2024-01-15", hours=48)
    assert {r.key: (len(r.s), sum(r.s), r.s[12]) for r in cut.collect()} == {"a": (48, 3.0, 3.0), "b": (48, 3.0, 3.0)}
    assert hourly_panel(events, start="2024-01-15", hours=48).agg(F.sum("q"), F.count("*")).first() == (6.0, 96)
    one, two = (sorted(map(str, w.collect())) for w in (cut_windows(panel), series_windows(hourly_series(events))))
    assert one == two and len(one) > 0
    assert hourly_series(events.limit(0)).count() == 0 and hourly_panel(events.limit(0)).count() == 0
