"""Runs that share a cut name are rows of their own: the boards and the sheet against their SQL."""

import pytest

from gaugeflow.plans import boards, catalogue, flows  # noqa: F401  they add their queries

KEYS = [*range(2997, 3018), *range(29990, 30050)]  # names are cut to four digits: 30000 is named as 3000 is


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("shared-names"))
    spark.createDataFrame([(k, k * 7919 % 9973 / 1.0) for k in KEYS], "s_suppkey long, s_acctbal double").coalesce(1).write.parquet(f"{path}/supplier.parquet")
    lines = [(k, float((k + i) % 60), (k * i % 9) / 100) for k in KEYS for i in range(3)]
    spark.createDataFrame(lines, "l_suppkey long, l_quantity double, l_tax double").write.parquet(f"{path}/lineitem.parquet")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(f"{path}/events.parquet")
    return path


def both(spark, path, name):
    import duckdb

    con = duckdb.connect()
    for t in ("supplier", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS FROM '{path}/{t}.parquet/*.parquet'")
    want = con.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    rows = want.fetchall()
    got = catalogue.QUERIES[name](spark, path)
    assert got.columns == columns
    return columns, [tuple(r) for r in got.collect()], rows


@pytest.mark.parametrize("name", ["dev_against_test", "watched_board"])
def test_rows_of_shared_names(spark, tables, name):
    _, got, want = both(spark, tables, name)
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_the_board_keeps_each_run_with_its_own_history(spark, tables):
    _, got, want = both(spark, tables, "comparison_board")
    # runs of one name without a ranking figure tie in the SQL, so places within a tie are compared as sets
    assert sorted(r[0] for r in got) == [*range(1, len(want) + 1)]
    assert sorted(str(r[1:]) for r in got) == sorted(str(r[1:]) for r in want)
    ties = lambda rows: sorted(str((r[0], r[1], r[6])) for r in rows)
    assert ties(got) == ties(want)


def test_the_sheet_judges_an_arm_against_all_before_it(spark, tables):
    _, got, want = both(spark, tables, "decision_sheet")
    # the SQL orders an arm's pairs by seed alone, so those of one seed are compared as sets
    sets = lambda rows: sorted(str((*r[:4], sorted(r[4].split("  ")))) for r in rows)
    assert sets(got) == sets(want)
    assert max(r[1] for r in got) > 3
