"""The driver contract: registered queries, their SQL twins, and the flagship."""

import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module
from tools.check_oracle import key, same

SF = "/root/testdata/sf0.001"
SAMPLE = ("a04_two_format_times", "b09_window_holidays", "c06_interval_join", "c07_asof_join", "c09_nearest_value", "d02_panel_subset", "d13_load_by_category",
          "d15_vocabulary_churn", "e11_rolling_thresholds", "g01_best_by_group", "h01_feature_table_weekly", "k03_rolling_weights", "l07_paired_bootstrap", "l11_class_alerts", "q04_kpss")


def test_names_and_twins():
    q, o = entry_module.queries(), entry_module.oracle_sql()
    assert set(o) <= set(q) and len(q) > 180
    assert all(re.fullmatch(r"([a-z]\d\d|op\d+)_[a-z0-9_]+|pipeline", k) for k in q)


def test_flagship(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0 and "mae" in df.columns


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    df = entry_module.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=key)
    cur = con.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()), key=key)
    assert sorted(names) == cols and len(got) == len(want)
    assert all(same(x, y) for g, w in zip(got, want) for x, y in zip(g, w))


@pytest.mark.parametrize("name", ["a01_typed_csv_scan", "a07_csv_report"])
def test_written_csv_matches_sql(spark, name):
    """Queries that write CSV files and read them back."""
    test_matches_sql(spark, name)
