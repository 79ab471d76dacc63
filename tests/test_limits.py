"""Inputs at the edges that once lost rows or failed."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallycast.functions.calendar import window_calendar
from tallycast.models.learners import Config, _stages
from tallycast.operators.alerts import expanding_thresholds
from tallycast.operators.decompose import decompose, median_polish
from tallycast.operators.ensemble import weight_summary
from tallycast.operators.features import feature_table
from tallycast.plans.registry import months_of, registry_run
from tallycast.sources.manifest import diff, fingerprint
from tallycast.spec import DAILY
from tests.helpers import PANEL, day


def steady(spark, n, days, start="2024-01-01"):
    first = day(start)
    return spark.createDataFrame([(first + dt.timedelta(i), 1, n + i % 7, n // 3) for i in range(days)], PANEL)


def test_short_series_keeps_its_remainder(spark):
    parts = decompose(steady(spark, 50, 51))
    assert parts.where("resid is not null").count() == 51


def test_holidays_of_any_year(spark):
    df = spark.createDataFrame([(day("2201-01-01"),), (day("1871-12-25"),), (day("2024-03-05"),)], "start date")
    assert {r.start.year: r.holidays for r in window_calendar(df, "start", 1).collect()} == {2201: 1, 1871: 1, 2024: 0}


def test_thresholds_beyond_the_last_day(spark):
    got = expanding_thresholds(steady(spark, 50, 100), "2024-02-01", "2024-12-01").collect()
    assert len(got) == 11 and max(r.month for r in got) == day("2024-12-01")
    assert {r.known_days for r in got if r.month >= day("2024-05-01")} == {100}


def test_files_of_one_name(spark, tmp_path):
    for folder, text in (("a", "x"), ("b", "longer")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "data.txt").write_text(text)
    prints = fingerprint(spark, str(tmp_path))
    assert sorted(r.path for r in prints.collect()) == ["a/data.txt", "b/data.txt"]
    assert diff(prints, prints).count() == 0


def test_large_counts(spark):
    rows = feature_table(steady(spark, 400_000_000, 200), DAILY)
    sd = [r.sd_28d for r in rows.collect() if r.sd_28d is not None]
    assert sd and max(sd) < 3


def test_long_member_names(spark):
    name = "m" * 230
    w = spark.createDataFrame([(day("2024-01-01"), 0.25)], f"month date, w_{name} double")
    assert weight_summary(w, [name]).first().member == name


def test_unknown_kind_is_an_error(spark):
    with pytest.raises(ValueError, match="kind"):
        _stages(Config("odd", "unknown"), {})
    with pytest.raises(ValueError, match="unknown models"):
        registry_run(steady(spark, 5, 10), ["no_such_model"], DAILY, "2024-01-01", "2024-01-31", (1,))
    assert months_of("2023-11-01", "2024-02-29") == ["2023-11-01", "2023-12-01", "2024-01-01", "2024-02-01"]


def test_unsettled_polish_is_an_error(spark):
    cells = spark.createDataFrame([(day(f"2024-{m:02d}-01"), g, float((m * g * 7) % 11)) for m in range(1, 8) for g in range(1, 6)], "month date, grp bigint, x double")
    with pytest.raises(RuntimeError, match="still move"):
        median_polish(cells, max_iter=1, tol=-1.0)
    assert median_polish(cells).where(F.col("resid").isNull()).count() == 0
