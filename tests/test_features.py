import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import PANEL, day, uniform_panel
from tallycast.functions import calendar as C
from tallycast.operators import baselines as B
from tallycast.operators import features as X
from tallycast.plans.backtest import require_forecasts, rolling_origin
from tallycast.spec import DAILY, WEEKLY, Setting, daily_leads, label_columns, min_samples


@pytest.fixture(scope="module")
def panel(spark):
    return uniform_panel(spark).cache()


def series(panel):
    return {(r.date, r.grp): r.n for r in panel.collect()}


def weekday_forecast(hist, setting, cutoff, grp, weeks):
    """Brute-force same-weekday total of one cutoff."""
    total = 0.0
    for j in range(setting.window_days):
        target = cutoff + dt.timedelta(days=setting.gap_days + j)
        first = -(-(target - cutoff).days // 7)
        vals = [hist.get((target - dt.timedelta(weeks=k), grp)) for k in range(first, first + weeks)]
        vals = [v for v in vals if v is not None]
        if len(vals) < min_samples(weeks):
            return None
        total += sum(vals) / len(vals)
    return total


@pytest.mark.parametrize("setting", [DAILY, WEEKLY, Setting(lead_days=9), Setting(lead_days=30), Setting(0, 1, 3)])
def test_same_weekday_against_brute_force(panel, setting):
    hist = series(panel)
    wide = B.baseline_wide(panel, setting, (4, 13)).where("cutoff >= '2024-03-20'").collect()
    assert wide
    for r in wide:
        for w in (4, 13):
            want = weekday_forecast(hist, setting, r.cutoff, r.grp, w)
            got = r[f"same_wd_{w}w"]
            assert (got is None) == (want is None)
            assert want is None or got == pytest.approx(want)


def test_live_rows_exist_at_the_end(panel):
    last = X.feature_table(panel, DAILY).where("cutoff = '2024-12-31'").collect()
    assert len(last) == 2
    assert all(r.y is None and r.same_wd_13w is not None and r.mean_28d is not None for r in last)


@pytest.mark.parametrize("setting", [DAILY, WEEKLY, Setting(lead_days=14)])
def test_no_leakage(spark, panel, setting):
    cutoff = "2024-06-30"
    poisoned = panel.withColumn("n", F.when(F.col("date") > cutoff, F.lit(10000)).otherwise(F.col("n")))
    cols = [*X.KEY_COLUMNS, *X.LEVEL_COLUMNS, *X.CALENDAR_COLUMNS]
    a, b = (X.feature_table(p, setting).where(F.col("cutoff") <= cutoff).select(*cols) for p in (panel, poisoned))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_issue_rows_match_full_table(panel):
    a = X.feature_table(panel, WEEKLY).where("issue_date = '2024-09-15'").drop("y")
    b = X.issue_rows(panel, "2024-09-15", WEEKLY).drop("y")
    for x, y in zip(sorted(a.collect()), sorted(b.collect()), strict=True):
        assert all(u == v or u == pytest.approx(v) for u, v in zip(x, y, strict=True))


def test_ramp_hand_values(spark):
    rows = [(day("2024-01-01") + dt.timedelta(days=i), 1, 3 * (i + 1), i + 1) for i in range(120)]
    f = X.feature_table(spark.createDataFrame(rows, PANEL), DAILY).where("cutoff = '2024-04-09'").first()  # count 300
    assert f.lag_0 == 300 and f.lag_6 == 282 and f.mean_7d == 291
    assert f.sub_share_7d == pytest.approx(1 / 3)
    assert f.same_wd_4w == pytest.approx(np.mean([288 - 21 * k for k in range(4)]))  # 3 days ahead: same weekday is 4 days back
    assert f.y == 309 and f.ratio_7_28 == pytest.approx(291 / f.mean_28d)


def test_actuals_equal_forward_total(spark, panel):
    issues = B.issue_dates(spark, "2024-01-01", "2024-12-31", WEEKLY)
    truth = {(r.issue_date, r.grp): r.y_true for r in B.actual_totals(panel, issues, WEEKLY).collect()}
    rows = rolling_origin(panel, WEEKLY, "2024-01-01", "2024-12-31", (4,)).where("model = 'plain_28d'").collect()
    assert len(rows) == len(truth)
    assert all(truth[r.issue_date, r.grp] == r.y_true for r in rows)
    assert all(r.target_start.isoweekday() == 1 for r in rows)
    assert sum(r.y_true is None for r in rows) == 2  # the week with the missing day


def test_min_samples():
    assert [min_samples(k) for k in (4, 7, 13, 14, 28, 91)] == [3, 5, 10, 10, 20, 64]


def test_guards(spark, panel):
    with pytest.raises(ValueError, match="test period"):
        rolling_origin(panel, DAILY, "2024-01-01", "2024-12-31", test_start="2024-06-01")
    with pytest.raises(ValueError, match="repeat"):
        rolling_origin(panel, DAILY, "2024-01-01", "2024-12-31", (4, 4))
    require_forecasts(rolling_origin(panel, DAILY, "2024-06-01", "2024-12-31", (13,)))
    with pytest.raises(ValueError, match="null forecasts"):
        require_forecasts(rolling_origin(panel, DAILY, "2023-01-01", "2023-03-31", (13,)))


def test_settings():
    with pytest.raises(ValueError):
        Setting(lead_days=0)
    assert DAILY.key == "lag2_lead1_win1" and DAILY.gap_days == 3
    assert [s.lead_days for s in daily_leads(3)] == [1, 2, 3]


def test_label_columns(spark):
    df = spark.createDataFrame([("v2",), ("lead1",), ("lead30",), ("weekly",), ("x",)], "label string")
    got = {r.label: (r.canonical, r.lead_days, r.window_days) for r in df.select("label", *(c.alias(k) for k, c in label_columns(F.col("label")).items())).collect()}
    assert got == {"v2": ("v2", 1, 1), "lead1": ("v2", 1, 1), "lead30": ("lead30", 30, 1), "weekly": ("weekly", 1, 7), "x": (None, None, None)}


def test_holiday_expectations(spark):
    df = spark.createDataFrame([(day(d),) for d in ("2024-06-24", "2024-06-23", "2024-06-20", "2025-04-18")], "s date")
    got = {r.s.isoformat(): (r.holidays, r.holiday_adjacent, r.target_weekday) for r in C.window_calendar(df, "s", 1).collect()}
    assert got == {"2024-06-24": (1, 0, 1), "2024-06-23": (0, 1, 7), "2024-06-20": (0, 0, 4), "2025-04-18": (1, 0, 5)}
    weeks = spark.createDataFrame([(day("2024-12-23"),), (day("2024-12-30"),)], "s date")
    assert {(r.holidays, r.holiday_adjacent) for r in C.window_calendar(weeks, "s", 7).collect()} == {(1, 2)}


def test_iso_week_key(spark):
    df = spark.createDataFrame([(day(d),) for d in ("2021-01-01", "2024-12-30", "2024-07-03")], "d date")
    assert [r[0] for r in df.select(C.week_key(F.col("d"))).collect()] == [202053, 202501, 202427]


def test_valid_row_baseline_matches_loop(spark, panel):
    hist = pd.DataFrame([(r.date, r.grp, r.n) for r in panel.collect()], columns=["date", "grp", "n"]).dropna()
    got = B.valid_row_baseline(panel, "2024-03-25", "2024-04-30", (4,)).collect()
    assert len(got) == 74
    for r in got:
        past = hist[(hist.grp == r.grp) & (hist.date <= r.cutoff) & (pd.to_datetime(hist.date).dt.weekday == r.target.weekday())]
        assert r.avg_4 == pytest.approx(past.sort_values("date")["n"].tail(4).mean())


def test_plan_has_one_exchange_by_group(panel):
    plan = X.feature_table(panel, DAILY)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(grp") == 1
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
