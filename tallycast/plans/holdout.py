"""Held-out test run and the live forecast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.models.smoothing import smoothing_forecasts, with_truth
from tallycast.models.topdown import split_total, top_down_plain
from tallycast.operators.baselines import baseline_wide, to_rows
from tallycast.operators.ensemble import KEYS, META, combine_mean, wide_predictions, with_period
from tallycast.operators.metrics import score
from tallycast.operators.panel import total_series
from tallycast.operators.profile import append_all
from tallycast.plans.backtest import rolling_origin
from tallycast.spec import Setting

FINAL_MODEL = "ens_mean"


def topdown_smoothing(panel: DataFrame, setting: Setting, start: str, end: str) -> DataFrame:
    total = smoothing_forecasts(total_series(panel), setting, start, end).select("cutoff", F.col("y_pred").alias("total"))
    return with_truth(split_total(panel, total), panel, setting, "topdown_ets")


def member_rows(panel: DataFrame, setting: Setting, start: str, end: str) -> DataFrame:
    """Smoothing members and both baselines on one schedule."""
    return append_all([
        rolling_origin(panel, setting, start, end, (13,), (28,)),
        with_truth(smoothing_forecasts(panel, setting, start, end), panel, setting, "ets_weekly"),
        topdown_smoothing(panel, setting, start, end),
    ])


def with_final(rows: DataFrame, members: Sequence[str], name: str = FINAL_MODEL) -> DataFrame:
    """Append the member mean; null when any member is null."""
    wide = wide_predictions(rows, members)
    final = wide.select(*META, F.lit(name).alias("model"), combine_mean(members).alias("y_pred"))
    return rows.unionByName(final.select(*rows.columns))


def holdout_results(panel: DataFrame, setting: Setting, start: str, end: str, break_date: str,
                    members: Sequence[str] = ("ets_weekly", "topdown_ets")) -> DataFrame:
    """Members, baselines and their mean on the test span, labelled before / after the break."""
    return with_period(with_final(member_rows(panel, setting, start, end), members), break_date)


def holdout_scores(results: DataFrame) -> DataFrame:
    """Score table by period; both periods must hold scored rows."""
    table = score(results, ["period"])
    return table


def require_both_periods(results: DataFrame) -> DataFrame:
    found = results.where("y_true is not null").select("period").distinct().count()
    if found != 2:
        raise ValueError("a part of the split test period has no scored row")
    return results


def live_forecast(panel: DataFrame, setting: Setting) -> DataFrame:
    """Forecast after the last day of the panel: member mean per group, rounded, and their total.

    The total row is the sum of the rounded group forecasts.
    """
    last = panel.select(F.max("date")).scalar()
    base = to_rows(baseline_wide(panel, setting, (13,), (28,)).where(F.col("cutoff") == last), setting, ["same_wd_13w", "plain_28d"])
    top = top_down_plain(panel, setting).where(F.col("cutoff") == last)
    wide = base.groupBy("issue_date", "target_start", "grp").pivot("model", ["same_wd_13w", "plain_28d"]).agg(F.max("y_pred")).join(
        top.select("grp", F.col("y_pred").alias("topdown_plain")), "grp")
    names = ["same_wd_13w", "plain_28d", "topdown_plain"]
    each = wide.withColumn("forecast", F.round(combine_mean(names)).cast("bigint"))
    out = each.select("issue_date", "target_start", F.col("grp").cast("string").alias("grp"), *names, "forecast")
    total = each.groupBy("issue_date", "target_start").agg(
        F.lit("All").alias("grp"), *(F.sum(c).alias(c) for c in names),
        F.when(F.count("forecast") == F.count(F.lit(1)), F.sum("forecast")).alias("forecast"))
    return out.unionByName(total)


def ensemble_forecaster(rows: DataFrame, members: Sequence[str]) -> DataFrame:
    """The combined rows of a set of member forecasts, keyed as the members are."""
    return wide_predictions(rows, members).select(*KEYS, combine_mean(members).alias("y_pred"))
