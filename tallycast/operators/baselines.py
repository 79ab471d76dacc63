"""Baseline forecasts for all issue dates in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallycast.functions.stats import known_mean, rolling
from tallycast.operators.features import extend, horizon_days, running_counts, series, window_total, with_same_weekday, with_timing
from tallycast.spec import Setting, min_samples

# Candidate windows.
WEEK_CANDIDATES = (4, 8, 13, 26, 52)
VALID_ROW_CANDIDATES = (4, 13, 26, 52)
PLAIN_DAYS = 28


def in_schedule(setting: Setting, start: str, end: str) -> Column:
    """Cutoff-keyed rows whose window is one of the non-overlapping windows of a period.

    Windows step by their length; 7-day windows start on Mondays.
    """
    first = F.lit(start).cast("date")
    if setting.window_days == 7:
        first = F.date_add(first, F.pmod(-F.weekday(first), F.lit(7)))
    on_step = F.pmod(F.datediff("target_start", first), F.lit(setting.window_days)) == 0
    return (F.col("target_start") >= first) & (F.col("target_end") <= F.lit(end).cast("date")) & on_step


def issue_dates(spark: SparkSession, start: str, end: str, setting: Setting) -> DataFrame:
    """Issue dates whose whole window lies in [start, end]."""
    if end < start:
        raise ValueError(f"end {end} is before start {start}")
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    days = spark.range(1).select(F.explode(F.sequence(first, last)).alias("target_start"))
    days = days.withColumn("target_end", F.date_add("target_start", setting.window_days - 1))
    issue = setting.issue_of_start(F.col("target_start"))
    return days.where(in_schedule(setting, start, end)).select(
        issue.alias("issue_date"), setting.cutoff_of_issue(issue).alias("cutoff"), "target_start", "target_end"
    )


def actual_totals(panel: DataFrame, issues: DataFrame, setting: Setting) -> DataFrame:
    """Observed window totals: explode the window days and join them to the panel.

    Null when any day of the window is missing or outside the panel.
    """
    windows = issues.select(
        "issue_date", F.explode(F.sequence("target_start", "target_end")).alias("date")
    )
    # Bounded by the calendar: issue dates x window days.
    hit = panel.select("date", "grp", "n").join(F.broadcast(windows), "date")
    return hit.groupBy("issue_date", "grp").agg(
        F.when(F.count("n") == setting.window_days, F.sum("n").cast("double")).alias("y_true")
    )


def plain_mean(setting: Setting, days: int = PLAIN_DAYS, need: int | None = None) -> Column:
    need = min_samples(days) if need is None else need
    return rolling(F.avg, F.col("n"), series(), days, need) * setting.window_days


def baseline_wide(panel: DataFrame, setting: Setting, weeks: Sequence[int] = WEEK_CANDIDATES,
                  plain: Sequence[int] = (PLAIN_DAYS,)) -> DataFrame:
    """All cutoffs: timing, ``y_true`` and one forecast column per baseline."""
    longer, run = running_counts(with_same_weekday(extend(panel, horizon_days(setting)), setting, weeks))
    cols = {f"plain_{d}d": run.mean("n", d, min_samples(d)) * setting.window_days for d in plain}
    wide = longer.select(
        "date", "grp", "__real", window_total(run, setting).alias("y_true"),
        *(f"same_wd_{w}w" for w in weeks), *(c.alias(k) for k, c in cols.items()),
    )
    return with_timing(wide.where("__real").drop("__real"), setting)


RESULT_COLUMNS = (
    "spec", "model", "issue_date", "cutoff", "target_start", "target_end", "grp", "y_true", "y_pred",
)


def to_rows(wide: DataFrame, setting: Setting, names: Sequence[str]) -> DataFrame:
    """Unpivot forecast columns to prediction rows."""
    keys = ["issue_date", "cutoff", "target_start", "target_end", "grp", "y_true"]
    long = wide.select(*keys, *(F.col(c).cast("double") for c in names)).unpivot(keys, list(names), "model", "y_pred")
    return long.withColumn("spec", F.lit(setting.key)).select(*RESULT_COLUMNS)


def source_days(issues: DataFrame, setting: Setting, weeks: int) -> DataFrame:
    """Target day -> ``weeks`` source days, all on or before the cutoff."""
    targets = issues.select(
        "issue_date", "cutoff", F.explode(F.sequence("target_start", "target_end")).alias("target_day")
    )
    first = F.ceil(F.datediff("target_day", "cutoff") / 7).cast("int")
    return targets.select(
        "issue_date", "target_day", F.explode(F.sequence(first, first + weeks - 1)).alias("k")
    ).select("issue_date", "target_day", F.date_sub("target_day", F.col("k") * 7).alias("date"))


def same_weekday_lookup(panel: DataFrame, issues: DataFrame, setting: Setting, weeks: int) -> DataFrame:
    """The same-weekday forecast by lookup join: the independent form of the lag version."""
    lookup = F.broadcast(source_days(issues, setting, weeks))  # calendar bounded
    per_day = panel.select("date", "grp", "n").join(lookup, "date").groupBy("issue_date", "grp", "target_day").agg(
        F.when(F.count("n") >= min_samples(weeks), F.avg("n")).alias("day_pred")
    )
    return per_day.groupBy("issue_date", "grp").agg(
        F.when(F.count("day_pred") == setting.window_days, F.sum("day_pred")).alias("y_pred")
    )


def _with_valid_means(panel: DataFrame, windows: Sequence[int]) -> DataFrame:
    """All rows of the panel, with the averages of :func:`valid_row_means` on the valid ones."""
    valid = F.col("n").isNotNull()
    w = Window.partitionBy("grp", "wd", valid).orderBy("date")
    rows = panel.select("date", "grp", F.weekday("date").cast("bigint").alias("wd"), "n")
    return rows.select("*", *(F.when(valid, rolling(F.avg, F.col("n"), w, k, k)).alias(f"avg_{k}") for k in windows))


def valid_row_means(panel: DataFrame, windows: Sequence[int]) -> DataFrame:
    """Average of the last w *valid* same-weekday rows per (group, weekday), all w required."""
    return _with_valid_means(panel, windows).where(F.col("n").isNotNull()).select("date", "grp", "wd", *(f"avg_{k}" for k in windows))


def valid_row_baseline(panel: DataFrame, start: str, end: str, windows: Sequence[int], gap: int = 3) -> DataFrame:
    """Same-weekday baseline over valid rows, as of the D-``gap`` cutoff.

    A panel has a row for every day, so the last valid row up to the cutoff is found by a range
    frame of the panel itself: no join, and no exchange beyond that of the panel. Averages start at
    the w-th valid row and go on from there, so the last known one is that of the last valid row.
    """
    rows = _with_valid_means(panel, windows).withColumn("day", F.unix_date("date").cast("bigint"))
    known = Window.partitionBy("grp", "wd").orderBy("day").rangeBetween(Window.unboundedPreceding, -gap)
    out = rows.select(
        F.col("date").alias("target"), "grp", "wd", F.date_sub("date", gap).alias("cutoff"), F.col("n").alias("actual"),
        F.last(F.when(F.col("n").isNotNull(), F.col("date")), ignorenulls=True).over(known).alias("matched_date"),
        *(F.last(f"avg_{k}", ignorenulls=True).over(known).alias(f"avg_{k}") for k in windows),
    )
    return out.where(F.col("target").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def preview_baselines(panel: DataFrame, weeks: Sequence[int]) -> DataFrame:
    """Target-keyed preview: mean of the known values 1..w weeks back, plain mean at D-3."""
    n = F.col("n")
    cols = {}
    for w in weeks:
        back = [F.lag(n, 7 * i).over(series()) for i in range(1, w + 1)]
        cols[f"same_wd_{w}w"] = known_mean(back, 1)
    cols["plain_28d"] = rolling(F.avg, n, series(), 28, 20, end=-3)
    return panel.select("date", "grp", "n", *(c.alias(k) for k, c in cols.items()))
