"""Demand thresholds and alert metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallycast.functions.stats import safe_ratio

# Quantiles and window of the alert rules.
LOW_Q, HIGH_Q = 0.10, 0.90
WINDOW_DAYS = 91
GAP_DAYS = 3


def rolling_thresholds(panel: DataFrame, days: int = WINDOW_DAYS, gap: int = GAP_DAYS) -> DataFrame:
    """q0.10 / q0.90 of the known counts in the ``days`` days ending ``gap`` days before each day."""
    w = Window.partitionBy("grp").orderBy("date").rowsBetween(-(gap + days - 1), -gap)
    return panel.select(
        "date", "grp", "n",
        F.percentile("n", F.lit(LOW_Q)).over(w).alias("low"), F.percentile("n", F.lit(HIGH_Q)).over(w).alias("high"),
        F.count("n").over(w).alias("valid_days"),
    )


def expanding_thresholds(panel: DataFrame, first_month: str, last_month: str, q: float = HIGH_Q, gap: int = GAP_DAYS) -> DataFrame:
    """Quantile of all counts known ``gap`` days before each month, per group.

    The threshold of a month is the expanding quantile read off at its cutoff row. Rows
    are bucketed by the first month they are usable in and the expanding frame steps by
    bucket, so a row is read once rather than copied into every later month.
    """
    lo, hi = F.lit(first_month).cast("date"), F.lit(last_month).cast("date")
    reach = F.date_add("date", gap)
    at = F.trunc(reach, "month")
    usable = F.greatest(F.when(at == reach, reach).otherwise(F.add_months(at, 1)), lo)
    rows = panel.select("grp", "n", usable.alias("month")).where(F.col("month") <= hi)
    w = Window.partitionBy("grp").orderBy("month").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # One row without a count for every (group, month), so months beyond the last day are there, too.
    months = F.explode(F.sequence(F.trunc(lo, "month"), hi, F.expr("interval 1 month")))
    empty = panel.select("grp").distinct().select("grp", F.lit(None).cast(panel.schema["n"].dataType).alias("n"), months.alias("month")).where((F.col("month") >= lo) & (F.col("month") <= hi))
    rows = rows.unionByName(empty)
    stepped = rows.select("grp", "month", F.percentile("n", F.lit(q)).over(w).alias("threshold"), F.count("n").over(w).alias("known_days"))
    return stepped.groupBy("grp", "month").agg(F.max("threshold").alias("threshold"), F.max("known_days").alias("known_days"))


def with_month_threshold(results: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Attach the threshold of the target's month (many rows to one threshold)."""
    return results.withColumn("month_start", F.trunc("target_start", "month")).join(
        thresholds.select("grp", F.col("month").alias("month_start"), "threshold"), ["grp", "month_start"], "left"
    )


def high_demand_scores(flagged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """n, MAE and bias on actual high-demand rows only."""
    e = F.col("y_pred") - F.col("y_true")
    return flagged.where(F.col("y_true") >= F.col("threshold")).groupBy("model", *by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"))


def warning_metrics(flagged: DataFrame) -> DataFrame:
    """Warnings, correct warnings, recall and precision per model; null precision without warnings."""
    high, warned = F.col("y_true") >= F.col("threshold"), F.col("y_pred") >= F.col("threshold")
    return flagged.groupBy("model").agg(
        F.count_if(high).alias("high_days"), F.count_if(warned).alias("warnings"),
        F.count_if(high & warned).alias("correct_warnings"),
    ).withColumns(
        {
            "recall": safe_ratio(F.col("correct_warnings"), F.col("high_days")),
            "precision": safe_ratio(F.col("correct_warnings"), F.col("warnings")),
        }
    )


def demand_class(value: Column, strict: bool = False) -> Column:
    """High, Low or Normal; High is tested first. Rows without thresholds have no class."""
    low, high = F.col("low"), F.col("high")
    is_high, is_low = (value > high, value < low) if strict else (value >= high, value <= low)
    known = value.isNotNull() & low.isNotNull() & high.isNotNull()
    return F.when(known, F.when(is_high, "High").when(is_low, "Low").otherwise("Normal"))


def class_alerts(flagged: DataFrame, strict: bool = False) -> DataFrame:
    """Recall and precision of High and Low alerts per model, one pass."""
    rows = flagged.select("model", demand_class(F.col("y_true"), strict).alias("actual"), demand_class(F.col("y_pred"), strict).alias("alert"))
    # Nine cells per model at most, then a category view of them.
    cells = rows.where("actual is not null").groupBy("model", "actual", "alert").agg(F.count(F.lit(1)).alias("c"))
    per = cells.select("model", "actual", "alert", "c", F.explode(F.array(F.lit("High"), F.lit("Low"))).alias("category"))
    a, p = F.col("actual") == F.col("category"), F.col("alert") == F.col("category")
    return per.groupBy("model", "category").agg(
        F.sum(F.when(a, F.col("c")).otherwise(0)).alias("actual_days"), F.sum(F.when(p, F.col("c")).otherwise(0)).alias("alerts"),
        F.sum(F.when(a & p, F.col("c")).otherwise(0)).alias("correct_alerts"),
    ).withColumns(
        {
            "recall": safe_ratio(F.col("correct_alerts"), F.col("actual_days")),
            "precision": safe_ratio(F.col("correct_alerts"), F.col("alerts")),
        }
    )


def class_comparison(days: DataFrame, actual: str = "n") -> DataFrame:
    """Class counts under the inclusive and the strict rule, zero filled."""
    both = days.select(F.explode(F.array(
        F.struct(demand_class(F.col(actual)).alias("category"), F.lit(1).alias("inc"), F.lit(0).alias("str")),
        F.struct(demand_class(F.col(actual), True).alias("category"), F.lit(0).alias("inc"), F.lit(1).alias("str")),
    )).alias("x")).where("x.category is not null")
    return both.groupBy("x.category").agg(F.sum("x.inc").alias("inclusive"), F.sum("x.str").alias("strict"))
