"""Anomaly calendar: robust z scores of residuals, shared shocks, context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallycast.functions.stats import safe_ratio

# MAD consistency factor and the anomaly threshold.
MAD_SCALE = 1.4826
Z_THRESHOLD = 6.0


def robust_z(residuals: DataFrame, threshold: float = Z_THRESHOLD) -> DataFrame:
    """MAD-scaled residuals: ``z`` and ``anomaly``; a missing day has a null z.

    Both medians are taken per series, which the calendar bounds, inside one exchange.
    """
    series = Window.partitionBy("grp")
    centred = residuals.withColumn("__c", F.median("resid").over(series))
    scaled = centred.withColumn("__s", MAD_SCALE * F.median(F.abs(F.col("resid") - F.col("__c"))).over(series))
    z = F.when(F.col("n").isNotNull(), safe_ratio(F.col("resid") - F.col("__c"), F.col("__s")))
    return scaled.withColumn("z", z).withColumn("anomaly", F.col("z") > threshold).drop("__c", "__s")


def anomaly_summary(calendar: DataFrame, threshold: float = Z_THRESHOLD) -> DataFrame:
    return calendar.where("z is not null").groupBy("grp").agg(
        F.count(F.lit(1)).alias("days"), F.count_if("anomaly").alias("anomalies"),
        (100 * F.avg(F.col("anomaly").cast("double"))).alias("pct"),
        F.count_if(F.col("z") < -threshold).alias("unusually_low"), F.max("z").alias("max_z"),
    )


def shared_shocks(calendar: DataFrame, at_least: int) -> DataFrame:
    """Dates flagged in at least ``at_least`` groups."""
    return calendar.where("anomaly").groupBy("date").agg(F.count(F.lit(1)).alias("groups")).where(F.col("groups") >= at_least)


def shock_context(shocks: DataFrame, events: DataFrame, day: Column, flag: Column, label: str) -> DataFrame:
    """Event counts, share of ``flag`` and the most frequent label of each shock date.

    Events are cut to the shock dates first (at most one row per calendar day, broadcast)
    and reduced to (date, label) cells before anything is gathered by date. Ties of the
    label go to the alphabetically first.
    """
    on_days = events.withColumn("date", day.cast("date")).join(F.broadcast(shocks.select("date")), "date", "left_semi")
    cells = on_days.groupBy("date", label).agg(F.count(F.lit(1)).alias("c"), F.count_if(flag).alias("f"))
    context = cells.groupBy("date").agg(
        F.sum("c").alias("n"), (100 * safe_ratio(F.sum("f"), F.sum("c"))).alias("pct_flag"),
        F.min_by(label, F.struct(-F.col("c"), F.col(label))).alias("top_label"),
    )
    return shocks.join(context, "date").withColumn("weekday", F.date_format("date", "EEE"))


def mean_residuals(panel: DataFrame, days: int, need: int) -> DataFrame:
    """Residual against the trailing mean: a cheap stand-in for the decomposition."""
    w = Window.partitionBy("grp").orderBy("date").rowsBetween(-(days - 1), 0)
    level = F.when(F.count("n").over(w) >= need, F.avg("n").over(w))
    return panel.select("date", "grp", "n", (F.col("n") - level).alias("resid"))
