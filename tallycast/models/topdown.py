"""Top-down forecasts: total forecast x recent group share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.functions.stats import rolling
from tallycast.operators.features import series, with_timing
from tallycast.operators.panel import group_shares, total_series
from tallycast.spec import Setting, min_samples

SHARE_DAYS = 28


def split_total(panel: DataFrame, totals: DataFrame, days: int = SHARE_DAYS, n_groups: int | None = None) -> DataFrame:
    """Distribute ``cutoff, total`` forecasts over the groups; null share or total -> null."""
    shares = group_shares(panel, days, min_samples(days), n_groups)
    return shares.join(F.broadcast(totals), "cutoff").withColumn("y_pred", F.col("share") * F.col("total"))  # one total per day


def top_down_plain(panel: DataFrame, setting: Setting, days: int = SHARE_DAYS, n_groups: int | None = None) -> DataFrame:
    """Top-down with the plain mean of the total series as its base, for all cutoffs."""
    total = total_series(panel, n_groups=n_groups)
    base = total.select(
        F.col("date").alias("cutoff"), (rolling(F.avg, F.col("n"), series(), 28, min_samples(28)) * setting.window_days).alias("total"))
    return with_timing(split_total(panel, base, days, n_groups).withColumn("date", F.col("cutoff")), setting)
