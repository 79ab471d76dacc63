"""Several forecast settings side by side, in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.functions.stats import safe_ratio
from tallycast.operators.metrics import scored
from tallycast.operators.profile import append_all
from tallycast.plans.backtest import rolling_origin
from tallycast.spec import Setting


def horizon_results(panel: DataFrame, settings: Sequence[Setting], start: str, end: str, weeks: Sequence[int] = (13,)) -> DataFrame:
    """Prediction rows of all settings; the panel's exchange is planned once and reused."""
    return append_all([rolling_origin(panel, s, start, end, weeks) for s in settings])


def horizon_scores(panel: DataFrame, settings: Sequence[Setting], start: str, end: str, weeks: Sequence[int] = (13,)) -> DataFrame:
    """n, MAE, bias and WAPE per setting and model on one period."""
    return scored(horizon_results(panel, settings, start, end, weeks)).groupBy("spec", "model").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs("error")).alias("mae"), F.avg("error").alias("bias"),
        safe_ratio(F.sum(F.abs("error")), F.sum("y_true")).alias("wape"),
    )


def equal_rows(scores: DataFrame) -> DataFrame:
    """Guard: models of one setting must be scored on the same number of rows."""
    return scores.groupBy("spec").agg(F.min("n").alias("n_min"), F.max("n").alias("n_max")).withColumn("equal", F.col("n_min") == F.col("n_max"))
