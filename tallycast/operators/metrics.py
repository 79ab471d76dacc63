"""Scores, spreads, bootstrap intervals of prediction rows (error = forecast - actual)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallycast.functions.calendar import week_key
from tallycast.functions.quantiles import exact_quantiles
from tallycast.functions.stats import safe_ratio

def scored(results: DataFrame) -> DataFrame:
    """Rows with a known truth, plus the error and the usual report columns."""
    return results.where(F.col("y_true").isNotNull()).withColumns(
        {
            "error": F.col("y_pred") - F.col("y_true"),
            "month": F.month("target_start").cast("bigint"),
            "year": F.year("target_start").cast("bigint"),
        }
    )


def point_scores() -> list[Column]:
    e = F.col("error")
    return [
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e).alias("bias"),
        F.avg((e < 0).cast("double")).alias("under_share"),
    ]


def score(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """n, MAE, bias, median error and under-share per model and ``by``.

    A model's rows grow with entities x days, so the exact median goes through
    :func:`exact_quantiles` rather than one buffer per model.
    """
    rows = scored(results)
    keys = ["model", *by]
    table = exact_quantiles(rows, keys, "error", {"median_error": 0.5}, also=point_scores())
    return table.select(*keys, "n", "mae", "bias", "median_error", "under_share")


def score_sets(results: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """MAE and bias over several groupings, with and without anomaly windows, in one pass."""
    rows = scored(results)
    cols = list(dict.fromkeys(c for s in sets for c in s))
    grouped = rows.groupingSets([[F.col("model"), *(F.col(c) for c in s)] for s in sets], "model", *cols)
    clean = ~F.col("anomaly")
    return grouped.agg(
        F.grouping_id().cast("bigint").alias("gid"),
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs("error")).alias("mae"),
        F.avg("error").alias("bias"),
        F.count_if(clean).alias("n_clean"),
        F.avg(F.when(clean, F.abs("error"))).alias("mae_clean"),
        F.avg(F.when(clean, F.col("error"))).alias("bias_clean"),
    )


def error_spread(results: DataFrame, by: Sequence[str] = (), ddof: int = 0) -> DataFrame:
    """Bias, variance and SD of the errors; population by default, sample with ``ddof=1``."""
    var, sd = (F.var_pop, F.stddev_pop) if ddof == 0 else (F.var_samp, F.stddev_samp)
    return scored(results).groupBy("model", *by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("error").alias("bias"),
        var("error").alias("error_var"), sd("error").alias("error_sd"),
    )


def wape(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return scored(results).groupBy("model", *by).agg(
        safe_ratio(F.sum(F.abs("error")), F.sum("y_true")).alias("wape")
    )


def improvement(results: DataFrame, reference: str) -> DataFrame:
    """MAE improvement in percent against a reference model, and absolute bias."""
    table = scored(results).groupBy("model").agg(F.avg(F.abs("error")).alias("mae"), F.avg("error").alias("bias"))
    ref = table.where(F.col("model") == reference).select(F.max("mae")).scalar()
    return table.select(
        "model", "mae", "bias", F.abs("bias").alias("absolute_bias"),
        (safe_ratio(ref - F.col("mae"), ref) * 100).alias("mae_improvement_pct"),
    )


def best_model(table: DataFrame, by: Sequence[str] = (), tie: Column | None = None) -> DataFrame:
    """Model with the lowest MAE per ``by``; ties by ``tie`` (default: name)."""
    key = F.struct(F.col("mae"), (F.col("model") if tie is None else tie).alias("tie"))
    return table.groupBy(*by).agg(F.min_by("model", key).alias("model"), F.min("mae").alias("mae"))


def window_length(model: Column) -> Column:
    """First number in a model name."""
    return F.regexp_extract(model, r"(\d+)", 1).cast("bigint")


def select_window(results: DataFrame, prefix: str = "same_wd_") -> DataFrame:
    """Best model of a name family; ties go to the shorter window."""
    family = results.where(F.col("model").startswith(prefix))
    table = scored(family).groupBy("model").agg(F.avg(F.abs("error")).alias("mae"))
    return best_model(table, tie=window_length(F.col("model")))


def monthly_winners(results: DataFrame, models: Sequence[str]) -> DataFrame:
    """Months in which each model has the lowest MAE (a tied month counts for all)."""
    monthly = (
        scored(results).withColumn("ym", F.trunc("target_start", "month"))
        .groupBy("ym").pivot("model", list(models)).agg(F.avg(F.abs("error")))
    )
    low = F.least(*(F.col(m) for m in models))
    return monthly.agg(*(F.count_if(F.col(m) == low).alias(m) for m in models)).unpivot(
        [], list(models), "model", "months_won"
    )


def paired_weeks(results: DataFrame, model: str, reference: str) -> DataFrame:
    """Absolute error sums of two models per ISO week of the target start, on shared keys."""
    keys = ["issue_date", "grp"]
    pair = scored(results.where(F.col("model").isin(model, reference)))
    # One row per key holds both models: no self join, one exchange.
    both = pair.groupBy(*keys, "target_start").agg(
        F.max(F.when(F.col("model") == model, F.abs("error"))).alias("e_model"),
        F.max(F.when(F.col("model") == reference, F.abs("error"))).alias("e_ref"),
    ).where("e_model is not null and e_ref is not null")
    return both.groupBy(week_key(F.col("target_start")).alias("week")).agg(
        F.sum("e_model").alias("s_model"), F.sum("e_ref").alias("s_ref"), F.count(F.lit(1)).alias("c")
    )


def draw_block(seed: int, replicate: Column, slot: Column, blocks: Column) -> Column:
    """Hash draw in 0..blocks-1: the same on every engine and after any task retry."""
    text = F.concat_ws("-", F.lit(str(seed)), replicate.cast("string"), slot.cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), blocks)


def paired_bootstrap(results: DataFrame, model: str, reference: str, n_boot: int = 2000, seed: int = 42) -> DataFrame:
    """Week-block bootstrap of the MAE difference with a 95 % percentile interval.

    Blocks number at most the weeks of the calendar. Draws are rows (replicate, slot)
    joined to the blocks on the drawn index, so memory does not grow with ``n_boot``.
    """
    from pyspark.sql import Window

    spark = results.sparkSession
    weeks = paired_weeks(results, model, reference)
    blocks = weeks.withColumn("idx", F.row_number().over(Window.orderBy("week")).cast("bigint") - 1)
    count = weeks.select(F.count(F.lit(1))).scalar()
    slots = spark.range(n_boot).withColumnRenamed("id", "rep").withColumn(
        "slot", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1))
    )
    drawn = slots.select("rep", draw_block(seed, F.col("rep"), F.col("slot"), count).alias("idx"))
    boot = drawn.join(F.broadcast(blocks), "idx").groupBy("rep").agg(
        ((F.sum("s_model") - F.sum("s_ref")) / F.sum("c")).alias("d")
    )
    ci = boot.agg(F.percentile("d", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    total = weeks.agg(
        (F.sum("s_model") / F.sum("c")).alias("mae_model"),
        (F.sum("s_ref") / F.sum("c")).alias("mae_reference"),
        F.count(F.lit(1)).alias("n_blocks"),
    )
    q = ci.select("q").scalar()
    return total.select(
        F.lit(model).alias("model"), F.lit(reference).alias("reference"), "mae_model", "mae_reference",
        (F.col("mae_model") - F.col("mae_reference")).alias("diff"),
        q[0].alias("ci_low"), q[1].alias("ci_high"), "n_blocks",
    )


def guard_counts(results: DataFrame) -> DataFrame:
    """Back-test guards as counts: null forecasts on known truth, repeated keys, group sets."""
    return results.groupBy("model", "issue_date", "grp").agg(
        F.count(F.lit(1)).alias("c"),
        F.count_if(F.col("y_true").isNotNull() & F.col("y_pred").isNull()).alias("bad"),
        F.count_if(F.col("y_true").isNull()).alias("unknown"),
    ).groupBy("model").agg(
        F.sum("c").alias("rows"), F.sum("bad").alias("null_forecasts"),
        F.sum("unknown").alias("unknown_truth"), F.count_if(F.col("c") > 1).alias("repeated_keys"),
    )
