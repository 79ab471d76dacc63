"""Linear regression refitted every month, all months in one job.

Design: median-imputed numeric features plus an effect of each group. Instead of one
training run per month, every row is reduced once into the sufficient statistics of the
first month that may use it; prefix sums over months give each month's normal equations.
Imputation values change from month to month, so the statistics keep value and
missing-flag separately and the month's medians are applied to the summed matrix.
Group effects are eliminated from the equations, so their number is open.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallycast.models.gram import gram_by, prefix_gram, solve
from tallycast.operators.features import STRICT_NUMERIC
from tallycast.sources.sinks import stage


def usable_month(day: Column, gap: int) -> Column:
    """First month whose training cutoff (start - gap days) reaches ``day``."""
    reach = F.date_add(day, gap)
    at = F.trunc(reach, "month")
    return F.when(at == reach, reach).otherwise(F.add_months(at, 1))


def expanding_medians(rows: DataFrame, columns: Sequence[str], last_month: Column) -> DataFrame:
    """Exact median of each column over all rows usable by each month: ``refit, name, median``.

    Rows are first reduced to value frequencies per month bucket. Features of counts take
    few distinct values, so what is accumulated over months is small and does not grow
    with the number of rows.
    """
    long = rows.select("refit", *columns).unpivot("refit", list(columns), "name", "v").where("v is not null")
    freq = long.groupBy("name", "v", "refit").agg(F.count(F.lit(1)).alias("c"))
    # Running count per value, spread to the later months of the schedule.
    later = freq.withColumn("m", F.explode(F.sequence("refit", last_month, F.expr("interval 1 month"))))
    total = later.groupBy("m", "name", "v").agg(F.sum("c").alias("c"))
    whole = Window.partitionBy("m", "name")
    seen = total.withColumn("cum", F.sum("c").over(whole.orderBy("v"))).withColumn("n", F.sum("c").over(whole))
    low, high = F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)
    return seen.groupBy(F.col("m").alias("refit"), "name").agg(
        ((F.min(F.when(F.col("cum") > low, F.col("v"))) + F.min(F.when(F.col("cum") > high, F.col("v")))) / 2).alias("median"))


def group_means(design: DataFrame, columns: Sequence[str], last_month: Column) -> DataFrame:
    """``refit, unit, n`` and the mean of each column over all rows of a unit usable by each month.

    Rows are reduced to sums of (unit, month) first; running sums over a unit's months do the rest.
    """
    sums = design.groupBy("unit", "refit").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in columns))
    follows = F.lead("refit").over(Window.partitionBy("unit").orderBy("refit"))
    until = F.coalesce(F.add_months(follows, -1), last_month)
    run = Window.partitionBy("unit").orderBy("refit").rowsBetween(Window.unboundedPreceding, 0)
    total = sums.select("unit", "refit", until.alias("until"), F.sum("n").over(run).alias("n"), *(F.sum(c).over(run).alias(c) for c in columns))
    spread = total.withColumn("refit", F.explode(F.sequence("refit", "until", F.expr("interval 1 month"))))
    return spread.select("refit", "unit", "n", *((F.col(c) / F.col("n")).alias(c) for c in columns))


def monthly_linear(features: DataFrame, groups: Sequence[int] | None, start: str, end: str, gap: int = 3,
                   numeric: Sequence[str] = STRICT_NUMERIC) -> DataFrame:
    """Predictions of every known target day in [start, end] with monthly refits.

    ``features`` is the strict feature table; the result has
    ``refit_month, date, grp, y_true, y_pred``. Each of ``groups`` (all, if None) has an effect of its own, the
    others share one. Effects are eliminated block by block: the shared slopes solve what is left
    of the normal equations after each group's means are taken out, and a group's effect follows from its own means and
    the slopes. So the number of groups is open: nothing of them reaches the driver or one task. A
    group without usable rows gets the mean effect.
    """
    numeric, k = list(numeric), len(numeric)
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    unit = F.struct(F.col("grp").alias("g")) if groups is None else F.struct(F.when(F.col("grp").isin(list(groups)), F.col("grp")).alias("g"))
    known = features.where("n is not null").select("date", "grp", unit.alias("unit"), "n", *(F.col(c).cast("double").alias(c) for c in numeric))
    months = features.sparkSession.range(1).select(F.explode(F.sequence(F.trunc(lo, "month"), hi, F.expr("interval 1 month"))).alias("refit"))
    train = known.withColumn("refit", F.greatest(usable_month(F.col("date"), gap), F.trunc(lo, "month"))).where(F.col("refit") <= hi)

    medians = expanding_medians(train, numeric, F.trunc(hi, "month"))
    value = [F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in numeric]
    flags = [F.col(c).isNull().cast("double").alias(f"m_{c}") for c in numeric]
    design = train.select("refit", "unit", *value, *flags, F.col("n").cast("double").alias("y"))
    cols = design.columns[2:]
    size = len(cols)
    means = stage(group_means(design, cols, F.trunc(hi, "month")), "group-means")
    grams = prefix_gram(gram_by(design, "refit", cols), months, "refit", size)
    between = gram_by(means, "refit", cols, "n").withColumnRenamed("s", "b")
    within = grams.join(between, ["refit", "pos"], "left").select("refit", "pos", (F.col("s") - F.coalesce("b", F.lit(0.0))).alias("s"))
    fill = medians.groupBy("refit").agg(F.map_from_entries(F.collect_list(F.struct("name", "median"))).alias("fill"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        full = pdf.sort_values("pos")["s"].to_numpy().reshape(size, size)
        fills = dict(pdf["fill"].iloc[0] or {})
        med = np.array([fills.get(c, np.nan) for c in numeric])
        med = np.where(np.isnan(med), 0.0, med)
        t = np.zeros((k + 1, size))
        t[np.arange(k), np.arange(k)] = 1.0
        t[np.arange(k), k + np.arange(k)] = med  # value + median x missing flag
        t[k, 2 * k] = 1.0
        m = t @ full @ t.T
        beta = solve(m[:-1, :-1], m[:-1, -1])
        return pd.DataFrame({"refit": [pdf["refit"].iloc[0]], "beta": [beta.tolist()], "med": [med.tolist()]})

    # One row of slopes a month.
    coef = stage(within.join(fill, "refit", "left").groupBy("refit").applyInPandas(fit, "refit date, beta array<double>, med array<double>"), "slopes")
    b, m = F.col("beta"), F.col("med")

    def line(term) -> Column:
        out = F.lit(0.0)
        for i, c in enumerate(numeric):
            out = out + b[i] * term(i, c)
        return out

    own = means.join(F.broadcast(coef), "refit").select("refit", "unit", "n", (F.col("y") - line(lambda i, c: F.col(c) + m[i] * F.col(f"m_{c}"))).alias("effect"))
    overall = own.groupBy("refit").agg((F.sum(F.col("effect") * F.col("n")) / F.sum("n")).alias("mean_effect"))
    valid = known.where(F.col("date").between(lo, hi)).withColumn("refit", F.trunc("date", "month"))
    scored = valid.join(F.broadcast(coef.join(overall, "refit")), "refit").join(own.select("refit", "unit", "effect"), ["refit", "unit"], "left")
    y = F.coalesce("effect", "mean_effect") + line(lambda i, c: F.coalesce(F.col(c), m[i]))
    return scored.select(F.col("refit").alias("refit_month"), "date", "grp", F.col("n").cast("double").alias("y_true"), y.alias("y_pred"))
