"""Negative-binomial (NB2) regression with log-level offset by distributed reweighting.

Every step is one weighted Gram aggregate of the design (about 35 x 35 numbers); the
dispersion comes from moments between rounds.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallycast.functions.stats import log_ratio, one_hot, safe_ratio
from tallycast.models.gram import collect_gram, solve
from tallycast.models.learners import FIT_THREADS, median_column, month_issues, month_training
from tallycast.operators.profile import append_all
from tallycast.spec import Setting

# Floor of the log ratios.
RATIO_FLOOR = 0.05
# Largest linear predictor, apart from the offset, that a step may reach.
FAR = 30.0


def design(groups: Sequence[int], share_fill: float) -> dict[str, Column]:
    """Log ratios, subset share, holidays and one-hot weekday, month and group (first level left out)."""
    mean28 = F.col("mean_28d")
    cols = {f"log_{c}": log_ratio(F.col(c), RATIO_FLOOR) for c in ("ratio_7_28", "ratio_28_91")}
    cols |= {f"log_{c}_rel": log_ratio(safe_ratio(F.col(c), mean28), RATIO_FLOOR) for c in ("same_wd_4w", "same_wd_13w", "lag_0")}
    cols |= {"share": F.coalesce(F.col("sub_share_28d"), F.lit(share_fill))}
    cols |= {c: F.col(c).cast("double") for c in ("holidays", "holiday_adjacent")}
    cols |= one_hot(F.col("target_weekday"), list(range(2, 8)), "weekday")
    cols |= one_hot(F.col("target_month"), list(range(2, 13)), "month")
    cols |= one_hot(F.col("grp"), list(groups)[1:], "group")
    return cols | {"const": F.lit(1.0)}


@dataclass(frozen=True)
class Fit:
    columns: tuple[str, ...]
    beta: tuple[float, ...]
    alpha: float
    share_fill: float
    groups: tuple[int, ...]

    def mean(self, setting: Setting) -> Column:
        """Predicted mean as a column of the feature table."""
        cols = design(self.groups, self.share_fill)
        eta = F.log(F.col("mean_28d") * setting.window_days)
        for c, b in zip(self.columns, self.beta, strict=True):
            eta = eta + F.lit(float(b)) * cols[c]
        return F.when(F.col("mean_28d") > 0, F.exp(eta))


def fit(train: DataFrame, groups: Sequence[int], setting: Setting, rounds: int = 50, steps: int = 50) -> Fit:
    """IRLS for fixed dispersion inside, method-of-moments dispersion outside."""
    fill = median_column(train, "sub_share_28d")
    cols = design(groups, fill)
    names = list(cols)
    base = train.select(*(c.alias(k) for k, c in cols.items()), F.col("y").cast("double").alias("y"),
                        F.log(F.col("mean_28d") * setting.window_days).alias("off")).persist()
    beta, alpha = np.zeros(len(names)), 0.0
    reach = np.array([x or 0.0 for x in base.agg(*(F.max(F.abs(c)) for c in names)).first()])
    try:
        for _ in range(rounds):
            for _ in range(steps):
                work = _working(base, names, beta, alpha)
                g = collect_gram(work, [*names, "z"], "w")
                new = solve(g[:-1, :-1], g[:-1, -1])
                while float(np.abs(new) @ reach) > FAR and base.agg(F.max(F.abs(_linear(names, new)))).first()[0] > FAR:
                    new = (new + beta) / 2  # halve a step that leaves the range
                moved = float(np.abs(new - beta).max())
                beta = new
                if moved < 1e-6:
                    break
            else:
                raise RuntimeError("negative-binomial coefficients did not settle")
            mu = F.exp(_linear(names, beta) + F.col("off"))
            row = base.select(((F.pow(F.col("y") - mu, 2) - mu) / (mu * mu)).alias("a")).agg(F.sum("a"), F.count("a")).first()
            new_alpha = max(row[0] / max(row[1] - len(names), 1), 0.0) if row[1] else 0.0
            done, alpha = math.isclose(alpha, new_alpha, rel_tol=1e-6, abs_tol=1e-9), new_alpha
            if done:
                break
        else:
            raise RuntimeError("negative-binomial dispersion did not settle")
    finally:
        base.unpersist()
    if not np.isfinite(beta).all():
        raise RuntimeError("negative-binomial fit gave non-finite parameters")
    return Fit(tuple(names), tuple(map(float, beta)), float(alpha), fill, tuple(groups))


def _linear(names: Sequence[str], beta: np.ndarray) -> Column:
    out = F.lit(0.0)
    for c, b in zip(names, beta, strict=True):
        out = out + F.lit(float(b)) * F.col(c)
    return out


def _working(base: DataFrame, names: Sequence[str], beta: np.ndarray, alpha: float) -> DataFrame:
    lin = _linear(names, beta)
    step = base.withColumn("lin", lin).withColumn("mu", F.exp(F.col("lin") + F.col("off")))
    return step.withColumns(
        {"z": F.col("lin") + (F.col("y") - F.col("mu")) / F.col("mu"), "w": F.col("mu") / (1 + F.lit(float(alpha)) * F.col("mu"))})


def monthly_backtest(features: DataFrame, groups: Sequence[int], setting: Setting, months: Sequence[str], name: str = "nb_glm") -> DataFrame:
    def of_month(month: str) -> DataFrame:
        model = fit(month_training(features, month, setting), groups, setting)
        return month_issues(features, month).select(
            F.lit(setting.key).alias("spec"), F.lit(name).alias("model"), "issue_date", "cutoff", "target_start",
            setting.end_of_issue(F.col("issue_date")).alias("target_end"), "grp", F.col("y").alias("y_true"), model.mean(setting).alias("y_pred"))

    with ThreadPoolExecutor(FIT_THREADS) as pool:  # months are independent
        return append_all(list(pool.map(of_month, months)))
