"""One model run: registered configurations over one schedule, each by its own kind."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.models import linear, negbin, smoothing
from tallycast.models.boosting import boosted_backtest
from tallycast.models.learners import DEPTH, TREES, Config, boosted_model, monthly_backtest, select_configs
from tallycast.models.topdown import split_total
from tallycast.operators.features import feature_table, strict_features
from tallycast.operators.panel import total_series
from tallycast.operators.profile import append_all
from tallycast.plans.holdout import topdown_smoothing
from tallycast.sources.sinks import stage
from tallycast.spec import Setting

COLUMNS = ("spec", "model", "issue_date", "cutoff", "target_start", "target_end", "grp", "y_true", "y_pred")


def months_of(start: str, end: str) -> list[str]:
    (y, m), (last_y, last_m) = (map(int, d.split("-")[:2]) for d in (start, end))
    return [f"{k // 12}-{k % 12 + 1:02d}-01" for k in range(y * 12 + m - 1, last_y * 12 + last_m)]


def _linear_rows(panel: DataFrame, config: Config, setting: Setting, start: str, end: str, groups: Sequence[int]) -> DataFrame:
    if setting.window_days != 1:
        raise ValueError(f"{config.name} forecasts single days, not {setting.key}")
    issue = setting.issue_of_start(F.col("date"))
    return linear.monthly_linear(strict_features(panel), groups, start, end, setting.gap_days).select(
        F.lit(setting.key).alias("spec"), F.lit(config.name).alias("model"), issue.alias("issue_date"), setting.cutoff_of_issue(issue).alias("cutoff"),
        F.col("date").alias("target_start"), F.col("date").alias("target_end"), "grp", "y_true", "y_pred")


def _topdown_boosted(panel: DataFrame, configs: Sequence[Config], setting: Setting, months: Sequence[str], shape: Mapping[str, int], params: Mapping[str, object]) -> DataFrame:
    """Boosted forecasts of the total, split by recent shares."""
    totals = stage(feature_table(total_series(panel), setting), "total-features")
    rows = boosted_backtest(totals, [boosted_model(c, params) for c in configs], setting, months, **shape)
    parts = []
    for c in configs:
        total = rows.where(F.col("model") == c.name).select("cutoff", F.col("y_pred").alias("total"))
        parts.append(smoothing.with_truth(split_total(panel, total), panel, setting, c.name))
    return append_all(parts)


def registry_run(panel: DataFrame, names: Sequence[str] | None, setting: Setting, start: str, end: str, groups: Sequence[int],
                 trees: int = TREES, params: Mapping[str, object] | None = None) -> DataFrame:
    """Prediction rows of the named configurations (all, if None) with monthly refits over [start, end].

    Every kind has its own fit; a kind without one is an error, so nothing runs under a wrong
    name. The feature table is written once, and only if a named model reads it. Boosted models
    grow together, with so many trees and these parameters.
    """
    configs, months = select_configs(names), months_of(start, end)
    shape, params = {"trees": trees, "depth": DEPTH}, params or {}
    tables: list[DataFrame] = []

    def features() -> DataFrame:
        if not tables:
            tables.append(stage(feature_table(panel, setting), "features"))
        return tables[0]

    def boosted(cs: list[Config]) -> DataFrame:
        flat, top = ([c for c in cs if (c.level == "topdown") is t] for t in (False, True))
        parts = [boosted_backtest(features(), [boosted_model(c, params) for c in flat], setting, months, **shape)] if flat else []
        return append_all([p.select(*COLUMNS) for p in [*parts, *([_topdown_boosted(panel, top, setting, months, shape, params)] if top else [])]])

    def learner(c: Config) -> DataFrame:
        return monthly_backtest(features(), c, setting, months)

    def negative_binomial(c: Config) -> DataFrame:
        return negbin.monthly_backtest(features(), groups, setting, months, c.name)

    def smoothed(c: Config) -> DataFrame:
        if c.level == "topdown":
            return topdown_smoothing(panel, setting, start, end)
        return smoothing.with_truth(smoothing.smoothing_forecasts(panel, setting, start, end), panel, setting, c.name)

    def autoregressive(c: Config) -> DataFrame:
        return smoothing.with_truth(smoothing.ar_forecasts(panel, setting, start, end), panel, setting, c.name)

    def straight(c: Config) -> DataFrame:
        return _linear_rows(panel, c, setting, start, end, groups)

    runs: dict[str, Callable[[Config], DataFrame]] = {"glm": learner, "negbin": negative_binomial, "linear": straight, "smoothing": smoothed, "ar": autoregressive}
    for c in configs:
        if c.kind not in (*runs, "boost"):
            raise ValueError(f"{c.name}: no fit for kind {c.kind!r}")
    together = [c for c in configs if c.kind == "boost"]
    parts = [boosted(together)] if together else []
    return append_all([p.select(*COLUMNS) for p in [*parts, *(runs[c.kind](c) for c in configs if c.kind != "boost")]])
