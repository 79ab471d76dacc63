"""Learners with monthly refits on the feature table: boosted trees by histograms and the library's log-link GLMs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Pipeline
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.functions.quantiles import exact_quantiles
from tallycast.models.boosting import Model, boosted_backtest
from tallycast.operators.features import CALENDAR_COLUMNS, LEVEL_COLUMNS
from tallycast.operators.profile import append_all
from tallycast.spec import Setting

INPUTS = (*LEVEL_COLUMNS, *CALENDAR_COLUMNS)
# Untuned defaults.
TREES, DEPTH = 400, 4
TWEEDIE_POWER = 1.5
# Refit months that the driver has under way at once.
FIT_THREADS = 8


@dataclass(frozen=True)
class Config:
    """One model configuration. ``level``: none, ratio (label / level, weight = level) or offset."""

    name: str
    kind: str
    level: str = "none"
    params: Mapping[str, object] = field(default_factory=dict)


# The registry of configurations. Names say loss and level mode; sym_ grows symmetric trees,
# the others choose a split for each node.
REGISTRY: tuple[Config, ...] = (
    Config("gbt_poisson", "boost", "offset", {"loss": "poisson"}),
    Config("gbt_tweedie", "boost", "offset", {"loss": "tweedie", "power": TWEEDIE_POWER}),
    Config("gbt_poisson_raw", "boost", "none", {"loss": "poisson"}),
    Config("sym_poisson", "boost", "offset", {"loss": "poisson", "symmetric": True}),
    Config("sym_tweedie", "boost", "offset", {"loss": "tweedie", "power": TWEEDIE_POWER, "symmetric": True}),
    Config("gbt_l2_raw", "boost", "none", {"loss": "squared"}),
    Config("gbt_l1_raw", "boost", "none", {"loss": "absolute"}),
    Config("gbt_l1", "boost", "ratio", {"loss": "absolute"}),
    Config("glm_poisson", "glm", "offset", {"family": "poisson", "link": "log"}),
    Config("glm_tweedie", "glm", "offset", {"family": "tweedie", "variancePower": TWEEDIE_POWER, "linkPower": 0.0}),
    Config("glm_poisson_raw", "glm", "none", {"family": "poisson", "link": "log"}),
    Config("nb_glm", "negbin", "offset"),
    Config("linear", "linear"),
    Config("ets_weekly", "smoothing"),
    Config("ar_calendar", "ar"),
    Config("topdown_gbt_poisson_raw", "boost", "topdown", {"loss": "poisson"}),
    Config("topdown_ets", "smoothing", "topdown"),
)
CANDIDATES = ("gbt_poisson_raw", "gbt_poisson", "sym_tweedie", "ets_weekly", "topdown_ets")


def boosted_model(config: Config, params: Mapping[str, object] | None = None, name: str | None = None) -> Model:
    """The boosted model of a configuration; its top-down base predicts raw totals."""
    if config.kind != "boost":
        raise ValueError(f"{config.name}: kind {config.kind!r} is not boosted")
    level = "none" if config.level == "topdown" else config.level
    return Model(name or config.name, level=level, **{**config.params, **(params or {})})


def select_configs(names: Sequence[str] | None = None) -> list[Config]:
    """Configurations by name, in registry order; an unknown name is an error."""
    known = {c.name: c for c in REGISTRY}
    wanted = list(known) if names is None else list(names)
    missing = sorted(set(wanted) - set(known))
    if missing:
        raise ValueError(f"unknown models {missing}; known are {sorted(known)}")
    return [c for c in REGISTRY if c.name in wanted]


def training_medians(train: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Imputation value per input: the sketched median, merged map-side, one number per column."""
    row = train.agg(*(F.percentile_approx(c, 0.5, F.lit(100000)).alias(c) for c in columns)).first()
    return {c: float(row[c] or 0.0) for c in columns}


def prepared(rows: DataFrame, fills: Mapping[str, float], setting: Setting) -> DataFrame:
    """Imputed inputs with one missing flag, level and log level."""
    missing = F.lit(0.0)
    for c in LEVEL_COLUMNS:
        missing = missing + F.col(c).isNull().cast("double")
    level = F.col("mean_28d") * setting.window_days
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(float(fills[c]))) for c in INPUTS}
    return rows.withColumns({"missing": missing, "level": level, "log_level": F.log(level)}).withColumns(filled)


def _stages(config: Config, params: Mapping[str, object]) -> list:
    if config.kind != "glm":
        raise ValueError(f"{config.name}: kind {config.kind!r} is not fitted here; plans.registry dispatches it")
    from pyspark.ml.feature import OneHotEncoder

    index = StringIndexer(inputCol="grp_key", outputCol="grp_index", handleInvalid="keep", stringOrderType="alphabetAsc")
    hot = OneHotEncoder(inputCol="grp_index", outputCol="grp_hot", handleInvalid="keep")
    vector = VectorAssembler(inputCols=[*INPUTS, "missing", "grp_hot"], outputCol="x")
    offset = {"offsetCol": "log_level"} if config.level == "offset" else {}
    glm = GeneralizedLinearRegression(featuresCol="x", labelCol="label", predictionCol="raw", **offset, **{"regParam": 1e-4, "maxIter": 25, **config.params, **params})
    return [index, hot, vector, glm]


def month_training(features: DataFrame, month: str, setting: Setting) -> DataFrame:
    """Rows whose whole target was known at the cutoff of the month's first issue date."""
    first = F.lit(month).cast("date")
    known = setting.end_of_issue(F.col("issue_date")) <= setting.cutoff_of_issue(first)
    return features.where(F.col("y").isNotNull() & (F.col("mean_28d") > 0) & known)


def month_issues(features: DataFrame, month: str) -> DataFrame:
    first = F.lit(month).cast("date")
    return features.where((F.col("issue_date") >= first) & (F.col("issue_date") < F.add_months(first, 1)))


def monthly_backtests(features: DataFrame, config: Config, setting: Setting, months: Sequence[str],
                      trials: Sequence[Mapping[str, object]]) -> list[DataFrame]:
    """Prediction rows of each parameter set: refit monthly on everything known, then predict.

    Boosted sets grow together, tree by tree; "trees" and "depth" are those of the first set. For GLMs
    the driver loops over refit months and sets, and every fit is distributed; imputation and training
    rows of a month are prepared once and shared by all sets. ``features`` is read several times, so
    pass a staged table.
    """
    if config.kind == "boost":
        shape = {"trees": TREES, "depth": DEPTH, **{k: v for k, v in trials[0].items() if k in ("trees", "depth")}}
        models = [boosted_model(config, {k: v for k, v in t.items() if k not in shape}, f"{config.name}_{i}") for i, t in enumerate(trials)]
        rows = boosted_backtest(features, models, setting, months, **shape)
        return [rows.where(F.col("model") == m.name).withColumn("model", F.lit(config.name)) for m in models]

    def of_month(month: str) -> list[DataFrame]:
        train = month_training(features, month, setting)
        fills = training_medians(train, INPUTS)
        rows = prepared(train, fills, setting).withColumns({"label": F.col("y").cast("double"), "grp_key": F.col("grp").cast("string")})
        rows = rows.select("label", "level", "log_level", "grp_key", "missing", *INPUTS).persist()
        ready = prepared(month_issues(features, month), fills, setting).where("level > 0").withColumn("grp_key", F.col("grp").cast("string"))
        parts = []
        for params in trials:
            model = Pipeline(stages=_stages(config, params)).fit(rows)
            parts.append(_rows(model.transform(ready).withColumn("y_pred", F.col("raw")), config.name, setting))
        rows.unpersist()
        return parts

    with ThreadPoolExecutor(FIT_THREADS) as pool:  # months are independent; each fit is distributed
        by_month = list(pool.map(of_month, months))
    return [append_all([parts[i] for parts in by_month]) for i in range(len(trials))]


def monthly_backtest(features: DataFrame, config: Config, setting: Setting, months: Sequence[str], params: Mapping[str, object] | None = None) -> DataFrame:
    return monthly_backtests(features, config, setting, months, [params or {}])[0]


def _rows(predicted: DataFrame, name: str, setting: Setting) -> DataFrame:
    return predicted.select(
        F.lit(setting.key).alias("spec"), F.lit(name).alias("model"), "issue_date", "cutoff", "target_start",
        setting.end_of_issue(F.col("issue_date")).alias("target_end"), "grp", F.col("y").alias("y_true"), "y_pred")


def median_column(rows: DataFrame, column: str) -> float:
    """Exact training median of one column, through the bracketed quantile."""
    value = exact_quantiles(rows, [], column, {"m": 0.5}).select("m").first()
    return 0.0 if value is None or value[0] is None else float(value[0])


