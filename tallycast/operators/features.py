"""Leakage-safe features for every cutoff at once.

Each panel date is a cutoff; the row describes the forecast issued
``publication_lag_days`` later. All level features look backward from the cutoff in one
window definition (partition by group, order by date), so the whole table costs one
exchange and one sort, shared with the panel's own gap filling.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tallycast.functions.calendar import window_calendar
from tallycast.functions.stats import Running, rolling, safe_ratio, strict_sum
from tallycast.spec import Setting, min_samples

# Feature set.
LAG_COUNT = 7
MEAN_DAYS = (7, 14, 28, 91)
SD_DAYS = 28
WEEKDAY_WEEKS = (4, 13)
SHARE_DAYS = (7, 28)
LOOKBACK_DAYS = 90

LEVEL_COLUMNS = (
    *(f"lag_{k}" for k in range(LAG_COUNT)),
    *(f"mean_{d}d" for d in MEAN_DAYS),
    f"sd_{SD_DAYS}d",
    "ratio_7_28",
    "ratio_28_91",
    *(f"same_wd_{w}w" for w in WEEKDAY_WEEKS),
    *(f"sub_share_{d}d" for d in SHARE_DAYS),
)
CALENDAR_COLUMNS = (
    "target_weekday", "target_month", "target_doy_sin", "target_doy_cos", "holidays", "holiday_adjacent",
)
KEY_COLUMNS = ("issue_date", "cutoff", "target_start", "grp")

def series() -> WindowSpec:
    """Rows of one group in date order: the window every level feature shares."""
    return Window.partitionBy("grp").orderBy("date")


def first_week(ahead: int) -> int:
    """Weeks to step back so that a source day is on or before the cutoff."""
    return -(-ahead // 7)


def extend(panel: DataFrame, days: int) -> DataFrame:
    """Append ``days`` future rows with null counts to every series (``__real`` is false).

    Forecasts whose targets lie past the end of the panel then exist like any other.
    """
    last = F.lead("date").over(series()).isNull()
    rows = panel.select("date", "grp", "n", "n_sub", F.when(last, F.lit(days)).otherwise(F.lit(0)).alias("__ext"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("__ext"))).alias("__ahead"))
    real = F.col("__ahead") == 0
    return rows.select(
        F.date_add("date", F.col("__ahead")).alias("date"), "grp",
        F.when(real, F.col("n")).alias("n"), F.when(real, F.col("n_sub")).alias("n_sub"), real.alias("__real"),
    )


def with_same_weekday(longer: DataFrame, setting: Setting, weeks: Sequence[int]) -> DataFrame:
    """Add ``same_wd_<w>w``, the same-weekday forecast total of the window of each cutoff row.

    The mean of a target day over the last w usable weeks is a difference of running
    sums over (group, weekday); the window total then sums those means over the target rows. That
    is a handful of columns instead of weeks x window lags, and the exchange by group
    serves both sorts. ``longer`` comes from :func:`extend`.
    """
    ahead = [setting.gap_days + j for j in range(setting.window_days)]
    runs: dict[int, list[int]] = {}
    for a in ahead:
        runs.setdefault(first_week(a), []).append(a)
    run = Running(Window.partitionBy("grp", "__wd").orderBy("date"), {"wd": F.col("n")})
    rows = longer.withColumn("__wd", F.weekday("date"))
    rows = rows.select("*", *(c.alias(k) for k, c in run.columns.items()))
    day = {f"__p_{w}_{f}": run.mean("wd", w, min_samples(w), end=-f) for w in weeks for f in runs}
    rows = rows.select("*", *(c.alias(k) for k, c in day.items()))

    def total(w: int) -> Column:
        parts = []
        for f, span in runs.items():
            frame, p = series().rowsBetween(span[0], span[-1]), F.col(f"__p_{w}_{f}")
            parts.append(F.when(F.count(p).over(frame) == len(span), F.sum(p).over(frame)))
        return strict_sum(parts)

    return rows.select(*longer.columns, *(total(w).alias(f"same_wd_{w}w") for w in weeks))


def horizon_days(setting: Setting) -> int:
    return setting.gap_days + setting.window_days - 1


def forward_total(n: Column, setting: Setting) -> Column:
    """Total over the target window; null when a target day is missing or off the end."""
    frame = series().rowsBetween(setting.gap_days, setting.gap_days + setting.window_days - 1)
    return F.when(F.count(n).over(frame) == setting.window_days, F.sum(n).over(frame).cast("double"))


def running_counts(longer: DataFrame, spread: bool = False) -> tuple[DataFrame, Running]:
    """Add the running sums every level feature is read from; those of squares only if ``spread``."""
    run = Running(series(), {"n": F.col("n"), "sub": F.col("n_sub"), **(Running.squares("sq", F.col("n")) if spread else {})})
    return longer.select("*", *(c.alias(k) for k, c in run.columns.items())), run


def window_total(run: Running, setting: Setting) -> Column:
    """Total over the target window from running sums; null when a day is missing or off the end."""
    first, last = setting.gap_days, horizon_days(setting)
    return F.when(run.known("n", first, last) == setting.window_days, run.total("n", first, last).cast("double"))


def level_columns(run: Running, setting: Setting) -> dict[str, Column]:
    out = {f"lag_{k}": F.lag("n", k).over(run.w).cast("double") for k in range(LAG_COUNT)}
    for d in MEAN_DAYS:
        out[f"mean_{d}d"] = run.mean("n", d, min_samples(d))
    out[f"sd_{SD_DAYS}d"] = run.sample_sd("n", "sq", SD_DAYS, min_samples(SD_DAYS))
    for w in WEEKDAY_WEEKS:
        out[f"same_wd_{w}w"] = F.col(f"same_wd_{w}w") / setting.window_days
    for d in SHARE_DAYS:
        need = min_samples(d)
        out[f"sub_share_{d}d"] = safe_ratio(run.gated_total("sub", d, need), run.gated_total("n", d, need))
    return out


def with_ratios(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "ratio_7_28": safe_ratio(F.col("mean_7d"), F.col("mean_28d")),
            "ratio_28_91": safe_ratio(F.col("mean_28d"), F.col("mean_91d")),
        }
    )


def with_timing(df: DataFrame, setting: Setting) -> DataFrame:
    """Timing columns derived from the row's date, which is the cutoff."""
    cut = F.col("date")
    issue = setting.issue_of_cutoff(cut)
    return df.withColumns(
        {
            "issue_date": issue,
            "cutoff": cut,
            "target_start": setting.start_of_issue(issue),
            "target_end": setting.end_of_issue(issue),
        }
    )


def feature_table(panel: DataFrame, setting: Setting) -> DataFrame:
    """Keys, 18 level and 6 calendar features and the target ``y`` for every cutoff."""
    longer = with_same_weekday(extend(panel, horizon_days(setting)), setting, WEEKDAY_WEEKS)
    longer, run = running_counts(longer, spread=True)
    wide = longer.select("date", "grp", "__real", *(c.alias(k) for k, c in level_columns(run, setting).items()),
                         window_total(run, setting).alias("y")).where("__real")
    wide = with_timing(with_ratios(wide), setting)
    wide = window_calendar(wide, "target_start", setting.window_days)
    return wide.select(*KEY_COLUMNS, *LEVEL_COLUMNS, *CALENDAR_COLUMNS, "y")


def issue_rows(panel: DataFrame, issue_date: str, setting: Setting) -> DataFrame:
    """Features of one issue date from the 91-day tail only.

    The date filter sits below the windows, because the optimizer does not push a filter
    on the order key through a window; with a date-partitioned panel it prunes files.
    """
    cutoff = setting.cutoff_of_issue(F.lit(issue_date).cast("date"))
    tail = panel.where(F.col("date").between(F.date_sub(cutoff, LOOKBACK_DAYS), cutoff))
    return feature_table(tail, setting).where(F.col("cutoff") == cutoff)


def training_rows(features: DataFrame) -> DataFrame:
    """Rows a model can learn from: known target, positive level."""
    return features.where(F.col("y").isNotNull() & (F.col("mean_28d") > 0))


def level_offset(setting: Setting) -> dict[str, Column]:
    level = F.col("mean_28d") * setting.window_days
    return {"level": level, "log_level": F.when(level > 0, F.log(level))}


# --- strict variant: target-date keyed, all values of a window required -------------

STRICT_LAGS = (3, 7, 14, 28)
STRICT_MEANS = (7, 14)
STRICT_GAP = 3
STRICT_CALENDAR = ("day_of_week", "month", "day_of_month", "is_weekend", "day_of_year")
STRICT_NUMERIC = (
    *STRICT_CALENDAR, *(f"lag_{k}" for k in STRICT_LAGS), *(f"rolling_mean_{k}" for k in STRICT_MEANS),
)


def strict_calendar(day: Column) -> dict[str, Column]:
    """0 = Monday weekday and friends, as 64-bit integers."""
    wd = F.weekday(day)
    return {
        "day_of_week": wd.cast("bigint"),
        "month": F.month(day).cast("bigint"),
        "day_of_month": F.dayofmonth(day).cast("bigint"),
        "is_weekend": (wd >= 5).cast("bigint"),
        "day_of_year": F.dayofyear(day).cast("bigint"),
    }


def strict_features(panel: DataFrame) -> DataFrame:
    """12-feature table keyed by target date: the group, calendar, lags, full-window means."""
    n = F.col("n")
    cols = {f"lag_{k}": F.lag(n, k).over(series()).cast("double") for k in STRICT_LAGS}
    cols |= {f"rolling_mean_{k}": rolling(F.avg, n, series(), k, k, end=-STRICT_GAP) for k in STRICT_MEANS}
    return panel.select("date", "grp", "n", *(c.alias(k) for k, c in (strict_calendar(F.col("date")) | cols).items()))


def feature_completeness(features: DataFrame) -> DataFrame:
    """Rows with a missing feature, by cause: start of the series or a missing day."""
    first = F.min("date").over(Window.partitionBy("grp"))
    missing = F.lit(False)
    for c in STRICT_NUMERIC:
        missing = missing | F.col(c).isNull()
    early = F.datediff("date", "__first") < max(STRICT_LAGS)
    return features.withColumn("__first", first).groupBy("grp").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(missing).alias("rows_missing_feature"),
        F.count_if(missing & early).alias("missing_at_start"),
        F.count_if(missing & ~early).alias("missing_from_gap"),
        F.count_if(F.col("n").isNull()).alias("unknown_target"),
    )


def day_steps(panel: DataFrame) -> DataFrame:
    """Continuity check: rows per group whose step from the previous row is not one day."""
    step = F.datediff("date", F.lag("date").over(series()))
    return panel.select("grp", step.alias("step")).groupBy("grp").agg(
        F.count("step").alias("steps"), F.count_if(F.col("step") != 1).alias("broken_steps")
    )


def lag_alignment(features: DataFrame, panel: DataFrame, lags=STRICT_LAGS, means=STRICT_MEANS) -> DataFrame:
    """Compare stored lags and rolling means with values recomputed by date arithmetic.

    Every panel day is shifted forward once per lag and joined on (group, date); rolling
    means are re-aggregated from the shifted days. Returns mismatch counts per feature.
    """
    def shifted(k: int) -> DataFrame:
        return panel.select("grp", F.date_add("date", k).alias("date"), F.col("n").cast("double").alias("expected"))

    def mismatch(name: str, expected: DataFrame) -> DataFrame:
        a, b = F.col(name), F.col("expected")
        same = a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= 1e-9 * F.greatest(F.abs(b), F.lit(1.0)), F.lit(False))
        joined = features.select("grp", "date", name).join(expected, ["grp", "date"], "left")
        return joined.agg(
            F.lit(name).alias("feature"), F.count(F.lit(1)).alias("compared"), F.count_if(~same).alias("mismatches")
        )

    parts = [mismatch(f"lag_{k}", shifted(k)) for k in lags]
    for k in means:
        span = F.sequence(F.lit(STRICT_GAP), F.lit(STRICT_GAP + k - 1))
        exploded = panel.select("grp", F.explode(span).alias("s"), "date", "n").select(
            "grp", F.date_add("date", F.col("s")).alias("date"), "n"
        )
        rolled = exploded.groupBy("grp", "date").agg(
            F.when(F.count("n") == k, F.avg("n")).alias("expected")
        )
        parts.append(mismatch(f"rolling_mean_{k}", rolled))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
