"""Rolling-origin back-test: all issue dates of a period in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.operators.baselines import PLAIN_DAYS, WEEK_CANDIDATES, baseline_wide, in_schedule, to_rows
from tallycast.operators.metrics import guard_counts
from tallycast.spec import Setting


def rolling_origin(panel: DataFrame, setting: Setting, start: str, end: str,
                   weeks: Sequence[int] = WEEK_CANDIDATES, plain: Sequence[int] = (PLAIN_DAYS,),
                   test_start: str | None = None, allow_test: bool = False) -> DataFrame:
    """Baseline forecasts of every window in [start, end] as they would have been issued.

    Features are cutoff-safe by their frames, so no loop over issue dates is needed.
    """
    if test_start is not None and end >= test_start and not allow_test:
        raise ValueError(f"end {end} reaches the test period ({test_start}+)")
    names = [*(f"same_wd_{w}w" for w in weeks), *(f"plain_{d}d" for d in plain)]
    if len(set(names)) != len(names):
        raise ValueError(f"model names repeat: {names}")
    wide = baseline_wide(panel, setting, weeks, plain)
    return to_rows(wide.where(in_schedule(setting, start, end)), setting, names)


def require_forecasts(results: DataFrame) -> DataFrame:
    """Raise when a scored window has no forecast; sparse data may prefer the counts."""
    bad = guard_counts(results).where("null_forecasts > 0 or repeated_keys > 0").take(1)
    if bad:
        raise ValueError(f"null forecasts or repeated keys on scored windows: {bad[0].asDict()}")
    return results


def pipeline(recs: DataFrame, setting: Setting, start: str, end: str, keep=None, **kw) -> DataFrame:
    """Records -> panel -> prediction rows."""
    from tallycast.operators.panel import daily_panel

    return rolling_origin(daily_panel(recs, keep), setting, start, end, **kw)


def cutoff_month(results: DataFrame) -> DataFrame:
    """Refit month of each row: the month of its issue date."""
    return results.withColumn("refit_month", F.trunc("issue_date", "month"))
