"""Weekly exponential smoothing and calendar autoregression on log counts, per series.

A series is bounded by the calendar. Smoothing folds many series together in one pass over
their days, which keeps for every parameter pair the running squared error and the state, so
monthly re-estimation costs nothing extra; autoregression takes one series at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.functions.calendar import fourier, iso_weekday, marked_days
from tallycast.operators.features import extend, horizon_days
from tallycast.operators.series import spread, whole_series
from tallycast.spec import Setting

# Week length, days needed for a fit and for a forecast, AR order.
WEEK, MIN_FIT_DAYS, MIN_DAYS, ORDER = 7, 91, 14, 7
# Fixed value: keeps the error terms solvable with few rows.
RIDGE = 1e-9
GRID = [(a, g) for a in (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.45, 0.6, 0.8) for g in (0.0, 0.01, 0.03, 0.06, 0.1, 0.2) if g <= 1 - a]


#: Rows of the series that a fold takes together, about.
BATCH_ROWS = 1 << 17


def fold_states(y: np.ndarray, first: np.ndarray, stop: np.ndarray, grid: list[tuple[float, float]], fit: tuple[np.ndarray, np.ndarray], read: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Level and weekly season at the days of ``read`` of the best pair of each fit, for many series in one pass over the days.

    ``y`` is (days, series) on a common calendar; series i runs from day ``first[i]`` to before ``stop[i]``. A fit is (series, day):
    the pair of least squared error up to that day. A read is (series, day, number of its fit), not before the day of its fit.
    Season k belongs to the days of the calendar that leave k when divided by seven. Additive error, no trend, start values from the first two weeks.
    """
    a, g = (np.array(v) for v in zip(*grid, strict=True))
    days, size = y.shape
    start = y[first + np.arange(2 * WEEK)[:, None], np.arange(size)]
    level = np.repeat(start.mean(axis=0)[:, None], len(grid), axis=1)
    season = np.empty((WEEK, size, len(grid)))
    season[(first + np.arange(WEEK)[:, None]) % WEEK, np.arange(size)] = (start.reshape(2, WEEK, size).mean(axis=0) - start.mean(axis=0))[..., None]
    total = np.zeros((size, len(grid)))
    best = np.zeros(len(fit[0]), int)
    levels, seasons = np.empty(len(read[0])), np.empty((len(read[0]), WEEK))
    fits, reads = (np.argsort(x[1], kind="stable") for x in (fit, read))
    fit_cuts, read_cuts = (np.searchsorted(x[1][order], np.arange(days + 1)) for x, order in ((fit, fits), (read, reads)))
    inside = np.arange(days)[:, None]
    inside = (inside >= first) & (inside < stop)
    y = np.where(inside, y, 0.0)
    for t in range(days):
        k, now = t % WEEK, inside[t]
        e = y[t][:, None] - level - season[k]
        if not now.all():
            e *= now[:, None]
        total += e * e
        level += a * e
        season[k] += g * e
        if fit_cuts[t] < fit_cuts[t + 1]:
            these = fits[fit_cuts[t] : fit_cuts[t + 1]]
            best[these] = total[fit[0][these]].argmin(axis=1)
        if read_cuts[t] < read_cuts[t + 1]:
            these = reads[read_cuts[t] : read_cuts[t + 1]]
            of, pair = read[0][these], best[read[2][these]]
            levels[these], seasons[these] = level[of, pair], season[:, of, pair].T
    return levels, seasons


def _log_days(day: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Interpolated log counts from first to last positive day, positions of the known days, first day number."""
    ok = np.flatnonzero(n > 0)
    if len(ok) == 0:
        return np.empty(0), ok, 0
    known = day[ok] - day[ok[0]]
    return np.interp(np.arange(known[-1] + 1), known, np.log(n[ok])), known, int(day[ok[0]])


def _issues(cut: np.ndarray, first: int, last: int, setting: Setting) -> np.ndarray:
    """Issue days whose cutoff lies inside the series and whose window starts in [first, last]."""
    start = cut + setting.gap_days
    use = (start >= first) & (start + setting.window_days - 1 <= last) & ((start - first) % setting.window_days == 0)
    return cut[use] + setting.publication_lag_days


def _month_firsts(issues: np.ndarray) -> np.ndarray:
    """First issue day of each issue's month."""
    months = issues.astype("datetime64[D]").astype("datetime64[M]")
    firsts = pd.Series(issues).groupby(months.astype(int)).transform("min")
    return firsts.to_numpy()


def smoothing_forecasts(panel: DataFrame, setting: Setting, start: str, end: str) -> DataFrame:
    """``issue_date, cutoff, grp, y_pred`` of every scheduled window, re-estimated monthly.

    ``y_pred`` is null when fewer than 91 days are known at the month's refit. States are
    only read at known days, so a gap that is still open at a cutoff is never filled from
    its far side.
    """
    kind = panel.schema["grp"].dataType.simpleString()
    lo, hi = (int(np.datetime64(d, "D").astype(int)) for d in (start, end))
    if setting.window_days == WEEK:
        lo += -(lo + 3) % WEEK  # day 0 is a Thursday; weeks start on Mondays
    lag, gap, width = setting.publication_lag_days, setting.gap_days, setting.window_days

    def of_series(day: np.ndarray, n: np.ndarray) -> dict | None:
        """Issue days, log counts, and where the states of each issue are read; None if there is no issue day."""
        issues = _issues(day, lo, hi, setting)
        if not len(issues):
            return None
        y, known, day0 = _log_days(day, n)
        firsts = _month_firsts(issues)

        def last_known(cutoff: np.ndarray) -> np.ndarray:
            at = np.searchsorted(known, cutoff - day0, side="right") - 1
            return np.where(at >= 0, known[np.maximum(at, 0)], -1) if len(known) else np.full(len(cutoff), -1)

        fit_at, now = last_known(firsts - lag), last_known(issues - lag)
        usable = (fit_at >= MIN_DAYS) & (now >= MIN_DAYS) & (np.searchsorted(known, fit_at, side="right") >= MIN_FIT_DAYS)
        return {"issues": issues, "y": y, "day0": day0, "fit_at": fit_at, "now": now, "usable": usable}

    def forecasts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ends in whole_series(batches, BATCH_ROWS):
            day, n = rows["day"].to_numpy(zero_copy_only=False).astype(np.int64), rows["n"].to_numpy(zero_copy_only=False).astype(float)
            starts = np.concatenate([[0], ends[:-1]])
            series = [(a, s) for a, b in zip(starts, ends) if (s := of_series(day[a:b], n[a:b])) is not None]
            if not series:
                continue
            preds = [np.full(len(s["issues"]), np.nan) for _, s in series]
            fitted = [i for i, (_, s) in enumerate(series) if s["usable"].any()]
            if fitted:
                some = [series[i][1] for i in fitted]
                zero = min(s["day0"] for s in some)
                first = np.array([s["day0"] - zero for s in some])
                stop = first + [len(s["y"]) for s in some]
                y = np.zeros((int(stop.max()), len(some)))
                for i, s in enumerate(some):
                    y[first[i] : stop[i], i] = s["y"]
                uses = [np.flatnonzero(s["usable"]) for s in some]
                of = np.repeat(np.arange(len(some)), [len(u) for u in uses])
                fit_day, now = (np.concatenate([s[c][u] for s, u in zip(some, uses)]) + first[of] for c in ("fit_at", "now"))
                fits, number = np.unique(np.stack([of, fit_day]), axis=1, return_inverse=True)
                levels, seasons = fold_states(y, first, stop, GRID, (fits[0], fits[1]), (of, now, number.ravel()))
                issues = np.concatenate([s["issues"][u] for s, u in zip(some, uses)])
                target = (issues - lag + gap - zero)[:, None] + np.arange(width)
                sums = np.exp(levels[:, None] + np.take_along_axis(seasons, target % WEEK, axis=1)).sum(axis=1)
                for i, u, part in zip(fitted, uses, np.split(sums, np.cumsum([len(u) for u in uses])[:-1])):
                    preds[i][u] = part
            at = np.repeat([a for a, _ in series], [len(s["issues"]) for _, s in series])
            issue = np.concatenate([s["issues"] for _, s in series]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(issue), rows["grp"].take(pa.array(at)), pa.array(np.concatenate(preds), from_pandas=True)], names=["issue", "grp", "y_pred"])

    # Only positive days and cutoffs of issues matter to a series.
    start_of = F.unix_date("date") + gap
    asked = (start_of >= lo) & (start_of + width - 1 <= hi) & (F.pmod(start_of - lo, F.lit(width)) == 0)
    rows = panel.where((F.col("n") > 0) | asked).select(F.unix_date("date").alias("day"), "grp", F.col("n").cast("double").alias("n"))
    got = spread(rows).sortWithinPartitions("grp", "day").mapInArrow(forecasts, f"issue int, grp {kind}, y_pred double")
    issue = F.date_from_unix_date("issue")
    return got.select(issue.alias("issue_date"), setting.cutoff_of_issue(issue).alias("cutoff"), "grp", "y_pred")


def calendar_rows(panel: DataFrame, setting: Setting) -> DataFrame:
    """Daily rows with calendar regressors, extended past the end by the forecast horizon."""
    longer = extend(panel, horizon_days(setting))
    span = longer.agg(F.min(F.year("date")).alias("lo"), F.max(F.year("date")).alias("hi")).first()
    years = (span.lo - 1, span.hi + 1) if span.lo is not None else (2000, 2000)
    marks = F.broadcast(marked_days(panel.sparkSession, years).withColumnRenamed("day", "date"))  # a few days a year
    d = F.col("date")
    cols = {f"weekday_{k}": (iso_weekday(d) == k).cast("double") for k in range(2, 8)} | fourier(d, 3)
    cols |= {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("holiday", "adjacent")}
    named = [c.alias(k) for k, c in cols.items()]
    return longer.join(marks, "date", "left").select(
        F.unix_date("date").alias("day"), "grp", F.col("n").cast("double").alias("n"), F.col("__real").alias("real"), *named, F.lit(1.0).alias("const"))


def ar_forecasts(panel: DataFrame, setting: Setting, start: str, end: str) -> DataFrame:
    """Calendar regression with AR(7) errors on log counts, refitted monthly, forecast recursively."""
    kind = panel.schema["grp"].dataType.simpleString()
    lo, hi = (int(np.datetime64(d, "D").astype(int)) for d in (start, end))
    if setting.window_days == WEEK:
        lo += -(lo + 3) % WEEK
    lag, gap, width = setting.publication_lag_days, setting.gap_days, setting.window_days
    rows = calendar_rows(panel, setting)
    names = [c for c in rows.columns if c not in ("day", "grp", "n", "real")]

    def per_series(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        issues = _issues(pdf.loc[pdf["real"], "day"].to_numpy(), lo, hi, setting)
        out = pd.DataFrame({"issue": issues, "grp": pdf["grp"].iloc[0], "y_pred": np.nan})
        n, x, day0 = pdf["n"].to_numpy(float), pdf[names].to_numpy(float), int(pdf["day"].iloc[0])
        y = np.log(np.where(n > 0, n, np.nan))
        preds = np.full(len(issues), np.nan)
        firsts = _month_firsts(issues) if len(issues) else issues
        for first in np.unique(firsts):
            stop = first - lag - day0 + 1  # rows known at the refit
            ok = np.flatnonzero(~np.isnan(y[:stop]))
            if len(ok) < MIN_FIT_DAYS:
                continue
            beta = np.linalg.lstsq(x[ok], y[ok], rcond=None)[0]
            u = y - x @ beta
            past = np.lib.stride_tricks.sliding_window_view(u[:stop], ORDER + 1)
            past = past[~np.isnan(past).any(axis=1)]
            lags = past[:, :ORDER]  # a trace of ridge: few rows give small terms, none give zero
            phi = np.linalg.solve(lags.T @ lags + RIDGE * np.eye(ORDER), lags.T @ past[:, ORDER])
            for i in np.flatnonzero(firsts == first):
                now = issues[i] - lag - day0  # position of the cutoff
                tail = list(np.nan_to_num(u[max(now - 60, 0) : now + 1]))  # an unknown error has mean zero
                tail = [0.0] * max(ORDER - len(tail), 0) + tail
                for _ in range(gap + width - 1):
                    tail.append(float(np.dot(phi, tail[-ORDER:])))
                days = now + gap + np.arange(width)
                preds[i] = np.exp(x[days] @ beta + np.array(tail[-width:])).sum()
        out["y_pred"] = preds
        return out

    got = spread(rows).groupBy("grp").applyInPandas(per_series, f"issue int, grp {kind}, y_pred double")
    issue = F.date_from_unix_date("issue")
    return got.select(issue.alias("issue_date"), setting.cutoff_of_issue(issue).alias("cutoff"), "grp", F.when(~F.isnan("y_pred"), F.col("y_pred")).alias("y_pred"))


def with_truth(forecasts: DataFrame, panel: DataFrame, setting: Setting, name: str) -> DataFrame:
    """Prediction rows: truth attached by (group, cutoff)."""
    from tallycast.operators.features import forward_total, with_timing

    truth = panel.select("date", "grp", forward_total(F.col("n"), setting).alias("y_true"))
    joined = with_timing(truth, setting).drop("date").join(forecasts.select("grp", "cutoff", "y_pred"), ["grp", "cutoff"])
    return joined.select(F.lit(setting.key).alias("spec"), F.lit(name).alias("model"), "issue_date", "cutoff", "target_start", "target_end", "grp", "y_true", "y_pred")
