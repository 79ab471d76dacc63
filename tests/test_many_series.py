"""Series models that take many series at once, held against one series at a time."""

import datetime as dt

import numpy as np
import pyarrow as pa
import pytest

from helpers import PANEL, day
from tallycast.models import smoothing as SM
from tallycast.operators import decompose as D
from tallycast.operators.series import whole_series
from tallycast.spec import DAILY, WEEKLY


def plain_loess(y, at, span, robust):
    """Weighted local lines, one position at a time."""
    n, out = len(y), []
    for x0 in at:
        width = min(span, n)
        left = int(np.clip(np.ceil(x0 - (width - 1) / 2 - 1e-9), 0, n - width))
        x = np.arange(left, left + width)
        h = max(np.abs(x - x0).max() + max(span - n, 0) // 2, 1e-9)
        d = np.abs(x - x0) / h
        w = np.where(d < 0.999, (1 - d**3) ** 3, 0.0) * robust[x]
        mean = (w * x).sum() / w.sum()
        var = (w * (x - mean) ** 2).sum() / w.sum()
        slope = (w * (x - mean) * y[x]).sum() / w.sum() / var if np.sqrt(var) > 0.001 * (n - 1) else 0.0
        out.append((w * y[x]).sum() / w.sum() + slope * (x0 - mean))
    return np.array(out)


def plain_stl(y, rounds=15):
    n, trend, robust = len(y), np.zeros(len(y)), np.ones(len(y))
    for r in range(rounds + 1):
        for _ in range(2):
            cycle = np.empty(n + 14)
            for k in range(7):
                sub = (y - trend)[k::7]
                cycle[k::7][: len(sub) + 2] = plain_loess(sub, np.arange(-1, len(sub) + 1), 7, robust[k::7])
            smooth = cycle
            for width in (7, 7, 3):
                smooth = np.convolve(smooth, np.ones(width) / width, "valid")
            seas = cycle[7:-7] - plain_loess(smooth, np.arange(n), 8 + 1, np.ones(n))
            trend = plain_loess(y - seas, np.arange(n), 29, robust)
        rest = np.abs(y - seas - trend)
        if r < rounds:
            u = rest / (6 * np.median(rest))
            robust = np.where(u <= 0.001, 1.0, np.where(u <= 0.999, (1 - u**2) ** 2, 0.0))
    return seas, trend, y - seas - trend


@pytest.mark.parametrize("days", [45, 100])
def test_decomposition_of_many_series_is_that_of_each(days):
    rng, t = np.random.default_rng(days), np.arange(days)
    y = np.stack([50 + g + 0.1 * t + 9 * np.sin(2 * np.pi * t / 7) + rng.normal(0, 2, days) for g in range(3)], axis=1)
    y[days // 2, 1] += 80
    got = D.stl(y)
    for g in range(3):
        for a, b in zip(got, plain_stl(y[:, g]), strict=True):
            assert np.allclose(a[:, g], b, rtol=0, atol=1e-8)


def test_decompose_series_of_several_lengths(spark, monkeypatch):
    """Series that begin on different days, one too short, cut over many batches."""
    monkeypatch.setattr(D, "BATCH_VALUES", 64)
    rng, rows = np.random.default_rng(2), []
    for g, days in enumerate((60, 80, 60, 5, 80)):
        rows += [(day("2024-01-01") + dt.timedelta(days=i), g, int(n), 0) for i, n in enumerate(rng.poisson(40, days))]
    got = D.decompose(spark.createDataFrame(rows, PANEL)).toPandas().sort_values(["grp", "date"])
    assert len(got) == len(rows)
    for g, part in got.groupby("grp"):
        if len(part) < 14:
            assert part["resid"].isna().all()
        else:
            assert np.allclose(part["resid"].astype(float), plain_stl(part["n"].to_numpy(float))[2], rtol=0, atol=1e-7)


def test_whole_series_across_batches():
    grp = ["a"] * 3 + ["b"] * 7 + [None] * 2 + ["c"]
    batches = [pa.RecordBatch.from_arrays([pa.array(grp[i : i + 2], pa.string()), pa.array(range(i, min(i + 2, 13)))], names=["grp", "x"]) for i in range(0, 13, 2)]
    got = [(t["grp"][int(a)].as_py(), t["x"].to_pylist()[a:b]) for t, ends in whole_series(iter(batches), 4) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    assert got == [("a", [0, 1, 2]), ("b", list(range(3, 10))), (None, [10, 11]), ("c", [12])]


def plain_forecasts(days, n, setting, lo, hi):
    """One series, one issue at a time: states of every pair up to the refit, the best pair's state at the cutoff."""
    lag, gap, width = setting.publication_lag_days, setting.gap_days, setting.window_days
    issues = [d + lag for d in days if d + gap >= lo and d + gap + width - 1 <= hi and (d + gap - lo) % width == 0]
    known = [d for d, v in zip(days, n) if v is not None and v > 0]
    out = {}
    month = lambda d: (dt.date(1970, 1, 1) + dt.timedelta(days=d)).strftime("%Y-%m")
    for issue in issues:
        refit = min(i for i in issues if month(i) == month(issue))
        fit, now = ([d for d in known if d <= x - lag] for x in (refit, issue))
        out[issue] = None
        if not fit or fit[-1] - known[0] < SM.MIN_DAYS or len(fit) < SM.MIN_FIT_DAYS:
            continue
        y = np.interp(np.arange(known[0], known[-1] + 1), known, np.log([v for v in n if v is not None and v > 0]))
        best = None
        for a, g in SM.GRID:
            level, season, sse, at = y[:14].mean(), y[:14].reshape(2, 7).mean(axis=0) - y[:14].mean(), 0.0, {}
            for t in range(now[-1] - known[0] + 1):
                e = y[t] - level - season[t % 7]
                sse, level = sse + e * e, level + a * e
                season[t % 7] += g * e
                at[t] = sse
            if best is None or at[fit[-1] - known[0]] < best[0]:
                best = (at[fit[-1] - known[0]], level, season)
        first = issue - lag + gap - known[0]
        out[issue] = sum(np.exp(best[1] + best[2][(first + j) % 7]) for j in range(width))
    return out


@pytest.mark.parametrize("setting", [DAILY, WEEKLY])
def test_smoothing_of_many_series_is_that_of_each(spark, monkeypatch, setting):
    """Series that begin on different days, sparse ones, one without any count; folded together over several batches."""
    monkeypatch.setattr(SM, "BATCH_ROWS", 300)
    rng, base, rows, series = np.random.default_rng(3), (day("2024-01-01") - dt.date(1970, 1, 1)).days, [], {}
    for g, (skip, rate) in enumerate(((0, 30), (3, 30), (11, 0.7), (0, 0), (30, 5))):
        days = list(range(base + skip, base + 200))
        n = [None if d == base + 150 else int(x) for d, x in zip(days, rng.poisson(rate, len(days)))]
        series[g] = (days, n)
        rows += [(dt.date(1970, 1, 1) + dt.timedelta(days=d), g, x, None if x is None else 0) for d, x in zip(days, n)]
    lo, hi = (day(x) for x in ("2024-05-06", "2024-07-18"))  # a Monday
    got = {(r.grp, (r.issue_date - dt.date(1970, 1, 1)).days): r.y_pred for r in SM.smoothing_forecasts(spark.createDataFrame(rows, PANEL), setting, str(lo), str(hi)).collect()}
    want = {(g, i): v for g, (d, n) in series.items() for i, v in plain_forecasts(d, n, setting, (lo - dt.date(1970, 1, 1)).days, (hi - dt.date(1970, 1, 1)).days).items()}
    assert got.keys() == want.keys() and sum(v is not None for v in want.values()) > 5
    assert all(v == pytest.approx(want[k], rel=1e-9) if want[k] is not None else v is None for k, v in got.items())
