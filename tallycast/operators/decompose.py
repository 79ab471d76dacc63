"""Robust seasonal-trend decomposition per series and median polish of a two-way table."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.functions.quantiles import exact_quantiles
from tallycast.operators.series import interpolate, spread, whole_series
from tallycast.sources.sinks import stage


# --- LOESS on a regular grid: sums of a local fit are products of block matrices and the values, for many series at once ----

#: Output positions of a block of matrix rows, and values (days x series) that are decomposed together, about.
BLOCK, BATCH_VALUES = 16, 1 << 17


def _geometry(n: int, at: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbour positions and tricube weights of each fit position; independent of the data."""
    width = min(span, n)
    left = np.clip(np.ceil(at - (width - 1) / 2 - 1e-9).astype(int), 0, n - width)
    idx = left[:, None] + np.arange(width)[None, :]
    dist = np.abs(idx - at[:, None])
    h = dist.max(axis=1) + (max(span - n, 0) // 2)
    h = np.where(h == 0, 1.0, h)[:, None]
    tricube = np.where(dist <= 0.001 * h, 1.0, np.where(dist < 0.999 * h, (1 - (dist / h) ** 3) ** 3, 0.0))
    return idx, tricube


class _Band:
    """A matrix whose rows have few neighbouring entries, cut into blocks of rows: its product with (days, series)."""

    def __init__(self, idx: np.ndarray, kinds: list[np.ndarray], n: int) -> None:
        """``idx``: columns of the entries of each row; ``kinds``: their values, for one or several matrices."""
        self.rows = len(idx)
        starts = np.arange(0, self.rows, BLOCK)
        lasts = np.minimum(starts + BLOCK, self.rows) - 1
        width = int((idx[lasts, -1] - idx[starts, 0]).max()) + 1
        first = np.minimum(idx[starts, 0], n - width)
        self.columns = first[:, None] + np.arange(width)
        self.values = np.zeros((len(starts), len(kinds), BLOCK, width))
        block, row = np.divmod(np.arange(self.rows), BLOCK)
        for k, entries in enumerate(kinds):
            self.values[block[:, None], k, row[:, None], idx - first[block][:, None]] = entries

    def times(self, x: np.ndarray, kinds: int) -> list[np.ndarray]:
        """Products of the first matrices with ``x``."""
        blocks, _, _, width = self.values.shape
        out = self.values[:, :kinds].reshape(blocks, kinds * BLOCK, width) @ x[self.columns]
        out = out.reshape(blocks, kinds, BLOCK, -1)
        return [out[:, k].reshape(blocks * BLOCK, -1)[: self.rows] for k in range(kinds)]


class _Loess:
    """Local linear fits at fixed positions of series of n days (positions 0..n-1)."""

    def __init__(self, n: int, at: np.ndarray, span: int) -> None:
        idx, tricube = _geometry(n, at, span)
        off = idx - at[:, None]
        self.n, self.nearest = n, np.clip(np.rint(at).astype(int), 0, n - 1)
        self.band = _Band(idx, [tricube, tricube * off, tricube * off * off], n)

    def fit(self, y: np.ndarray, robust: np.ndarray) -> np.ndarray:
        """The fit of each column of ``y``, weights of neighbours multiplied by ``robust``."""
        total, first, second = self.band.times(robust, 3)
        level, slope = self.band.times(robust * y, 2)
        flat = total <= 0
        total = np.where(flat, 1.0, total)
        mean, level = first / total, level / total
        var = second / total - mean * mean
        on = var > (0.001 * (self.n - 1)) ** 2
        fit = level - np.where(on, mean / np.where(on, var, 1.0), 0.0) * (slope / total - mean * level)
        return np.where(flat, y[self.nearest], fit) if flat.any() else fit


def _low_pass(n: int, period: int, span: int) -> _Band:
    """Three moving averages and an unweighted local linear fit of a cycle of n + 2 periods, as one matrix."""
    idx, w = _geometry(n, np.arange(n, dtype=float), span)
    w = w / w.sum(axis=1, keepdims=True)
    off = idx - (w * idx).sum(axis=1, keepdims=True)
    var = (w * off * off).sum(axis=1)
    on = np.sqrt(var) > 0.001 * (n - 1)
    lever = np.where(on, (np.arange(n) - (w * idx).sum(axis=1)) / np.where(on, var, 1.0), 0.0)
    w = w * (1 + lever[:, None] * off)
    even = np.ones(period) / period
    taps = np.convolve(np.convolve(even, even), np.ones(3) / 3)
    entries = np.array([np.convolve(row, taps) for row in w])
    return _Band(idx[:, :1] + np.arange(entries.shape[1]), [entries], n + 2 * period)


@lru_cache(maxsize=4)
def _operators(n: int, period: int, seasonal: int, trend: int) -> tuple[dict[int, _Loess], _Band, _Loess]:
    """Fits of the cycles by length, the low-pass filter and the trend fit of series of n days."""
    lengths = {len(range(k, n, period)) for k in range(period)}
    cycles = {m: _Loess(m, np.arange(-1, m + 1, dtype=float), seasonal) for m in lengths}
    return cycles, _low_pass(n, period, period + 1 + period % 2), _Loess(n, np.arange(n, dtype=float), trend)


def stl(y: np.ndarray, period: int = 7, seasonal: int = 7, trend: int = 29, rounds: int = 15, inner: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seasonal, trend and remainder with bisquare robustness weights; ``y`` is one series, or (days, series) of one length."""
    if y.ndim == 1:
        return tuple(part[:, 0] for part in stl(y[:, None], period, seasonal, trend, rounds, inner))
    n, size = y.shape
    cycles, low, trend_fit = _operators(n, period, seasonal, trend)
    phases = {m: [k for k in range(period) if len(range(k, n, period)) == m] for m in cycles}
    weights, trend_c, seas = np.ones((n, size)), np.zeros((n, size)), np.zeros((n, size))

    def by_phase(x: np.ndarray, m: int) -> np.ndarray:
        return np.concatenate([x[k::period] for k in phases[m]], axis=1)

    for r in range(rounds + 1):
        for _ in range(inner):
            detrended = y - trend_c
            cycle = np.empty((n + 2 * period, size))
            for m, fit in cycles.items():
                got = fit.fit(by_phase(detrended, m), by_phase(weights, m))
                for i, k in enumerate(phases[m]):
                    cycle[k::period][: m + 2] = got[:, i * size : (i + 1) * size]
            seas = cycle[period:-period] - low.times(cycle, 1)[0]
            trend_c = trend_fit.fit(y - seas, weights)
        if r < rounds:
            resid = np.abs(y - seas - trend_c)
            h = 6 * np.median(np.ascontiguousarray(resid.T), axis=1)
            u = np.where(h > 0, resid / np.where(h > 0, h, 1.0), 0.0)
            weights = np.where(u <= 0.001, 1.0, np.where(u <= 0.999, (1 - u**2) ** 2, 0.0))
    return seas, trend_c, y - seas - trend_c


def decompose(panel: DataFrame, period: int = 7, trend: int = 29) -> DataFrame:
    """Robust decomposition of every series, some fifty of one length at a time; millions of series.

    Interior missing days are interpolated first; series without two full periods
    keep a null remainder.
    """
    filled = interpolate(panel, "n", "filled").where("filled is not null").select(F.unix_date("date").alias("day"), "grp", "n", "filled")

    def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ends in whole_series(batches, BATCH_VALUES):
            y = rows["filled"].to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], ends[:-1]])
            found = np.full((3, len(y)), np.nan)
            for m in np.unique(ends - starts):
                if m >= 2 * period:
                    at = starts[ends - starts == m] + np.arange(m)[:, None]
                    found[:, at] = stl(y[at], period, 7, trend)
            parts = [pa.array(x, pa.float64(), from_pandas=True) for x in found]  # NaN becomes null
            yield pa.RecordBatch.from_arrays([rows["day"], rows["grp"], rows["n"], *parts], names=["day", "grp", "n", "seasonal", "trend", "resid"])

    kind = panel.schema["grp"].dataType.simpleString()
    out = spread(filled).sortWithinPartitions("grp", "day").mapInArrow(parts_of, f"day int, grp {kind}, n bigint, seasonal double, trend double, resid double")
    return out.select(F.date_from_unix_date("day").alias("date"), "grp", "n", "seasonal", "trend", "resid")


def strengths(parts: DataFrame) -> DataFrame:
    """Trend and weekly strength: 1 - var(remainder) / var(component + remainder), at least 0."""
    def strength(c: str):
        share = F.var_pop("resid") / F.nullif(F.var_pop(F.col(c) + F.col("resid")), F.lit(0.0))
        return F.greatest(F.lit(0.0), 1 - share)

    return parts.groupBy("grp").agg(strength("trend").alias("trend_strength"), strength("seasonal").alias("weekly_strength"))


# --- median polish ----------------------------------------------------------------------

def monthly_log_table(panel: DataFrame) -> DataFrame:
    """``month, grp, x``: log of the mean daily count; empty cells are left out."""
    cells = panel.where("n is not null").groupBy(F.trunc("date", "month").alias("month"), "grp").agg(F.avg("n").alias("m"))
    return cells.where("m > 0").select("month", "grp", F.log("m").alias("x"))


def median_polish(table: DataFrame, max_iter: int = 20, tol: float = 1e-9, many_groups: bool = False) -> DataFrame:
    """``month, grp, x, overall, month_effect, group_effect, resid`` by alternating medians.

    Every round is written to the shared checkpoint folder, which cuts the lineage and
    survives lost executors. Group medians are calendar bounded. ``many_groups`` takes
    the medians over groups through the bracketed exact quantile instead of one buffer.
    """
    def sweep(df: DataFrame, key: str, effect: str) -> DataFrame:
        """Move the medians of ``resid`` by ``key`` into ``effect``; re-centre the other effect."""
        other = "group_effect" if effect == "month_effect" else "month_effect"
        okey = "grp" if effect == "month_effect" else "month"
        if many_groups and key == "month":
            med = exact_quantiles(df, [key], "resid", {"__m": 0.5})
        else:
            med = df.groupBy(key).agg(F.median("resid").alias("__m"))
        others = df.groupBy(okey).agg(F.first(other).alias("__o"))
        shift = others.select(F.median("__o")).scalar() if not many_groups or okey == "month" else exact_quantiles(others, [], "__o", {"__s": 0.5}).select("__s").scalar()
        return df.join(med, key).withColumns(
            {
                "resid": F.col("resid") - F.col("__m"), effect: F.col(effect) + F.col("__m"),
                "moved": F.abs("__m") if effect == "month_effect" else F.greatest("moved", F.abs("__m")),
                "overall": F.col("overall") + shift, other: F.col(other) - shift,
            }
        ).drop("__m")

    zero = F.lit(0.0)
    state = table.select("month", "grp", "x", zero.alias("overall"), zero.alias("month_effect"), zero.alias("group_effect"),
                         F.col("x").alias("resid"), zero.alias("moved"))
    for _ in range(max_iter):
        state = stage(sweep(sweep(state, "month", "month_effect"), "grp", "group_effect"), "polish")
        if (state.select(F.max("moved")).first()[0] or 0.0) < tol:
            return state.drop("moved")
    raise RuntimeError(f"medians still move after {max_iter} rounds")


def polish_summary(polished: DataFrame, late_from: str) -> DataFrame:
    """Effects in percent, shared share of variation and the mean late residual per group."""
    months = polished.groupBy("month").agg(F.first("month_effect").alias("e"))
    var_m = months.select(F.var_pop("e")).scalar()
    var_r = polished.select(F.var_pop("resid")).scalar()
    late = F.when(F.col("month") >= F.lit(late_from).cast("date"), F.col("resid"))
    return polished.groupBy("grp").agg(
        F.exp(F.first("overall")).alias("overall_per_day"), (100 * (F.exp(F.first("group_effect")) - 1)).alias("group_effect_pct"),
        (100 * (F.exp(F.avg(late)) - 1)).alias("late_residual_pct"),
    ).withColumn("shared_share", var_m / F.nullif(var_m + var_r, F.lit(0.0)))


