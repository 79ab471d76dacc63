"""Series diagnostics: autocorrelation, unit-root and stationarity statistics, filling.

A series is bounded by the calendar (one row per day), so one task per series is the
natural unit; the number of series is what grows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tallycast.functions.stats import safe_ratio

def series() -> WindowSpec:
    """Rows of one group in date order: the window every level feature shares."""
    return Window.partitionBy("grp").orderBy("date")


def spread(df: DataFrame) -> DataFrame:
    """Spread series over all shuffle partitions before per-series Python work.

    The rows are few but each series costs real CPU, so size-based coalescing of the
    exchange would put all of them into one task.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, "grp")


def whole_series(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of a partition sorted by ``grp``, cut between series into batches of ``size`` rows or a little more, and the ends of the series in each."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def joined() -> tuple[pa.RecordBatch, np.ndarray]:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        a, b = whole["grp"].slice(0, rows - 1), whole["grp"].slice(1)
        new = pc.coalesce(pc.not_equal(a, b), pc.not_equal(pc.is_null(a), pc.is_null(b)))  # null is a group as any other
        return whole, np.append(np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1, rows)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= size:
            whole, ends = joined()
            if len(ends) > 1:  # the last series may go on in the next batch
                yield whole.slice(0, ends[-2]), ends[:-1]
                whole = whole.slice(ends[-2])
            held, rows = [whole], whole.num_rows
    if held:
        yield joined()


def acf(panel: DataFrame, lags: int) -> DataFrame:
    """``grp, lag, acf``: known days renumbered, mean and denominator of the whole series."""
    known = panel.where("n is not null").select("grp", "date", F.col("n").cast("double").alias("n"))
    dev = known.withColumn("d", F.col("n") - F.avg("n").over(Window.partitionBy("grp")))
    prods = dev.select("grp", *((F.col("d") * F.lag("d", k).over(series())).alias(f"p{k}") for k in range(lags + 1)))
    sums = prods.groupBy("grp").agg(*(F.coalesce(F.sum(f"p{k}"), F.lit(0.0)).alias(f"s{k}") for k in range(lags + 1)))
    pairs = F.array(*(F.struct(F.lit(k).cast("bigint").alias("lag"), safe_ratio(F.col(f"s{k}"), F.col("s0")).alias("acf")) for k in range(lags + 1)))
    return sums.select("grp", F.explode(pairs).alias("x")).select("grp", "x.lag", "x.acf")


def levinson(r: np.ndarray) -> np.ndarray:
    """Partial autocorrelations from autocorrelations (Durbin-Levinson)."""
    out, phi, v = [1.0], np.zeros(0), 1.0
    for k in range(1, len(r)):
        a = (r[k] - phi @ r[k - 1:0:-1]) / v if k > 1 else r[1]
        phi = np.append(phi - a * phi[::-1], a)
        v *= 1 - a * a
        out.append(a)
    return np.array(out)


def pacf(panel: DataFrame, lags: int) -> DataFrame:
    """Yule-Walker partial autocorrelation from the short ACF vector of each series."""
    def per_series(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lag")
        return pdf.assign(pacf=levinson(pdf["acf"].to_numpy()))[["grp", "lag", "pacf"]]

    table = acf(panel, lags)
    return table.groupBy("grp").applyInPandas(per_series, f"grp {table.schema['grp'].dataType.simpleString()}, lag bigint, pacf double")


def dispersion(panel: DataFrame) -> DataFrame:
    return panel.where("n is not null").groupBy("grp").agg(
        F.avg("n").alias("mean"), safe_ratio(F.var_samp("n"), F.avg("n")).alias("var_over_mean"))


# MacKinnon (1994) response surface of the constant-only test.
ADF_SWITCH, ADF_LOW, ADF_HIGH = -1.61, -18.83, 2.74
ADF_SMALL = (2.1659, 1.4412, 0.038269)
ADF_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
# KPSS critical values of the level test.
KPSS_CRIT, KPSS_P = (0.347, 0.463, 0.574, 0.739), (0.10, 0.05, 0.025, 0.01)


def adf_p(t: float) -> float:
    if t > ADF_HIGH or t < ADF_LOW:
        return 1.0 if t > ADF_HIGH else 0.0
    coef = ADF_SMALL if t <= ADF_SWITCH else ADF_LARGE
    return 0.5 * (1 + math.erf(sum(c * t**i for i, c in enumerate(coef)) / math.sqrt(2)))


def _lag_regression(y: np.ndarray, p: int, drop: int) -> tuple[float, float]:
    """t statistic of the level and AIC with ``p`` lagged differences, first ``drop`` rows unused."""
    d = np.diff(y)
    rows = np.arange(drop, len(d))
    x = np.column_stack([y[rows], *(d[rows - k] for k in range(1, p + 1)), np.ones(len(rows))])
    g = np.linalg.pinv(x.T @ x)
    b = g @ (x.T @ d[rows])
    rss, m = float(((d[rows] - x @ b) ** 2).sum()), len(rows)
    llf = -m / 2 * (math.log(2 * math.pi) + math.log(rss / m) + 1)
    return float(b[0] / math.sqrt(g[0, 0] * rss / (m - x.shape[1]))), 2 * x.shape[1] - 2 * llf


def adf(panel: DataFrame) -> DataFrame:
    """Augmented Dickey-Fuller test with a constant, lag order by AIC on a common sample."""
    def per_series(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("date")["n"].to_numpy(float)
        top = min(math.ceil(12 * (len(y) / 100) ** 0.25), len(y) // 2 - 2)
        if top < 0 or np.ptp(y) == 0:
            return pd.DataFrame({"grp": [pdf["grp"].iloc[0]], "used_lag": [None], "statistic": [None], "p_value": [None]})
        best = min(range(top + 1), key=lambda p: _lag_regression(y, p, top)[1])
        t = _lag_regression(y, best, best)[0]
        return pd.DataFrame({"grp": [pdf["grp"].iloc[0]], "used_lag": [best], "statistic": [t], "p_value": [adf_p(t)]})

    known = panel.where("n is not null").select("grp", "date", F.col("n").cast("double").alias("n"))
    return spread(known).groupBy("grp").applyInPandas(per_series, f"grp {panel.schema['grp'].dataType.simpleString()}, used_lag bigint, statistic double, p_value double")


def kpss(panel: DataFrame) -> DataFrame:
    """KPSS level test with the data-driven lag rule; p is clipped to the table's range."""
    def per_series(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("date")["n"].to_numpy(float)
        e, m = y - y.mean(), len(y)

        def cross(k: int) -> float:
            return float(e[k:] @ e[: m - k])

        span = range(1, int(m ** (2 / 9)) + 1)
        s0 = cross(0) / m + sum(2 * cross(k) / m for k in span)
        s1 = sum(2 * k * cross(k) / m for k in span)
        lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * m ** (1 / 3)), m - 1) if s0 else 0
        var = (cross(0) + 2 * sum((1 - k / (lags + 1)) * cross(k) for k in range(1, lags + 1))) / m
        stat = float((np.cumsum(e) ** 2).sum() / m**2 / var) if var else None
        p = None if stat is None else float(np.interp(stat, KPSS_CRIT, KPSS_P))
        return pd.DataFrame({"grp": [pdf["grp"].iloc[0]], "lags": [lags], "statistic": [stat], "p_value": [p]})

    known = panel.where("n is not null").select("grp", "date", F.col("n").cast("double").alias("n"))
    return spread(known).groupBy("grp").applyInPandas(per_series, f"grp {panel.schema['grp'].dataType.simpleString()}, lags bigint, statistic double, p_value double")


# --- filling and trimming -------------------------------------------------------------

def forward_fill(column: str) -> Column:
    return F.last(column, ignorenulls=True).over(series().rowsBetween(Window.unboundedPreceding, 0))


def interpolate(panel: DataFrame, column: str, out: str, edges: bool = False) -> DataFrame:
    """Linear interpolation of interior gaps; ``edges`` extends the nearest known value outward."""
    before = series().rowsBetween(Window.unboundedPreceding, 0)
    # Looking ahead is a running frame in reverse order: linear, unlike a frame that
    # starts at the current row and is re-read for every row.
    after = Window.partitionBy("grp").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col(column).isNotNull(), F.struct(F.col("date").alias("d"), F.col(column).cast("double").alias("v")))
    withk = panel.withColumn("__k", known)
    marked = withk.withColumn("__p", F.last("__k", ignorenulls=True).over(before)).withColumn("__q", F.last("__k", ignorenulls=True).over(after))
    p, q = F.col("__p"), F.col("__q")
    span = F.datediff(q["d"], p["d"])
    inner = p["v"] + (q["v"] - p["v"]) * F.datediff("date", p["d"]) / F.nullif(span, F.lit(0))
    value = F.coalesce(F.col(column).cast("double"), F.when(p.isNotNull() & q.isNotNull(), inner))
    if edges:
        value = F.coalesce(value, p["v"], q["v"])
    return marked.withColumn(out, value).drop("__k", "__p", "__q")


def log_series(panel: DataFrame) -> DataFrame:
    """``ln n`` between the first and last known positive day; zero counts are missing."""
    whole = Window.partitionBy("grp")
    y = F.when(F.col("n") > 0, F.log(F.col("n")))
    lab = panel.select("date", "grp", y.alias("y"))
    day = F.when(F.col("y").isNotNull(), F.col("date"))
    edges = lab.withColumns({"__a": F.min(day).over(whole), "__z": F.max(day).over(whole)})
    return edges.where(F.col("date").between(F.col("__a"), F.col("__z"))).drop("__a", "__z")
