"""Small fixtures built in code."""

import datetime as dt

import numpy as np
import pandas as pd

PANEL = "date date, grp bigint, n bigint, n_sub bigint"


def day(text):
    return dt.date.fromisoformat(text)


def uniform_panel(spark, start="2023-01-01", end="2024-12-31", groups=(1, 2), missing=("2024-03-31",), seed=7, low=20, high=80):
    rng = np.random.default_rng(seed)
    rows = []
    gone = {day(m) for m in missing}
    for d in pd.date_range(start, end).date:
        for g in groups:
            n = int(rng.integers(low, high))
            rows.append((d, g, None, None) if d in gone else (d, g, n, int(rng.integers(0, n + 1))))
    return spark.createDataFrame(rows, PANEL)


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
