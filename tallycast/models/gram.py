"""Distributed least squares from sufficient statistics.

A Gram matrix is additive: tasks reduce their Arrow batches to one small matrix per key,
Spark sums them, and only the sums (a few hundred numbers per key) are solved.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gram_by(rows: DataFrame, key: str, columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """``key, pos, s``: sums of weighted products of all column pairs, row-major."""
    cols = list(columns)

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            x = pdf[cols].to_numpy(float)
            w = np.ones(len(x)) if weight is None else pdf[weight].to_numpy(float)
            for k, idx in pdf.groupby(key).indices.items():
                g = x[idx].T @ (x[idx] * w[idx][:, None])
                yield pd.DataFrame({key: k, "pos": np.arange(g.size), "s": g.ravel()})

    kind = rows.schema[key].dataType.simpleString()
    used = [key, *cols, *([weight] if weight else [])]
    return rows.select(*used).mapInPandas(batches, f"{key} {kind}, pos int, s double").groupBy(key, "pos").agg(F.sum("s").alias("s"))


def prefix_gram(grams: DataFrame, buckets: DataFrame, key: str, size: int) -> DataFrame:
    """Expanding Gram matrices: prefix sums over ordered buckets (one row per bucket and cell)."""
    grid = buckets.select(key).withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(size * size - 1))))
    w = Window.partitionBy("pos").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(grams, [key, "pos"], "left").select(key, "pos", F.coalesce(F.sum("s").over(w), F.lit(0.0)).alias("s"))


def solve(gram: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Minimum-norm solution of the normal equations (collinear dummies are fine)."""
    return np.linalg.lstsq(gram, target, rcond=1e-10)[0]


def collect_gram(rows: DataFrame, columns: Sequence[str], weight: str | None = None) -> np.ndarray:
    """One Gram matrix of the whole table; its size depends on the columns only."""
    d = len(columns)
    out = np.zeros(d * d)
    for r in gram_by(rows.withColumn("__all", F.lit(0)), "__all", columns, weight).collect():
        out[r["pos"]] = r["s"]
    return out.reshape(d, d)
