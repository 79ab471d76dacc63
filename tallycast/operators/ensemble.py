"""Combining member forecasts: checks, mean / median / weighted, learned weights."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallycast.functions.stats import strict_mean, strict_sum

KEYS = ("issue_date", "grp")
META = ("spec", "issue_date", "cutoff", "target_start", "target_end", "grp", "y_true")


def wide_predictions(results: DataFrame, members: Sequence[str]) -> DataFrame:
    """One row per forecast, one column per member (pivot over a fixed list: no extra pass)."""
    meta = [c for c in (*META, "anomaly") if c in results.columns]
    return results.where(F.col("model").isin(list(members))).groupBy(*meta).pivot("model", list(members)).agg(F.max("y_pred"))


def alignment_audit(results: DataFrame, members: Sequence[str]) -> DataFrame:
    """Do the members cover the same keys once each, with one truth and no null forecast?"""
    per_key = results.where(F.col("model").isin(list(members))).groupBy("spec", *KEYS).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("model").alias("models"),
        (F.min("y_true").eqNullSafe(F.max("y_true")) & F.count("y_true").isin(0, F.count(F.lit(1)))).alias("one_truth"),
        F.count_if(F.col("y_true").isNotNull() & F.col("y_pred").isNull()).alias("nulls"),
    )
    return per_key.agg(
        F.count(F.lit(1)).alias("keys"), F.count_distinct("spec").alias("specs"),
        F.count_if(F.col("models") != len(members)).alias("incomplete_keys"),
        F.count_if(F.col("rows") != F.col("models")).alias("repeated_keys"),
        F.count_if(~F.col("one_truth")).alias("conflicting_truth"), F.sum("nulls").alias("null_forecasts"),
    )


def require_alignment(results: DataFrame, members: Sequence[str]) -> DataFrame:
    row = alignment_audit(results, members).first().asDict()
    bad = {k: v for k, v in row.items() if k not in ("keys", "specs") and v} | ({"specs": row["specs"]} if row["specs"] != 1 else {})
    if bad:
        raise ValueError(f"members do not align: {bad}")
    return results


def combine_mean(members: Sequence[str]) -> Column:
    """Null when any member is null."""
    return strict_mean([F.col(m) for m in members])


def combine_median(members: Sequence[str]) -> Column:
    cols = [F.col(m) for m in members]
    arr, k = F.array_sort(F.array(*cols)), len(members)
    mid = arr[k // 2] if k % 2 else (arr[k // 2 - 1] + arr[k // 2]) / 2
    return F.when(strict_sum(cols).isNotNull(), mid)


def combine_weighted(members: Sequence[str], weights: Mapping[str, Column]) -> Column:
    """Dot product; a null member makes it null even at weight 0."""
    return strict_sum([F.col(m) * weights[m] for m in members])


def scaled_weights(members: Sequence[str], weights: Mapping[str, float]) -> dict[str, float]:
    """Weights checked by name and rescaled to sum to 1."""
    if set(members) != set(weights):
        raise ValueError(f"weights {sorted(weights)} do not match members {sorted(members)}")
    values = [float(weights[m]) for m in members]
    if not all(np.isfinite(values)) or min(values) < 0 or sum(values) == 0:
        raise ValueError(f"weights must be finite, non-negative and not all zero: {dict(weights)}")
    return {m: v / sum(values) for m, v in zip(members, values, strict=True)}


def weight_table(weights: DataFrame, members: Sequence[str]) -> DataFrame:
    """Distributed weight check: align ``set, member, weight`` rows by name and rescale per set."""
    whole = Window.partitionBy("set")
    known = weights.withColumn("known", F.col("member").isin(list(members)))
    ok = (
        (F.count_if(~F.col("known")).over(whole) == 0) & (F.size(F.collect_set("member").over(whole)) == len(members))
        & (F.min("weight").over(whole) >= 0) & (F.sum("weight").over(whole) > 0)
    )
    return known.select("set", "member", "weight", ok.alias("valid"),
                        F.when(ok, F.col("weight") / F.nullif(F.sum("weight").over(whole), F.lit(0.0))).alias("scaled"))


def simplex_lattice(size: int, steps: int) -> np.ndarray:
    """All weight vectors with entries k/steps summing to 1, in lexicographic order."""
    cells = [np.diff((-1, *bars, steps + size - 1)) - 1 for bars in combinations(range(steps + size - 1), size - 1)]
    return np.array(cells, dtype=float) / steps


def refine_around(best: np.ndarray, steps: int) -> np.ndarray:
    """Neighbour vectors of ``best``: shift 1..5 fine steps of weight between two members."""
    out = [best]
    for i in range(len(best)):
        for j in range(len(best)):
            for k in range(1, 6):
                v = best.copy()
                v[i] += k / steps
                v[j] -= k / steps
                if i != j and v[j] >= -1e-12:
                    out.append(np.clip(v, 0, 1))
    return np.array(out)


def refit_months(wide: DataFrame, lag_days: int, start: str, end: str) -> DataFrame:
    """Months holding a scored row: first issue date and its cutoff (one row per month)."""
    inside = (F.col("target_start") >= F.lit(start).cast("date")) & (F.col("target_end") <= F.lit(end).cast("date"))
    return wide.groupBy(F.trunc("issue_date", "month").alias("month")).agg(
        F.min("issue_date").alias("issue_date"), F.count_if(inside).alias("scored")
    ).where("scored > 0").select("month", "issue_date", F.date_sub("issue_date", lag_days).alias("cutoff"))


def _loss_sums(rows: DataFrame, members: Sequence[str], vectors: np.ndarray, key: str) -> DataFrame:
    """Sum of |error| per (bucket, weight vector), reduced inside each Arrow batch."""
    names = list(members)

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if pdf.empty:
                continue
            loss = np.abs(pdf[names].to_numpy(float) @ vectors.T - pdf[["y_true"]].to_numpy(float))
            for b, idx in pdf.groupby(key).indices.items():
                yield pd.DataFrame({key: b, "vec": np.arange(len(vectors)), "loss": loss[idx].sum(axis=0), "rows": len(idx)})

    part = rows.select(key, "y_true", *names).mapInPandas(batches, f"{key} int, vec int, loss double, rows bigint")
    return part.groupBy(key, "vec").agg(F.sum("loss").alias("loss"), F.sum("rows").alias("rows"))


def complete_rows(wide: DataFrame, members: Sequence[str]) -> DataFrame:
    """Rows weights can be learned from: known truth and every member's forecast.

    Null forecasts on known truth are reported by :func:`alignment_audit`.
    """
    return wide.dropna(subset=["y_true", *members])


def rolling_weights(wide: DataFrame, members: Sequence[str], lag_days: int, start: str, end: str, steps: int = 10) -> DataFrame:
    """MAE-optimal lattice weights per month, on all outcomes known by its first issue date.

    A row is bucketed by the first refit whose cutoff reaches its target end; losses are
    summed per (bucket, vector) and prefix-summed over months, so expanding windows cost
    one pass over the rows instead of one per month.
    """
    vectors = simplex_lattice(len(members), steps)
    months = refit_months(wide, lag_days, start, end)
    order = Window.orderBy("cutoff")  # one row per month
    index = months.withColumn("bucket", (F.row_number().over(order) - 1).cast("int"))
    first = wide.select(F.min("target_end")).scalar()
    since = F.coalesce(F.date_add(F.lag("cutoff").over(order), 1), F.least(first, F.col("cutoff")))
    days = index.select("bucket", since.alias("__a"), F.col("cutoff").alias("__z")).select(
        "bucket", F.explode(F.sequence("__a", "__z")).alias("target_end"))
    # Day -> bucket: one row per calendar day, broadcast. Later outcomes train nothing.
    known = complete_rows(wide, members).join(F.broadcast(days), "target_end")
    sums = _loss_sums(known, members, vectors, "bucket")
    grid = index.select("bucket").withColumn("vec", F.explode(F.sequence(F.lit(0), F.lit(len(vectors) - 1))))
    w = Window.partitionBy("vec").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    prefix = grid.join(sums, ["bucket", "vec"], "left").select(
        "bucket", "vec", F.sum("loss").over(w).alias("loss"), F.sum("rows").over(w).alias("n_rows"))
    best = prefix.where("n_rows > 0").groupBy("bucket").agg(
        F.min_by("vec", F.struct(F.round("loss", 6), "vec")).alias("vec"), F.min("loss").alias("loss"), F.max("n_rows").alias("n_rows"))
    table = wide.sparkSession.createDataFrame(
        pd.DataFrame({"vec": np.arange(len(vectors), dtype="int32")} | {m: vectors[:, i] for i, m in enumerate(members)}))
    out = index.join(best, "bucket").join(F.broadcast(table), "vec")
    return out.select("month", "issue_date", "cutoff", "n_rows", (F.col("loss") / F.col("n_rows")).alias("train_mae"),
                      *(F.col(m).alias(f"w_{m}") for m in members))


def refine_weights(wide: DataFrame, members: Sequence[str], weights: DataFrame, fine_steps: int = 100) -> DataFrame:
    """One finer lattice around each month's best vector, all months in one pass over the rows.

    Only the coarse fits (one row per month) reach the driver; they travel to the tasks as
    candidate vectors, and each Arrow batch reduces to one row per (month, vector).
    """
    names = list(members)
    fits = weights.select("month", F.unix_date("cutoff").alias("cut"), *(f"w_{m}" for m in names)).orderBy("month").collect()
    lattices = [refine_around(np.array([r[f"w_{m}"] for m in names]), fine_steps) for r in fits]
    cuts = [r["cut"] for r in fits]

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            p, y, end = pdf[names].to_numpy(float), pdf[["y_true"]].to_numpy(float), pdf["end"].to_numpy()
            for i, (vectors, cut) in enumerate(zip(lattices, cuts, strict=True)):
                use = end <= cut
                if use.any():
                    loss = np.abs(p[use] @ vectors.T - y[use]).sum(axis=0)
                    yield pd.DataFrame({"fit": i, "vec": np.arange(len(vectors)), "loss": loss, "rows": int(use.sum())})

    known = complete_rows(wide, members).select("y_true", F.unix_date("target_end").alias("end"), *names)
    sums = known.mapInPandas(batches, "fit int, vec int, loss double, rows bigint").groupBy("fit", "vec").agg(
        F.sum("loss").alias("loss"), F.sum("rows").alias("rows"))
    best = sums.groupBy("fit").agg(F.min_by("vec", F.struct(F.round("loss", 6), "vec")).alias("vec"),
                                   (F.min("loss") / F.max("rows")).alias("train_mae"))
    table = [(i, v, fits[i]["month"], *map(float, row)) for i, lat in enumerate(lattices) for v, row in enumerate(lat)]
    schema = "fit int, vec int, month date, " + ", ".join(f"w_{m} double" for m in names)
    lookup = wide.sparkSession.createDataFrame(table, schema)  # months x neighbours
    return best.join(F.broadcast(lookup), ["fit", "vec"]).select("month", "train_mae", *(f"w_{m}" for m in names))


def combine_rows(wide: DataFrame, members: Sequence[str], start: str, end: str, weights: DataFrame | None = None) -> DataFrame:
    """Prediction rows of every combiner on the windows inside the scored period."""
    scored = wide.where((F.col("target_start") >= F.lit(start).cast("date")) & (F.col("target_end") <= F.lit(end).cast("date")))
    cols = {"ens_mean": combine_mean(members), "ens_median": combine_median(members)}
    if weights is not None:
        scored = scored.withColumn("month", F.trunc("issue_date", "month")).join(
            F.broadcast(weights.select("month", *(f"w_{m}" for m in members))), "month", "left")  # one row per month
        cols["ens_weighted"] = combine_weighted(members, {m: F.col(f"w_{m}") for m in members})
    meta = [c for c in (*META, "anomaly") if c in wide.columns]
    return scored.select(*meta, *(c.alias(k) for k, c in cols.items())).unpivot(meta, list(cols), "model", "y_pred")


def weight_summary(weights: DataFrame, members: Sequence[str]) -> DataFrame:
    """Mean, min and max weight per member over the refits."""
    names = [f"w_{m}" for m in members]
    long = weights.select("month", *names).unpivot("month", names, "member", "weight")
    return long.groupBy(F.expr("substring(member, 3)").alias("member")).agg(
        F.avg("weight").alias("mean"), F.min("weight").alias("min"), F.max("weight").alias("max"))


# Labels of the two parts of a split test period.
BEFORE, AFTER = "before_break", "after_break"


def with_period(results: DataFrame, break_date: str) -> DataFrame:
    return results.withColumns(
        {
            "period": F.when(F.col("target_start") < F.lit(break_date).cast("date"), BEFORE).otherwise(AFTER),
            "year_month": F.date_format("target_start", "yyyy-MM"),
        }
    )
