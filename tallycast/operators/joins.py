"""Temporal joins: as-of, interval, nearest value, and validated key joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(
    probes: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    probe_time: str,
    fact_time: str,
    values: Sequence[str],
    bucket: Column | None = None,
    how: str = "last",
) -> DataFrame:
    """Attach to each probe the latest fact of its key with ``fact_time <= probe_time``.

    ``how="last"`` takes the fact with the latest time; ``how="max"`` the greatest
    ``values[0]`` among all earlier facts. Keys may be empty (one global timeline).

    Two levels keep a hot key (or a single timeline) from landing in one task: time is
    cut into buckets, each (key, bucket) is resolved on its own, and the state carried
    into a bucket comes from per-bucket summaries that are combined map-side. ``bucket``
    is a function of the column ``__t``; the default is the calendar quarter.
    """
    keys = list(keys)
    cell = bucket if bucket is not None else F.date_trunc("quarter", F.col("__t"))
    payload = F.struct(F.col(fact_time).alias("__ft"), *(F.col(v) for v in values))
    fact_cols = facts.where(F.col(fact_time).isNotNull()).select(
        *keys, F.col(fact_time).alias("__t"), F.lit(0).alias("__tag"), payload.alias("__fact")
    )
    id_cols = [c for c in probes.columns if c not in keys]
    probe_rows = probes.select(
        *keys, F.col(probe_time).alias("__t"), F.lit(1).alias("__tag"), F.struct(*id_cols).alias("__probe")
    )
    both = fact_cols.unionByName(probe_rows, allowMissingColumns=True).withColumn("__b", cell)

    rank = F.col("__fact.__ft") if how == "last" else F.col(f"__fact.{values[0]}")
    summary = both.groupBy(*keys, "__b").agg(F.max_by("__fact", rank).alias("__best"))
    over_buckets = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "__b").orderBy("__t", "__tag").rowsBetween(Window.unboundedPreceding, 0)
    if how == "last":
        carried = F.last("__best", ignorenulls=True).over(over_buckets)
        local = F.last("__fact", ignorenulls=True).over(inside)
    else:
        carried = F.max_by("__best", F.col(f"__best.{values[0]}")).over(over_buckets)
        local = F.max_by("__fact", F.col(f"__fact.{values[0]}")).over(inside)
    carry = summary.select(*(F.col(k).alias(f"__k_{k}") for k in keys), F.col("__b").alias("__kb"), carried.alias("__carry"))
    found = both.withColumn("__local", local).where(F.col("__tag") == 1)
    cond = F.col("__b").eqNullSafe(F.col("__kb"))
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    joined = found.join(carry, cond, "left").select(*keys, "__probe", "__local", "__carry")
    if how == "last":
        best = F.coalesce("__local", "__carry")
    else:
        a, b = F.col(f"__local.{values[0]}"), F.col(f"__carry.{values[0]}")
        best = F.when(a.isNull() | (b > a), F.col("__carry")).otherwise(F.col("__local"))
    return joined.withColumn("__best", best).select(
        *keys, "__probe.*", F.col("__best.__ft").alias("matched_" + fact_time), *(F.col(f"__best.{v}") for v in values)
    )


def flag_windows(results: DataFrame, flagged: DataFrame) -> DataFrame:
    """Add ``anomaly``: does any flagged day of the group fall into the target window?

    Windows have a length fixed by the setting, so they are exploded into an equi-join
    on (group, day) instead of a range join.
    """
    windows = results.select("grp", "target_start", "target_end").distinct()
    days = windows.withColumn("date", F.explode(F.sequence("target_start", "target_end")))
    hits = (
        days.join(flagged.where("anomaly").select("grp", "date").distinct(), ["grp", "date"], "left_semi")
        .select("grp", "target_start", "target_end").distinct().withColumn("anomaly", F.lit(True))
    )
    return results.join(hits, ["grp", "target_start", "target_end"], "left").withColumn(
        "anomaly", F.coalesce("anomaly", F.lit(False))
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def validated_join(left: DataFrame, right: DataFrame, keys: Sequence[str], relation: str, how: str = "inner") -> DataFrame:
    """Key join that raises when the declared relation does not hold."""
    sides = {"one_to_one": (left, right), "many_to_one": (right,), "one_to_many": (left,)}[relation]
    for side in sides:
        if not duplicate_keys(side, keys).isEmpty():
            raise ValueError(f"{relation} join: keys {list(keys)} repeat on a unique side")
    return left.join(right, list(keys), how)


def join_audit(left: DataFrame, right: DataFrame, keys: Sequence[str], left_value: str, right_value: str) -> DataFrame:
    """Relation and agreement of two keyed tables, without failing.

    Both sides are reduced to one row per key before they meet, so repeated or hot keys
    never multiply rows.
    """
    def side(df: DataFrame, value: str, tag: str) -> DataFrame:
        return df.groupBy(*keys).agg(
            F.count(F.lit(1)).alias(f"{tag}_n"), F.min(value).alias(f"{tag}_lo"), F.max(value).alias(f"{tag}_hi")
        )

    a, b = side(left, left_value, "l"), side(right, right_value, "r")
    both = a.join(b, list(keys), "full_outer")
    matched = F.col("l_n").isNotNull() & F.col("r_n").isNotNull()
    agree = (F.col("l_lo").eqNullSafe(F.col("r_lo"))) & (F.col("l_hi").eqNullSafe(F.col("r_hi")))
    return both.agg(
        F.count_if(matched).alias("matched_keys"),
        F.count_if(F.col("r_n").isNull()).alias("left_only"),
        F.count_if(F.col("l_n").isNull()).alias("right_only"),
        F.count_if(F.col("l_n") > 1).alias("left_repeated"),
        F.count_if(F.col("r_n") > 1).alias("right_repeated"),
        F.count_if(matched & ~agree).alias("disagreeing"),
    )


def nearest_value(probes: DataFrame, facts: DataFrame, probe_value: str, fact_value: str, carry: Sequence[str], width: float) -> DataFrame:
    """Match each probe to the fact whose value is closest; the smaller value wins ties.

    Two as-of joins on the value axis (below and, mirrored, above), each bucketed by
    ``width`` so that no task sees the whole axis.
    """
    cell = F.floor(F.col("__t") / F.lit(float(width)))
    cols = [fact_value, *carry]
    lo, hi = [f"__l_{c}" for c in cols], [f"__h_{c}" for c in cols]
    below = facts.select(*(F.col(c).alias(a) for c, a in zip(cols, lo, strict=True))).withColumn("__fv", F.col(lo[0]))
    above = facts.select(*(F.col(c).alias(a) for c, a in zip(cols, hi, strict=True))).withColumn("__fn", -F.col(hi[0]))
    one = asof_join(probes, below, [], probe_value, "__fv", lo, cell)
    two = asof_join(one.withColumn("__pn", -F.col(probe_value)), above, [], "__pn", "__fn", hi, cell)
    p = F.col(probe_value)
    take_high = F.col(lo[0]).isNull() | (F.col(hi[0]).isNotNull() & ((F.col(hi[0]) - p) < (p - F.col(lo[0]))))
    return two.select(
        *probes.columns,
        *(F.when(take_high, F.col(h)).otherwise(F.col(l)).alias(c) for c, l, h in zip(cols, lo, hi, strict=True)),
    )
