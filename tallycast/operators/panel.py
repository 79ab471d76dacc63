"""Gap-aware daily panels: a missing day is a row with a null count, never a zero."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallycast.sources.sinks import stage

#: Rows of the dense panel that a task of the exchange by group makes, about. The exchange itself holds days with a record only,
#: so its bytes say little about the rows that later sorts of the same task hold.
TASK_ROWS = 1 << 18


def records(df: DataFrame, day: Column, group: Column, subset: Column | None = None) -> DataFrame:
    """Project raw events to ``date, grp, sub``; only these columns reach the scan."""
    sub = F.lit(False) if subset is None else F.coalesce(subset, F.lit(False))
    return df.select(day.cast("date").alias("date"), group.alias("grp"), sub.alias("sub"))


def observed_dates(recs: DataFrame) -> DataFrame:
    """Dates with a record of any group, including groups that are filtered later."""
    return recs.where(F.col("date").isNotNull()).select("date").distinct()


def daily_panel(recs: DataFrame, keep: Sequence | None = None) -> DataFrame:
    """Dense ``date, grp, n, n_sub`` on the full calendar of ``recs``.

    ``n`` is 0 where the group has no record on an observed date and null where the date
    has no record at all. ``keep`` lists the groups to return, in full, even when they
    have no record; ``None`` keeps every non-null group found.

    Shape: one map-side-combined count (a hot group or day costs one partial row per
    task), one exchange by group, then each row is stretched to the next known day.
    No calendar x group product is built and the exchange is reused by any later window
    over ``grp`` / ``date``. It has as many tasks as the dense panel needs, so a task's
    memory does not grow with the number of groups.
    """
    every = recs.where(F.col("date").isNotNull()).groupBy("date", "grp").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("sub")).alias("n_sub")
    )
    every = stage(every, "counts")  # the only scan of the events; a row per day and group is read from here on
    observed = observed_dates(every)
    found = every.agg(F.min("date").alias("lo"), F.max("date").alias("hi"), F.approx_count_distinct("grp").alias("groups")).first()
    lo, hi = F.lit(found.lo).cast("date"), F.lit(found.hi).cast("date")
    days = (found.hi - found.lo).days + 1 if found.lo is not None else 0
    counts = every.where(F.col("grp").isNotNull())
    if keep is not None:
        counts = counts.where(F.col("grp").isin(list(keep)))
    if keep is not None:
        # A sentinel the day before the calendar keeps groups without any record.
        kind = recs.schema["grp"].dataType.simpleString()
        before = recs.sparkSession.createDataFrame([(k,) for k in keep], f"grp {kind}").select(
            F.date_sub(lo, 1).alias("date"), "grp", F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("n_sub")
        )
        counts = counts.unionByName(before)
    groups = found.groups if keep is None else len(keep)
    counts = counts.repartition(max(1, math.ceil(groups * days / TASK_ROWS)), "grp")
    w = Window.partitionBy("grp").orderBy("date")
    first = F.lag("date").over(w).isNull()
    stretched = counts.select(
        "grp",
        "n",
        "n_sub",
        F.col("date").alias("__at"),
        F.when(first, F.least(lo, F.col("date"))).otherwise(F.col("date")).alias("__from"),
        F.coalesce(F.date_sub(F.lead("date").over(w), 1), hi).alias("__to"),
    ).select("*", F.explode(F.sequence("__from", "__to")).alias("date"))
    here = F.col("date") == F.col("__at")
    dense = stretched.where(F.col("date") >= lo).select(
        "date", "grp",
        F.when(here, F.col("n")).otherwise(F.lit(0)).alias("n"),
        F.when(here, F.col("n_sub")).otherwise(F.lit(0)).alias("n_sub"),
    )
    # One row per day of the DATE range: bounded however large the input is.
    known = F.broadcast(observed.withColumn("__obs", F.lit(True)))
    return dense.join(known, "date", "left").select(
        "date", "grp",
        F.when(F.col("__obs"), F.col("n")).alias("n"),
        F.when(F.col("__obs"), F.col("n_sub")).alias("n_sub"),
    )


def single_series(recs: DataFrame) -> DataFrame:
    """One series over all records: ``date, n``."""
    whole = recs.withColumn("grp", F.lit(0).cast("bigint"))
    return daily_panel(whole).select("date", "n")


def require_rows(df: DataFrame) -> DataFrame:
    """Raise when there is nothing to build a calendar from."""
    if df.isEmpty():
        raise ValueError("no records: a calendar needs at least one dated row")
    return df


def group_count(panel: DataFrame, groups: int | None) -> Column:
    """Number of groups: given by the caller, or counted in one more pass over the panel."""
    return F.lit(groups) if groups is not None else panel.select(F.count_distinct("grp")).scalar()


def total_series(panel: DataFrame, label: int = 0, n_groups: int | None = None) -> DataFrame:
    """Sum of all groups per day; null on days where any group is null or absent."""
    groups = group_count(panel, n_groups)
    known = F.count("n") == groups
    return panel.groupBy("date").agg(
        F.lit(label).cast("bigint").alias("grp"),
        F.when(known, F.sum("n")).alias("n"),
        F.when(known, F.sum("n_sub")).alias("n_sub"),
    )


def contract_violations(panel: DataFrame) -> DataFrame:
    """Counts of contract breaches: duplicate keys, calendar gaps, broken subset counts."""
    per_key = panel.groupBy("grp", "date").agg(
        F.count(F.lit(1)).alias("c"),
        F.count_if(F.col("n").isNull() != F.col("n_sub").isNull()).alias("misaligned"),
        F.count_if(F.col("n_sub") > F.col("n")).alias("excess"),
    )
    per_group = per_key.groupBy("grp").agg(
        F.count_if(F.col("c") > 1).alias("dup"),
        (F.sum("c") != F.datediff(F.max("date"), F.min("date")) + 1).cast("bigint").alias("gap"),
        F.sum("misaligned").alias("misaligned"),
        F.sum("excess").alias("excess"),
    )
    return per_group.agg(
        F.sum("dup").alias("duplicate_keys"),
        F.sum("gap").alias("groups_with_gaps"),
        F.sum("misaligned").alias("misaligned_subset"),
        F.sum("excess").alias("subset_exceeds_total"),
    )


def check_panel(panel: DataFrame) -> DataFrame:
    """Raise on any breach of the panel contract, else return the panel."""
    types = dict(panel.dtypes)
    if types.get("date") != "date" or types.get("n") not in {"bigint", "int"}:
        raise ValueError(f"panel needs date DATE and an integer n, got {types}")
    bad = {k: v for k, v in contract_violations(panel).first().asDict().items() if v}
    if bad:
        raise ValueError(f"panel contract broken: {bad}")
    return panel


def coverage(panel: DataFrame) -> DataFrame:
    """Known and missing days per group."""
    return panel.groupBy("grp").agg(
        F.count(F.lit(1)).alias("days"),
        F.count("n").alias("observed_days"),
        F.count_if(F.col("n").isNull()).alias("missing_days"),
        F.sum("n").alias("total"),
    )


def group_shares(panel: DataFrame, days: int, need: int, n_groups: int | None = None) -> DataFrame:
    """Share of each group in the complete days of the ``days`` days ending at each cutoff.

    A day counts only when every group is known on it. Null when fewer than ``need``
    days are complete. The panel is read for the day totals and again for the groups: pass
    a staged one.
    """
    groups = group_count(panel, n_groups)
    complete = panel.groupBy("date").agg((F.count("n") == groups).alias("__ok"))
    marked = panel.join(F.broadcast(complete), "date").withColumn("__n", F.when(F.col("__ok"), F.col("n")))
    w = Window.partitionBy("grp").orderBy("date").rowsBetween(-(days - 1), 0)
    sums = marked.select(
        "date", "grp",
        F.sum("__n").over(w).alias("__s"),
        F.count("__n").over(w).alias("__k"),
    )
    totals = sums.groupBy("date").agg(F.sum("__s").alias("__t"))
    return sums.join(F.broadcast(totals), "date").select(
        F.col("date").alias("cutoff"), "grp",
        F.when(F.col("__k") >= need, F.col("__s").cast("double") / F.nullif(F.col("__t"), F.lit(0))).alias("share"),
    )
