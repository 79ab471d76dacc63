"""Data-quality and exploratory profiles of event records and panels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallycast.functions.calendar import iso_weekday, month_start, week_start
from tallycast.functions.quantiles import exact_quantiles, nearest_rank
from tallycast.functions.stats import safe_ratio


def _one() -> Column:
    return F.count(F.lit(1))


def append_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


# --- keys and completeness ------------------------------------------------------------

def duplicate_profile(df: DataFrame, key_sets: Mapping[str, Sequence[str]]) -> DataFrame:
    """Surplus rows per key set (rows minus distinct keys)."""
    def surplus(label: str, keys: Sequence[str]) -> DataFrame:
        return df.groupBy(*keys).agg(_one().alias("c")).agg(
            F.lit(label).alias("key_set"), F.sum("c").alias("rows"), _one().alias("distinct_keys"),
            F.sum(F.col("c") - 1).alias("surplus_rows"), F.count_if(F.col("c") > 1).alias("repeated_keys"),
        )

    return append_all([surplus(k, v) for k, v in key_sets.items()])


def repeated_ids(df: DataFrame, key: str, k: int, example: Sequence[str]) -> DataFrame:
    """The k most repeated ids with their first row in ``example`` order (top-k report)."""
    return df.groupBy(key).agg(
        _one().alias("copies"), F.min(F.struct(*example)).alias("__e")
    ).where("copies > 1").orderBy(F.desc("copies"), key).limit(k).select(
        key, "copies", *(F.col(f"__e.{c}").alias(f"first_{c}") for c in example)
    )


def numbering_completeness(df: DataFrame, year: str, number: str, main_below: int, reported: DataFrame) -> DataFrame:
    """Published rows against the highest issued number and against reported totals."""
    main = F.col(number) < main_below
    table = df.groupBy(year).agg(
        _one().alias("published"),
        F.max(F.when(main, F.col(number))).alias("max_main"),
        F.count_if(~main).alias("high_range"),
    )
    # ``reported`` has one row per year.
    return table.join(F.broadcast(reported), year, "left").withColumns(
        {
            "share_of_max": safe_ratio(F.col("published") - F.col("high_range"), F.col("max_main")),
            "share_of_reported": safe_ratio(F.col("published"), F.col("reported")),
        }
    )


def missing_day_points(table: DataFrame, days: int = 365) -> DataFrame:
    """Points of the yearly share that one missing day is worth."""
    return table.withColumn("missing_day_points", 100 * safe_ratio(F.col("published") / days, F.col("reported")))


def nesting(df: DataFrame, child: str, parent: str) -> DataFrame:
    """Is ``child -> parent`` a function? Parents and modal share per child."""
    return df.groupBy(child, parent).agg(_one().alias("c")).groupBy(child).agg(
        _one().alias("parents"), F.sum("c").alias("rows"), F.max("c").alias("modal_rows")
    ).withColumn("modal_share", safe_ratio(F.col("modal_rows"), F.col("rows")))


def nesting_summary(per_child: DataFrame) -> DataFrame:
    return per_child.agg(
        _one().alias("children"), F.count_if(F.col("parents") > 1).alias("in_several_parents"),
        safe_ratio(F.sum("modal_rows"), F.sum("rows")).alias("rows_in_modal_parent"),
    )


def column_profile(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """Nulls, distinct values, range and an example per column.

    One aggregate per column instead of a single multi-distinct aggregate, which would
    expand every input row once per column. ``approx`` swaps in a mergeable sketch.
    """
    numeric = {"bigint", "int", "double", "float", "date", "timestamp", "timestamp_ntz"}
    types = dict(df.dtypes)

    def one(c: str) -> DataFrame:
        ranged = types[c] in numeric
        if approx:
            base = df.select(c).agg(_one().alias("rows"), F.count_if(F.col(c).isNull()).alias("nulls"),
                                    F.approx_count_distinct(c).alias("distinct"), F.min(c).alias("lo"), F.max(c).alias("hi"))
        else:
            base = df.groupBy(c).agg(_one().alias("k")).agg(
                F.sum("k").alias("rows"), F.coalesce(F.sum(F.when(F.col(c).isNull(), F.col("k"))), F.lit(0)).alias("nulls"),
                F.count(c).alias("distinct"), F.min(c).alias("lo"), F.max(c).alias("hi"))
        return base.select(
            F.lit(c).alias("variable"), "rows", "nulls", (100 * safe_ratio(F.col("nulls"), F.col("rows"))).alias("null_pct"), "distinct",
            (F.col("lo").cast("double") if types[c] in {"bigint", "int", "double", "float"} else F.lit(None).cast("double")).alias("min"),
            (F.col("hi").cast("double") if types[c] in {"bigint", "int", "double", "float"} else F.lit(None).cast("double")).alias("max"),
            (F.lit(None) if ranged else F.col("lo")).cast("string").alias("example"),
        )

    return append_all([one(c) for c in columns])


def load_by_category(df: DataFrame, category: str, load: str, q: float = 0.99) -> DataFrame:
    """Records, total, mean, nearest-rank quantile, max and both shares per category."""
    keyed = df.select(F.coalesce(F.col(category), F.lit("(blank)")).alias(category), load)
    table = keyed.groupBy(category).agg(
        _one().alias("records"), F.sum(load).alias("load"), F.avg(load).alias("mean_load"), F.max(load).alias("max_load")
    )
    quant = exact_quantiles(keyed, [category], load, {"q_load": q}, nearest=True)
    whole = Window.partitionBy(F.lit(1))
    return table.join(quant, category, "left").withColumns(
        {
            "pct_records": 100 * safe_ratio(F.col("records"), F.sum("records").over(whole)),
            "pct_load": 100 * safe_ratio(F.col("load"), F.sum("load").over(whole)),
        }
    )


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """Top-k values by count; ties by value."""
    return df.groupBy(column).agg(_one().alias("count")).orderBy(F.desc("count"), column).limit(k)


def vocabulary_churn(df: DataFrame, period: Column, word: str) -> DataFrame:
    """Distinct, new and dropped words per period against the period before.

    Each (period, word) votes as *current* in its own period and *previous* in the next,
    so one aggregation replaces a full outer self join.
    """
    seen = df.select(period.alias("period"), F.col(word).alias("word")).where(F.col(word).isNotNull()).distinct()
    last = seen.select(F.max("period")).scalar()
    first = seen.select(F.min("period")).scalar()
    votes = seen.select("word", F.explode(F.array(
        F.struct(F.col("period"), F.lit(1).alias("cur"), F.lit(0).alias("prev")),
        F.struct((F.col("period") + 1).alias("period"), F.lit(0).alias("cur"), F.lit(1).alias("prev")),
    )).alias("v"))
    pairs = votes.groupBy("v.period", "word").agg(F.max("v.cur").alias("cur"), F.max("v.prev").alias("prev"))
    return pairs.where((F.col("period") > first) & (F.col("period") <= last)).groupBy("period").agg(
        F.count_if(F.col("cur") == 1).alias("types"),
        F.count_if((F.col("cur") == 1) & (F.col("prev") == 0)).alias("new"),
        F.count_if((F.col("cur") == 0) & (F.col("prev") == 1)).alias("dropped"),
    )


def shared_points(df: DataFrame, x: str, y: str) -> DataFrame:
    """Bounding box, distinct points and share of rows on points used more than once."""
    return df.groupBy(x, y).agg(_one().alias("c")).agg(
        F.min(x).alias("x_min"), F.max(x).alias("x_max"), F.min(y).alias("y_min"), F.max(y).alias("y_max"),
        _one().alias("distinct_points"),
        safe_ratio(F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c"))), F.lit(0)), F.sum("c")).alias("rows_on_shared_points"),
    )


# --- time of day, calendar ------------------------------------------------------------

def spring_forward(day: Column) -> Column:
    """North American clock change: the second Sunday of March."""
    return (F.month(day) == 3) & (F.weekday(day) == 6) & F.dayofmonth(day).between(8, 14)


def hour_profile(df: DataFrame, ts: str) -> DataFrame:
    by_hour = df.groupBy(F.hour(ts).cast("bigint").alias("hour")).agg(_one().alias("rows"))
    return by_hour.withColumn("pct", 100 * safe_ratio(F.col("rows"), F.sum("rows").over(Window.partitionBy(F.lit(1)))))


def clock_checks(df: DataFrame, ts: str, gap_day: Column) -> DataFrame:
    """Rows in the skipped hour of clock-change days and rows exactly at midnight."""
    t = F.col(ts)
    return df.agg(
        F.count_if(gap_day & (F.hour(t) == 2)).alias("rows_in_gap_hour"),
        F.count_if(t == F.date_trunc("day", t)).alias("rows_at_midnight"),
        _one().alias("rows"),
    )


def grain_density(panel: DataFrame, label: str) -> DataFrame:
    """Cells, median, mean, share of zeros and of small counts, dispersion of one grain."""
    known = panel.where("n is not null")
    med = exact_quantiles(known, [], "n", {"median": 0.5})
    stats = known.agg(
        F.lit(label).alias("grain"), _one().alias("cells"), F.avg("n").alias("mean"),
        (100 * safe_ratio(F.count_if(F.col("n") == 0), _one())).alias("pct_zero"),
        (100 * safe_ratio(F.count_if(F.col("n") <= 5), _one())).alias("pct_le_5"),
        safe_ratio(F.var_samp("n"), F.avg("n")).alias("var_over_mean"),
    )
    return stats.withColumn("median", med.select("median").scalar())


def target_distribution(panel: DataFrame) -> DataFrame:
    """Moments and nearest-rank quantiles per series (a series is bounded by the calendar)."""
    return panel.where("n is not null").groupBy("grp").agg(
        _one().alias("days"), F.avg("n").alias("mean"), F.stddev_samp("n").alias("sd"),
        F.min("n").alias("min"), nearest_rank("n", 0.05).alias("p5"), nearest_rank("n", 0.25).alias("q1"),
        F.percentile("n", F.lit(0.5)).alias("median"), nearest_rank("n", 0.75).alias("q3"),
        nearest_rank("n", 0.95).alias("p95"), F.max("n").alias("max"),
        F.skewness("n").alias("skewness"), F.kurtosis("n").alias("excess_kurtosis"),
    )


def yearly_means(panel: DataFrame) -> DataFrame:
    return panel.where("n is not null").groupBy(F.year("date").cast("bigint").alias("year")).agg(
        F.avg("n").alias("mean_per_day"), _one().alias("days"))


def weekly_means(panel: DataFrame) -> DataFrame:
    return panel.where("n is not null").groupBy("grp", week_start(F.col("date")).alias("week")).agg(F.avg("n").alias("n"))


def monthly_composition(df: DataFrame, day: Column, label: Column, labels: Sequence[str]) -> DataFrame:
    """Records per observed day by label and month, one column per label.

    The label list is fixed, so the pivot needs no extra pass to discover it. Distinct
    days are counted from (month, label, day) partial aggregates.
    """
    per_day = df.groupBy(day.cast("date").alias("__d"), label.alias("__l")).agg(_one().alias("__c"))
    return per_day.groupBy(month_start(F.col("__d")).alias("month")).pivot("__l", list(labels)).agg(
        safe_ratio(F.sum("__c"), _one())
    ).fillna(0.0, subset=list(labels))


def same_span_change(df: DataFrame, day: Column, keys: Sequence[str], first: int, last: int, upto_doy: int) -> DataFrame:
    """Percent change between two years over the same span of days."""
    y = F.year(day)
    return df.where(y.isin(first, last) & (F.dayofyear(day) <= upto_doy)).groupBy(*keys).agg(
        F.count_if(y == first).alias("n_first"), F.count_if(y == last).alias("n_last")
    ).withColumn("pct_change", 100 * (safe_ratio(F.col("n_last"), F.col("n_first")) - 1))


def seasonal_index(panel: DataFrame) -> DataFrame:
    """Weekday, month and weekday x month index per series.

    Weekday and month cells are compared with the mean of the cell means; the crossed
    cells with the mean of all days of the series.
    """
    days = panel.where("n is not null").select(
        "grp", "n", iso_weekday(F.col("date")).alias("weekday"), F.month("date").cast("bigint").alias("month"))
    cells = days.groupingSets([["grp", "weekday"], ["grp", "month"], ["grp", "weekday", "month"], ["grp"]], "grp", "weekday", "month").agg(
        F.grouping_id().alias("gid"), F.avg("n").alias("mean_n"))
    per_set = Window.partitionBy("grp", "gid")
    whole = F.max(F.when(F.col("gid") == 3, F.col("mean_n"))).over(Window.partitionBy("grp"))
    base = F.when(F.col("gid") == 0, whole).otherwise(F.avg("mean_n").over(per_set))
    return cells.withColumn("index", safe_ratio(F.col("mean_n"), base)).where("gid <> 3").select(
        "grp", "weekday", "month", "mean_n", "index")


def low_spell(panel: DataFrame, threshold: float) -> DataFrame:
    return panel.where(F.col("n") < threshold).groupBy("grp").agg(
        F.min("date").alias("first_day"), F.max("date").alias("last_day"), _one().alias("days"))


def with_all_row(df: DataFrame, group: str, aggs: Sequence[Column]) -> DataFrame:
    """Aggregates per group plus one "All" row, from a single rollup."""
    return df.rollup(group).agg(F.grouping_id().alias("__g"), *aggs).withColumn(
        group, F.when(F.col("__g") == 1, F.lit("All")).otherwise(F.col(group).cast("string"))).drop("__g")


def freshness(df: DataFrame, ts: str, retrieved: str) -> DataFrame:
    last = F.max(F.col(ts))
    return df.agg(last.cast("date").alias("last_day"), F.datediff(F.lit(retrieved).cast("date"), last.cast("date")).cast("bigint").alias("lag_days"))


def expanding_counts(panel: DataFrame, first_month: str, last_month: str, gap: int = 3) -> DataFrame:
    """Monthly expanding schedule: cutoff, training rows up to it, validation rows of the month.

    Training counts are prefix sums over per-cutoff buckets (a row belongs to the first
    month whose cutoff reaches it), so no row is copied into later months.
    """
    spark = panel.sparkSession
    lo, hi = F.lit(first_month).cast("date"), F.lit(last_month).cast("date")
    months = spark.range(1).select(F.explode(F.sequence(lo, hi, F.expr("interval 1 month"))).alias("validation_start")).select(
        "validation_start", F.last_day("validation_start").alias("validation_end"),
        F.date_sub("validation_start", gap).alias("training_cutoff"))
    known = panel.where("n is not null")
    # Day d is usable from the first month whose start is >= d + gap.
    reach = F.date_add("date", gap)
    usable = F.when(F.trunc(reach, "month") == reach, reach).otherwise(F.add_months(F.trunc(reach, "month"), 1))
    train = known.groupBy(F.greatest(usable, lo).alias("m")).agg(_one().alias("train"), F.max("date").alias("latest"))
    valid = known.groupBy(F.trunc("date", "month").alias("m")).agg(_one().alias("valid"), F.min("date").alias("first_valid"))
    w = Window.orderBy("validation_start").rowsBetween(Window.unboundedPreceding, 0)  # one row per month
    return (
        months.join(F.broadcast(train), F.col("validation_start") == train["m"], "left").drop("m")
        .join(F.broadcast(valid), F.col("validation_start") == valid["m"], "left").drop("m")
        .select(
            "validation_start", "validation_end", "training_cutoff",
            F.coalesce(F.sum("train").over(w), F.lit(0)).alias("training_rows"),
            F.coalesce("valid", F.lit(0)).alias("validation_rows"),
            F.max("latest").over(w).alias("latest_training_date"),
            "first_valid",
        )
    )


def schedule_checks(schedule: DataFrame, test_start: str) -> DataFrame:
    """Cutoff, overlap and test-exclusion checks of a schedule, one row per month."""
    latest = F.col("latest_training_date")
    return schedule.select(
        "validation_start", "training_cutoff", latest, "training_rows", "validation_rows",
        (latest == F.col("training_cutoff")).alias("cutoff_correct"),
        (latest < F.col("first_valid")).alias("no_overlap"),
        ((latest < F.lit(test_start).cast("date")) & (F.col("validation_end") < F.lit(test_start).cast("date"))).alias("test_excluded"),
    )


def recent_snapshot(panel: DataFrame, days: int, groups: Sequence) -> DataFrame:
    """Last ``days`` days, one column per group."""
    last = panel.select(F.max("date")).scalar()
    return panel.where(F.col("date") > F.date_sub(last, days)).groupBy("date").pivot("grp", list(groups)).agg(F.max("n"))


def low_activity(panel: DataFrame, year: int, threshold: float) -> DataFrame:
    return low_spell(panel.where(F.year("date") == year), threshold)


def pairwise_correlation(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Correlation of every pair of a fixed list of columns over complete rows, in one aggregate."""
    complete = wide.dropna(subset=list(columns))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    row = complete.agg(*(F.corr(a, b).alias(f"__{i}") for i, (a, b) in enumerate(pairs)))
    return row.select(F.explode(F.array(*(
        F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"__{i}").alias("corr")) for i, (a, b) in enumerate(pairs)
    ))).alias("p")).select("p.left", "p.right", "p.corr")
