"""Publication-lag audit: what was available when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallycast.functions.stats import safe_ratio
from tallycast.operators.joins import asof_join, nearest_value


def bytes_per_day(lines: DataFrame, line: str = "value", field: int = 1, sep: str = ",") -> DataFrame:
    """Bytes of raw text lines per record date (newline included); the date starts the field."""
    day = F.substring(F.get(F.split(F.col(line), sep), F.lit(field)), 1, 10)
    return lines.where(F.length(line) > 0).groupBy(F.try_to_date(day, "yyyy-MM-dd").alias("date")).agg(
        F.sum(F.octet_length(line) + 1).alias("bytes"))


def cumulative_bytes(daily: DataFrame, header: int = 0) -> DataFrame:
    """Running file size by date (one row per day: the window is calendar bounded)."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select("date", "bytes", (F.sum("bytes").over(w) + header).alias("cum_bytes"))


def match_uploads(uploads: DataFrame, cumulative: DataFrame, width: float) -> DataFrame:
    """Latest date an upload contains: the day whose running size is closest to its size."""
    facts = cumulative.select(F.col("date").alias("content_date"), "bytes", "cum_bytes")
    m = nearest_value(uploads, facts, "size", "cum_bytes", ["content_date", "bytes"], width)
    resid = F.col("size") - F.col("cum_bytes")
    return m.select("uploaded_at", "size", "content_date", resid.alias("residual"), safe_ratio(resid, F.col("bytes")).alias("residual_share"))


def availability(matched: DataFrame, prep_hour: int) -> DataFrame:
    """Latest content date known at ``prep_hour`` of each day from the first upload on.

    "Latest" is the greatest content date among all earlier uploads, not the content of
    the last upload.
    """
    span = matched.agg(F.to_date(F.min("uploaded_at")).alias("lo"), F.to_date(F.max("uploaded_at")).alias("hi"))
    preps = span.select(F.explode(F.sequence(F.date_add("lo", 1), "hi")).alias("prep_day")).withColumn(
        "prep_time", F.col("prep_day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(prep_hour)))
    facts = matched.select("uploaded_at", "content_date")
    got = asof_join(preps, facts, [], "prep_time", "uploaded_at", ["content_date"], F.date_trunc("day", "__t"), how="max")
    return got.where("content_date is not null").select(
        "prep_day", F.date_add("prep_day", 1).alias("target_day"), "content_date",
        F.datediff(F.date_add("prep_day", 1), "content_date").cast("bigint").alias("lag_days"))


def lag_distribution(available: DataFrame, worst_from: int = 5) -> DataFrame:
    """Days per lag with their share and the earliest day of lags at or over ``worst_from``."""
    by = available.groupBy("lag_days").agg(
        F.count(F.lit(1)).alias("days"), F.min(F.when(F.col("lag_days") >= worst_from, F.col("prep_day"))).alias("first_worst"))
    return by.withColumn("share", safe_ratio(F.col("days"), F.sum("days").over(Window.partitionBy(F.lit(1)))))


def upload_hours(uploads: DataFrame, zone: str) -> DataFrame:
    """Histogram of the local hour of UTC upload times."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("uploaded_at"))
    return uploads.groupBy(F.hour(local).cast("bigint").alias("hour")).agg(F.count(F.lit(1)).alias("uploads"))


def days_without(uploads: DataFrame, day: Column) -> DataFrame:
    seen = uploads.select(day.alias("date")).distinct()
    span = seen.agg(F.sequence(F.min("date"), F.max("date")).alias("d")).select(F.explode("d").alias("date"))
    return span.join(seen, "date", "left_anti")


def residual_profile(matched: DataFrame) -> DataFrame:
    """Spread of the size residual, as a share of the matched day's bytes."""
    from tallycast.functions.quantiles import exact_quantiles

    a = F.abs("residual_share")
    q = exact_quantiles(matched, [], "residual_share", {"median": 0.5})
    q95 = exact_quantiles(matched.withColumn("a", a), [], "a", {"abs_q95": 0.95})
    return matched.agg(F.count(F.lit(1)).alias("uploads"), F.max(a).alias("abs_max"), F.min("residual_share").alias("min")).withColumns(
        {"median": q.select("median").scalar(), "abs_q95": q95.select("abs_q95").scalar()})
