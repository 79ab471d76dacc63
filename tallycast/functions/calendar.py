"""Calendar columns: date parts, yearly cycle, statutory holidays."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

YEAR_DAYS = 365.25


def iso_weekday(day: Column) -> Column:
    """1 = Monday .. 7 = Sunday (``dayofweek`` starts on Sunday, so it is not used)."""
    return (F.weekday(day) + 1).cast("bigint")


def week_key(day: Column) -> Column:
    """ISO week block, ``iso_year * 100 + iso_week``."""
    return (F.extract(F.lit("YEAROFWEEK"), day) * 100 + F.weekofyear(day)).cast("bigint")


def year_month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def month_start(day: Column) -> Column:
    return F.trunc(day, "month")


def week_start(day: Column) -> Column:
    """Monday of the week, as a date."""
    return F.date_sub(day, F.weekday(day))


def yearly_wave(day: Column, order: int = 1) -> tuple[Column, Column]:
    """sin and cos of ``order`` turns a year."""
    angle = F.lit(2 * math.pi * order) * F.dayofyear(day) / F.lit(YEAR_DAYS)
    return F.sin(angle), F.cos(angle)


def fourier(day: Column, order: int) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for k in range(1, order + 1):
        s, c = yearly_wave(day, k)
        out[f"doy_sin_{k}"], out[f"doy_cos_{k}"] = s, c
    return out


def with_easter(years: DataFrame, year: str) -> DataFrame:
    """Add ``easter``: the Gregorian computus in integer arithmetic (anonymous algorithm)."""
    def div(a: Column, b: int) -> Column:
        return F.floor(a / b).cast("int")

    c = F.col
    y = c(year).cast("int")
    step = years.withColumns({"__a": y % 19, "__b": div(y, 100), "__c": y % 100})
    step = step.withColumn(
        "__h", (19 * c("__a") + c("__b") - div(c("__b"), 4) - div(c("__b") - div(c("__b") + 8, 25) + 1, 3) + 15) % 30
    )
    step = step.withColumn("__l", (32 + 2 * (c("__b") % 4) + 2 * div(c("__c"), 4) - c("__h") - c("__c") % 4) % 7)
    step = step.withColumn("__m", div(c("__a") + 11 * c("__h") + 22 * c("__l"), 451))
    step = step.withColumn("__x", c("__h") + c("__l") - 7 * c("__m") + 114)
    return step.withColumn("easter", F.make_date(y, div(c("__x"), 31), c("__x") % 31 + 1)).select(*years.columns, "easter")


def _on_or_after(day: Column, iso: int) -> Column:
    """First ``iso`` weekday on or after ``day``."""
    return F.date_add(day, F.pmod(F.lit(iso - 1) - F.weekday(day), F.lit(7)).cast("int"))


def holiday_table(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """Québec statutory holidays, eight rows a year: ``holiday DATE, name STRING``."""
    y = F.col("y").cast("int")

    def fixed(month: int, day: int) -> Column:
        return F.make_date(y, F.lit(month), F.lit(day))

    # The statutory days and their rules.
    rules = {
        "New Year's Day": fixed(1, 1),
        "Good Friday": F.date_sub("easter", 2),
        "National Patriots' Day": _on_or_after(fixed(5, 18), 1),
        "National Holiday": fixed(6, 24),
        "Canada Day": fixed(7, 1),
        "Labour Day": _on_or_after(fixed(9, 1), 1),
        "Thanksgiving": _on_or_after(fixed(10, 8), 1),
        "Christmas Day": fixed(12, 25),
    }
    pairs = F.array(*(F.struct(day.alias("holiday"), F.lit(name).alias("name")) for name, day in rules.items()))
    years = with_easter(spark.range(first_year, last_year + 1).withColumnRenamed("id", "y"), "y")
    return years.select(F.explode(pairs).alias("h")).select("h.holiday", "h.name")


def marked_days(spark: SparkSession, years: tuple[int, int]) -> DataFrame:
    """Days that matter to the holiday features: ``day, holiday, adjacent`` (24 rows a year at most)."""
    hol = holiday_table(spark, *years).select(
        F.explode(F.array(
            F.struct(F.col("holiday").alias("day"), F.lit(True).alias("is")),
            F.struct(F.date_sub("holiday", 1).alias("day"), F.lit(False).alias("is")),
            F.struct(F.date_add("holiday", 1).alias("day"), F.lit(False).alias("is")),
        )).alias("m")
    )
    return hol.groupBy("m.day").agg(F.max("m.is").alias("holiday")).withColumn("adjacent", ~F.col("holiday"))


def window_counts(spark: SparkSession, window_days: int, years: tuple[int, int]) -> DataFrame:
    """Holiday and adjacent days of the windows that hold any: ``start, holidays, holiday_adjacent``.

    Built from the rules (every marked day reaches ``window_days`` starts); its size is
    fixed by the year span.
    """
    marks = marked_days(spark, years)
    reach = F.sequence(F.date_sub("day", window_days - 1), F.col("day"))
    return marks.select(F.explode(reach).alias("start"), "holiday", "adjacent").groupBy("start").agg(
        F.count_if("holiday").alias("holidays"), F.count_if("adjacent").alias("holiday_adjacent"))


def window_calendar(df: DataFrame, start: str, window_days: int) -> DataFrame:
    """Add calendar facts of windows starting on ``start``.

    Weekday, month and wave describe the first day; the holiday and adjacent counts
    cover the window. The years are those of the starts, read first.
    """
    s = F.col(start)
    span = df.agg(F.min(F.year(s)).alias("lo"), F.max(F.year(s)).alias("hi")).first()
    years = (span.lo - 1, span.hi + 1 + window_days // 365) if span.lo is not None else (2000, 2000)
    counts = F.broadcast(window_counts(df.sparkSession, window_days, years).withColumnRenamed("start", "__s"))
    sin, cos = yearly_wave(s)
    zero = F.lit(0).cast("bigint")
    return df.join(counts, s == F.col("__s"), "left").drop("__s").withColumns(
        {
            "holidays": F.coalesce("holidays", zero),
            "holiday_adjacent": F.coalesce("holiday_adjacent", zero),
            "target_weekday": iso_weekday(s),
            "target_month": F.month(start).cast("bigint"),
            "target_doy_sin": sin,
            "target_doy_cos": cos,
        }
    )
