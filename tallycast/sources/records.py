"""Event record sources: typed scans, timestamp parsing, append checks, recoding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted timestamp layouts, full and date only.
TIME_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(T[0-9]{2}:[0-9]{2}:[0-9]{2})?$"


def event_schema(longs: Sequence[str], strings: Sequence[str], doubles: Sequence[str], order: Sequence[str]) -> T.StructType:
    """Explicit nullable schema; no inference pass over the files."""
    kind = dict.fromkeys(longs, T.LongType()) | dict.fromkeys(strings, T.StringType()) | dict.fromkeys(doubles, T.DoubleType())
    return T.StructType([T.StructField(c, kind[c]) for c in order])


def read_events(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """Typed CSV scan: empty fields are null, malformed numbers fail, rows know their file."""
    raw = (
        spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False)
        .csv(paths if isinstance(paths, str) else list(paths))
    )
    return raw.select("*", F.col("_metadata.file_name").alias("source_file"))


def parse_time(text: Column) -> Column:
    """Zone-less timestamp of either layout; null when neither fits.

    The cast never passes through the session time zone, so hours skipped by a clock
    change stay what they are.
    """
    return F.when(text.rlike(TIME_PATTERN), text.try_cast("timestamp_ntz"))


def with_event_time(df: DataFrame, text: str) -> DataFrame:
    """Parsed time, ``has_time``, ``date`` and ``year``."""
    raw = F.col(text)
    return df.withColumn("has_time", raw.contains("T")).withColumn(text, parse_time(raw)).withColumns(
        {"date": F.col(text).cast("date"), "year": F.year(text).cast("bigint")}
    )


def bad_times(df: DataFrame, text: str) -> DataFrame:
    """Parse quality of a text column: rows, invalid values, date-only values."""
    raw = F.col(text)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(parse_time(raw).isNull()).alias("invalid"),
        F.count_if(parse_time(raw).isNotNull() & ~raw.contains("T")).alias("date_only"),
    )


def require_times(df: DataFrame, text: str) -> DataFrame:
    """Fail inside the job on the first value that fits no layout; no extra pass."""
    parsed = parse_time(F.col(text))
    guard = F.when(parsed.isNull(), F.raise_error(F.concat(F.lit("unparseable time: "), F.coalesce(F.col(text), F.lit("null")))).cast("timestamp_ntz")).otherwise(parsed)
    return df.withColumn("has_time", F.col(text).contains("T")).withColumn(text, guard).withColumns(
        {"date": F.col(text).cast("date"), "year": F.year(text).cast("bigint")}
    )


def append_exports(parts: Sequence[DataFrame], relaxed: bool = False) -> DataFrame:
    """Append tables of one layout; ``relaxed`` fills missing columns with null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=relaxed)
    return out


def append_checks(first: DataFrame, second: DataFrame, time: str, keys: Sequence[str]) -> DataFrame:
    """Can two exports be appended: same columns, no time overlap, no shared keys."""
    overlap = first.select(*keys).intersect(second.select(*keys)).agg(F.count(F.lit(1)).alias("key_overlap"))
    hi, lo = first.select(F.max(time)).scalar(), second.select(F.min(time)).scalar()
    return overlap.select(
        F.lit(first.columns == second.columns).alias("same_columns"), (hi >= lo).alias("date_overlap"), "key_overlap")


def recode(column: Column, labels: Mapping[str, str]) -> Column:
    """Map known labels, keep the rest."""
    pairs = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, column), column)


def harmonise(df: DataFrame, column: str, labels: Mapping[str, str], blank: str = "(blank)") -> DataFrame:
    """Long labels to codes; null or empty becomes ``blank``; unknown labels stay."""
    value = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(blank))
    return df.withColumn(column, recode(value, labels))
