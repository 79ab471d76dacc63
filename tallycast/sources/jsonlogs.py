"""JSON sources: activity logs, package metadata, stored reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Shapes of the documents, only the fields that are read.
ACTIVITY = "result array<struct<data: struct<package: struct<resources: array<struct<id: string, last_modified: string, size: bigint>>>>>>"
PACKAGE = "id string, title string, resources array<struct<name: string, format: string, url: string, size: bigint>>"
REPORT = "label string, period struct<start: string, end: string>, overall array<struct<model: string, n: bigint, mae: double, bias: double>>, wape map<string, double>"


def parse(docs: DataFrame, column: str, schema: str) -> DataFrame:
    """Parse one JSON document per row with a fixed, pruned schema."""
    return docs.select("*", F.from_json(F.col(column), schema).alias("__j")).drop(column)


def upload_history(docs: DataFrame, resource: str, column: str = "value") -> DataFrame:
    """(last_modified, size) of one resource; an upload listed twice keeps its greatest size."""
    res = parse(docs, column, ACTIVITY).select(F.explode("__j.result.data.package.resources").alias("r")).select(F.explode("r").alias("r"))
    hit = res.where((F.col("r.id") == resource) & F.col("r.last_modified").isNotNull())
    return hit.groupBy(F.col("r.last_modified").alias("last_modified")).agg(F.max("r.size").alias("size"))


def package_resources(docs: DataFrame, column: str = "value") -> DataFrame:
    """One row per listed resource with its position."""
    return parse(docs, column, PACKAGE).select("__j.id", F.posexplode("__j.resources").alias("pos", "r")).select("id", F.col("pos").cast("bigint").alias("pos"), "r.*")


def first_with_prefix(resources: DataFrame, prefix: str) -> DataFrame:
    """First resource of each package whose name starts with ``prefix``."""
    hit = resources.where(F.col("name").startswith(prefix))
    return hit.groupBy("id").agg(F.min("pos").alias("pos"), F.min_by("name", "pos").alias("name"))


def report_rows(docs: DataFrame, column: str = "value") -> DataFrame:
    """Stored reports -> one row per setting and model."""
    j = parse(docs, column, REPORT)
    rows = j.select("__j.label", "__j.period.start", "__j.period.end", "__j.wape", F.explode("__j.overall").alias("o"))
    return rows.select("label", "start", "end", "o.*", F.element_at("wape", F.col("o.model")).alias("wape"))


def setting_comparison(rows: DataFrame, final: str, references: list[str]) -> DataFrame:
    """Per setting: the final model, the references and the best single model, with guards.

    ``consistent`` is false when the models of a setting were scored on different row
    counts or periods.
    """
    keys = ["label"]
    per = rows.groupBy(*keys).agg(
        (F.count_distinct("n") == 1).alias("equal_n"), F.count_distinct("start", "end").alias("periods"),
        F.min_by("model", F.struct(F.when(F.col("model") == final, None).otherwise(F.col("mae")).isNull(), F.col("mae"), F.col("model"))).alias("best_single"),
        F.max(F.when(F.col("model") == final, F.col("mae"))).alias("final_mae"),
    )
    j = rows.join(per, keys)
    role = F.when(F.col("model") == final, "final").when(F.col("model") == F.col("best_single"), "best_single").when(F.col("model").isin(references), "reference")
    return j.select("label", "model", role.alias("role"), "n", "mae", "bias", "wape", (F.col("final_mae") - F.col("mae")).alias("final_minus"),
                    (F.col("equal_n") & (F.col("periods") == 1)).alias("consistent")).where("role is not null")
