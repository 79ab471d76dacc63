"""File fingerprints and their comparison."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of a file that a task holds at a time.
CHUNK = 8 << 20


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for path in batch.column(0).to_pylist():
            h = hashlib.sha256()
            with open(path.removeprefix("file:"), "rb") as f:
                while chunk := f.read(CHUNK):
                    h.update(chunk)
            found.append(h.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], names=["path", "bytes", "sha256"])


def fingerprint(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path, sha256, bytes`` of every file below ``path``; files are hashed in parallel.

    Files are named relative to the folder given (a single file by its last name). In a mounted file system, which all
    executors share, a file of any size is read in chunks; elsewhere Spark reads it whole, so it must be below 2 GB.
    """
    given = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = given.getFileSystem(spark._jsc.hadoopConfiguration())
    root = system.makeQualified(given)
    base = root if system.getFileStatus(root).isDirectory() else root.getParent()
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    if root.toUri().getScheme() == "file":
        listed = files.select(F.regexp_replace("path", "^file:/+", "file:/").alias("path"), F.col("length").alias("bytes"))  # contents are not read here
        hashed = listed.repartition(F.col("path")).mapInArrow(_hashed, "path string, bytes bigint, sha256 string")
    else:
        hashed = files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    skip = len(base.toString().rstrip("/")) + 1
    return hashed.select(F.substring("path", skip + 1, 1 << 30).alias("path"), "sha256", "bytes")


def diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Problems of ``actual`` against ``expected``: missing, size changed, content changed."""
    a = actual.select("path", F.col("sha256").alias("__h"), F.col("bytes").alias("__b"))
    joined = expected.join(a, "path", "left")
    problem = F.when(F.col("__b").isNull(), "missing").when(F.col("__b") != F.col("bytes"), "size changed").when(F.col("__h") != F.col("sha256"), "content changed")
    return joined.select("path", problem.alias("problem")).where("problem is not null")


def source_profile(df: DataFrame, source: str, first_of: str, fingerprints: DataFrame) -> DataFrame:
    """Rows, first and last value per source file, with the file's size and short hash."""
    table = df.groupBy(source).agg(F.count(F.lit(1)).alias("rows"), F.min(first_of).alias("first"), F.max(first_of).alias("last"))
    f = fingerprints.select(F.col("path").alias(source), "bytes", F.substring("sha256", 1, 12).alias("sha256_12"))
    return table.join(f, source, "left")
