"""Shared helpers: tables, staging in the shared folder, and joins that survive a hot key."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import wraps

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it has at least this share of all rows, so there are at most HOT_KEYS hot keys.
HOT_KEYS = 1000

#: Rows and bytes of one Arrow batch, about: long texts stay within a worker's memory.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


#: Bytes of results and texts that a cache of a Python worker keeps, about.
CACHE_BYTES = 32 << 20

#: How to empty the caches of this Python worker, and the operator that filled them.
_CACHES: list[Callable[[], None]] = []
_filled_by = ""


def emptied_between_operators(clear: Callable[[], None]) -> None:
    """Have a cache emptied when a reused worker goes on with another operator."""
    _CACHES.append(clear)


def caches_of(operator: str) -> None:
    """Called where an operator begins in a task: a reused worker drops what another operator has left."""
    global _filled_by
    if _filled_by != operator:
        for clear in _CACHES:
            clear()
        _filled_by = operator


def bounded(fn: Callable[[str], tuple[np.ndarray, ...] | np.ndarray]):
    """Cache arrays by text until they hold CACHE_BYTES; then it starts again, so a reused worker keeps no more."""
    kept: dict[str, tuple[np.ndarray, ...] | np.ndarray] = {}
    held = 0

    @wraps(fn)
    def cached(text: str):
        nonlocal held
        found = kept.get(text)
        if found is None:
            found = fn(text)
            held += 4 * len(text) + sum(x.nbytes for x in (found if isinstance(found, tuple) else (found,)))
            if held > CACHE_BYTES:
                kept.clear()
                held = 4 * len(text) + sum(x.nbytes for x in (found if isinstance(found, tuple) else (found,)))
            kept[text] = found
        return found

    def clear() -> None:
        nonlocal held
        kept.clear()
        held = 0

    emptied_between_operators(clear)
    return cached


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python in small Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local default exists only for a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return "/tmp/tallycast-checkpoints"
    raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/llm-{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write once below the shared folder and read back: cuts lineage, survives a lost executor."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_key(text: str = "text"):
    """128-bit identity of a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))


def join_on_hot_key(rows: DataFrame, keyed: DataFrame, key: str | list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """Join rows with a table of one row a key, where one key may hold a third of all rows.

    keyed is a staged table that has the number of rows of each key in `count`. Keys with 1/HOT_KEYS of
    all rows or more are at most HOT_KEYS, so their side is broadcast; all others meet in an ordinary join.
    Without such keys the ordinary join is all: rows are read once, and nothing is broadcast.
    """
    least = max(2, total // HOT_KEYS + 1)
    hot = keyed.where(F.col(count) >= least)
    if hot.isEmpty():
        return rows.join(keyed, key, how)
    rest = keyed.where(F.col(count) < least)
    names = hot.select(key)
    heavy = rows.join(F.broadcast(hot), key, how)
    light = rows.join(F.broadcast(names), key, "left_anti").join(rest, key, how)
    if how == "left":
        heavy = rows.join(F.broadcast(names), key, "left_semi").join(F.broadcast(hot), key, "inner")
    return heavy.select(light.columns).unionAll(light)


def columns_free(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop columns whose names an operator is about to add (case is ignored)."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def packed(df: DataFrame, **helpers: Column) -> DataFrame:
    """Helper columns beside the whole row in a struct `row`, so no column of df can clash with them; select("row.*") unpacks."""
    return df.select(F.struct("*").alias("row"), *[c.alias(n) for n, c in helpers.items()])
