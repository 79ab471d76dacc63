"""Shards of near-equal size by minimax contiguous partition.

Documents of equal text form an atomic group. Groups stand in the order of their least doc_id, and
shards are runs of groups. The smallest feasible capacity of a shard is found by binary search; a
greedy pass that fills every shard as far as it goes checks a capacity.

The passes run on running sizes of groups, but the driver never sees them all. Each level of the
search looks at the running sizes through a grid of CELLS cells and keeps the greatest in each. A
greedy pass on the grid errs by a cell at most, in a known direction, so it proves capacities
feasible or not down to a small interval; the next level lays a finer grid over the places where
cuts can still be. At the last level a cell holds one possible size, so the capacity is exact. With
the capacity known, cuts are set so that shards are near equal, never beyond it.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallycast.llm.common import join_on_hot_key, partitions, staged

SHARDS = 24
OVERHEAD = 8
#: Running sizes that the driver holds of one level at most. Each level's grid is finer by about CELLS / shards**2 (by 2 at least).
CELLS = 1 << 16

#: (begin, end, cell width) -> the greatest running size in each cell of begin < size <= end, ascending.
Look = Callable[[list[tuple[int, int]], int], list[int]]


def _cuts(capacity: int, total: int, shards: int, step: Callable[[int], int]) -> list[int] | None:
    """Greedy cuts: step(limit) is the greatest allowed cut up to limit. None if shards do not suffice."""
    cuts, at = [], 0
    for _ in range(shards):
        if at + capacity >= total:
            return [*cuts, total]
        new = step(at + capacity)
        if new <= at:
            return None
        cuts.append(new)
        at = new
    return None


def smallest_capacity(total: int, largest: int, shards: int, look: Look, cells: int = CELLS) -> int:
    """The least capacity for which greedy filling needs no more than `shards` shards.

    low is infeasible (or below any group), high is feasible; both are proved by passes that place
    each cut at worst (known sizes below the cell) or at best (anywhere in the cell).
    """
    low, high = max(largest, -(-total // shards)) - 1, min(total, -(-total // shards) + largest)
    spans, width = [(0, total)], total + 1
    while low + 1 < high:
        width = max(1, min(-(-sum(b - a for a, b in spans) // cells), width // 2))
        ends = look(spans, width)

        def known(limit: int, ends: list[int] = ends) -> int:
            i = bisect_right(ends, limit)
            return ends[i - 1] if i else 0

        def hopeful(limit: int, ends: list[int] = ends, width: int = width, spans: list[tuple[int, int]] = spans) -> int:
            """No cut beyond this can be at most limit: the cell of limit may hide one at limit itself."""
            i = bisect_left(spans, (limit, -1)) - 1
            if i < 0 or limit > spans[i][1]:
                return known(limit)
            begin = spans[i][0] + (limit - spans[i][0] - 1) // width * width
            j = bisect_right(ends, begin)
            hidden = j < len(ends) and ends[j] > limit and ends[j] <= begin + width
            return limit if hidden and width > 1 else known(limit)

        a, b = low, high  # a: infeasible even at best; b: feasible even at worst
        while a + 1 < b:
            c = (a + b) // 2
            if _cuts(c, total, shards, hopeful) is None:
                a = c
            else:
                b = c
        surely = high
        low, x = a, a
        while x + 1 < surely:
            c = (x + surely) // 2
            if _cuts(c, total, shards, known) is None:
                x = c
            else:
                surely = c
        high = surely
        if width == 1:
            return high
        places = []
        at_low = at_high = 0
        for _ in range(shards - 1):  # where the next cut can be, from the earliest and the latest last one
            places.append((max(0, known(at_low + low) - 1), min(total, at_high + high)))
            at_low, at_high = known(at_low + low), min(total, hopeful(at_high + high))
        merged: list[tuple[int, int]] = []
        for x, y in sorted(places):
            if merged and x <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(merged[-1][1], y))
            else:
                merged.append((x, y))
        spans = merged
    return high


def balanced_cuts(total: int, capacity: int, shards: int, around: Callable[[int], tuple[int, int]]) -> list[int]:
    """Cuts nearest to an equal share of what is left, each shard within the capacity, which must be feasible.

    around(x) gives the greatest running size up to x and the least beyond it. Filling shards greedily
    from the end gives the earliest place of each cut: from there on, and only from there, the shards
    behind it can hold the rest.
    """
    earliest = [total]
    for _ in range(shards):
        need = earliest[-1] - capacity
        earliest.append(around(need - 1)[1] if need > 0 else 0)
    if earliest[-1] > 0:
        raise ValueError("the capacity is not feasible")
    cuts, at = [], 0
    for left in range(shards, 1, -1):
        goal = at + (total - at) // left
        below, beyond = around(goal)
        cut = below if goal - below <= beyond - goal or beyond > at + capacity else beyond
        if cut <= at and beyond <= at + capacity:
            cut = beyond
        at = max(cut, earliest[left - 1])
        cuts.append(at)
    return [*cuts, total]


def shards_by_bytes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Every row of docs with its shard: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the UTF-8 length of the text plus 8. Null texts count as empty, and so do their checksums;
    null doc_ids come first. slot numbers the rows of a shard without gaps in doc_id order; rows alike
    in doc_id and text are numbered in any order. Other columns are ignored; an empty table gives none.
    With fewer groups than shards some shards stay empty. grown_shard is null: the law is `bytes`.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    size = F.octet_length(text).cast("long") + OVERHEAD
    crc = F.crc32(text)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), F.unhex(F.md5(text)).alias("key"))
    rows = base.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "key").withColumn("cell", F.spark_partition_id())
    rows = staged(rows, "rows")
    groups = rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("copies"))
    ordered = staged(groups.repartitionByRange(n, F.col("first").asc_nulls_first(), "key").withColumn("part", F.spark_partition_id()), "groups")
    parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    before = ordered.groupBy("part").agg(F.sum("bytes").alias("part_bytes")).withColumn("before", F.coalesce(F.sum("part_bytes").over(parts), F.lit(0)))
    running = Window.partitionBy("part").orderBy(F.col("first").asc_nulls_first(), "key")
    ends = ordered.withColumn("running", F.sum("bytes").over(running)).join(F.broadcast(before.select("part", "before")), "part")
    ends = staged(ends.select("key", "copies", "bytes", (F.col("before") + F.col("running")).alias("end")), "ends")
    whole = ends.agg(F.max("end").alias("total"), F.max("bytes").alias("largest"), F.sum("copies").alias("rows")).first()
    total, largest, count = whole.total or 0, whole.largest or 0, whole.rows or 0

    def look(spans: list[tuple[int, int]], width: int) -> list[int]:
        inside, cell = F.lit(False), F.lit(None).cast("long")
        for i, (a, b) in enumerate(spans):
            here = (F.col("end") > a) & (F.col("end") <= b)
            inside = inside | here
            cell = F.when(here, F.floor((F.col("end") - a - 1) / width) * len(spans) + i).otherwise(cell)
        got = ends.where(inside).groupBy(cell.alias("cell")).agg(F.max("end").alias("end"))
        return sorted(r.end for r in got.select("end").collect())

    def around(goal: int) -> tuple[int, int]:
        near = ends.where(F.col("end").between(goal - largest, goal + largest))  # running sizes are no further apart
        r = near.agg(F.max(F.when(F.col("end") <= goal, F.col("end"))).alias("below"), F.min(F.when(F.col("end") > goal, F.col("end"))).alias("beyond")).first()
        return r.below or 0, r.beyond if r.beyond is not None else total

    cuts = [total] * shards
    if total:
        capacity = smallest_capacity(total, largest, shards, look)
        cuts = balanced_cuts(total, capacity, shards, around)
    shard = sum((F.when(F.col("end") > c, 1).otherwise(0) for c in cuts[:-1]), F.lit(0)).cast("int")
    keyed = ends.select("key", "copies", shard.alias("shard"))
    placed = staged(join_on_hot_key(rows, keyed, "key", "copies", count), "placed")
    per_cell = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    base_slot = per_cell.select("shard", "cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "cell").orderBy(F.col("doc_id").asc_nulls_first(), "key")
    slotted = placed.withColumn("row", F.row_number().over(within)).join(F.broadcast(base_slot), ["shard", "cell"])
    return slotted.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("row") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
