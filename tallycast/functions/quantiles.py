"""Exact quantiles that never gather a group in one place.

``percentile`` keeps every distinct value of a group in one aggregation buffer. That is
fine for groups bounded by the calendar (one series) and used there. For groups that
grow with the data (all rows of a model, all records of a category) wanted ranks are
selected by repeated counting: cuts divide the values of a key into cells, every cell is
counted map-side with its least and greatest value, and each rank goes on in the one cell that
holds it, until its value is the least or greatest of a cell. Cuts come from a mergeable sketch, but
only the counts decide, so a bad cut costs a round and never a wrong value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallycast.sources.sinks import stage

ACCURACY = 10000
# First cuts lie this far on either side of a quantile, within which the sketch has it.
MARGIN = 2.0 / ACCURACY
# Cuts of a later round, evenly spaced by rank.
CUTS = 127


def _sketched(values: str, shares: Sequence[float]) -> Column:
    """About the elements at these shares of the ranks; they only choose where cells end."""
    return F.percentile_approx(values, F.array(*(F.lit(x) for x in shares)), F.lit(ACCURACY))


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys that may be null; right must have one row a key, or several for each row of left."""
    if not keys:
        return left.join(F.broadcast(right))  # without keys, right has a row a rank
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys))
    return left.join(renamed, on).drop(*(f"__r_{k}" for k in keys))


def _placed(rows: DataFrame, keys: Sequence[str], cuts: DataFrame, ranks: DataFrame) -> DataFrame:
    """The cell of each wanted rank: keys, __id, __k (rank inside the cell), __lo and __hi; and __value, if that is known.

    rows: keys and __v. cuts: keys and __cuts, an array of values. ranks: keys, __id and __k, counted from 0.
    Values equal to a cut have a cell of their own, so every round takes something off a cell.
    """
    cell = F.expr("2 * size(filter(__cuts, c -> c < __v)) + cast(array_contains(__cuts, __v) as int)")
    counted = _same(rows, cuts, keys).groupBy(*keys, cell.alias("__cell")).agg(F.count(F.lit(1)).alias("__c"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    cells = counted.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__cell", "__c", "__lo", "__hi"))).alias("__cells"))
    ends = F.expr("transform(__cells, (x, i) -> aggregate(slice(__cells, 1, i + 1), 0L, (s, y) -> s + y.__c))")
    found = _same(ranks, cells.withColumn("__ends", ends), keys).withColumn("__at", F.expr("size(filter(__ends, e -> e <= __k))"))
    found = found.selectExpr(*(f"`{k}`" for k in keys), "__id", "__k - get(__ends, __at) as __left", "get(__cells, __at) as __cell")
    place = found.selectExpr(*(f"`{k}`" for k in keys), "__id", "__left + __cell.__c as __k", "__cell.__c", "__cell.__lo", "__cell.__hi")
    return place.withColumn("__value", F.expr("case when __k = 0 or __lo = __hi then __lo when __k = __c - 1 then __hi end"))


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    nearest: bool = False,
    also: Sequence[Column] = (),
) -> DataFrame:
    """Exact quantiles of ``value`` by ``keys``: one column per entry of ``probs``.

    ``nearest`` picks the element at index ``round(q * (n - 1))``; otherwise the two
    neighbours are interpolated linearly. Null values are
    ignored; a key with nothing else gets null. ``also`` lists further
    (aliased) aggregates of the same rows. The input is written once and read twice; later
    rounds read only the cells that still hold a wanted rank.
    """
    keys, names, qs = list(keys), list(probs), list(probs.values())
    rows = stage(df.withColumn("__v", F.col(value).cast("double")), "quantile-rows")
    shares = sorted({min(max(x, 0.0), 1.0) for q in qs for x in (q - MARGIN, q, q + MARGIN)})
    head = stage(rows.groupBy(*keys).agg(*also, F.count("__v").alias("__n"), _sketched("__v", shares).alias("__cuts")), "quantile-heads")
    extra = [c for c in head.columns if c not in (*keys, "__n", "__cuts")]

    def place(q: float) -> tuple[Column, Column, Column]:
        at = F.lit(q) * (F.col("__n") - 1)
        low, high = (F.round(at), F.round(at)) if nearest else (F.floor(at), F.ceil(at))
        return at, low.cast("bigint"), high.cast("bigint")

    wanted = [F.struct(F.lit(2 * i + s).alias("__id"), k.alias("__k")) for i, q in enumerate(qs) for s, k in enumerate(place(q)[1:])]
    ranks = head.where("__n > 0").select(*keys, F.explode(F.array(*wanted)).alias("__w")).select(*keys, "__w.*")
    values = rows.select(*keys, "__v").where("__v is not null")
    now = stage(_placed(values, keys, head.select(*keys, "__cuts"), ranks), "quantile-places")
    known, met, inner = [now], keys, [*keys, "__rank"]
    even = [i / (CUTS + 1) for i in range(1, CUTS + 1)]
    while not (open_ := now.where("__value is null")).isEmpty():
        open_ = open_.withColumn("__rank", F.col("__id"))  # from the first cells on, each rank has rows of its own
        inside = F.col("__v").between(F.col("__lo"), F.col("__hi"))
        values = stage(_same(values, open_.select(*inner, "__lo", "__hi"), met).where(inside).select(*inner, "__v"), "quantile-cells")
        cuts = values.groupBy(*inner).agg(_sketched("__v", even).alias("__cuts"))
        now = stage(_placed(values, inner, cuts, open_.select(*inner, "__id", "__k")), "quantile-places")
        known, met = [*known, now], inner
    found = reduce(DataFrame.unionAll, (k.where("__value is not null").select(*keys, "__id", "__value") for k in known)).groupBy(*keys).agg(*(F.max(F.when(F.col("__id") == i, F.col("__value"))).alias(f"__q{i}") for i in range(2 * len(qs))))
    if keys:
        renamed = found.withColumnsRenamed({k: f"__r_{k}" for k in keys})
        whole = head.join(renamed, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys)), "left")
    else:
        whole = head.join(F.broadcast(found))  # one row each

    def between(i: int, q: float) -> Column:
        at, a, b = place(q)[0], F.col(f"__q{2 * i}"), F.col(f"__q{2 * i + 1}")
        return a if nearest else a + (b - a) * (at - F.floor(at))

    return whole.select(*keys, *extra, *(between(i, q).alias(n) for i, (n, q) in enumerate(zip(names, qs))))


def nearest_rank(values: str, q: float):
    """Nearest-rank quantile of one calendar-bounded group: sort, take index round(q*(n-1))."""
    arr = F.array_sort(F.collect_list(F.col(values)))
    idx = F.round(F.lit(q) * (F.size(arr) - 1)).cast("int")
    return F.get(arr, idx).cast("double")
