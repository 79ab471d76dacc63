"""Connected components, and links between items that share a bucket."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.llm.common import small_batches, staged

#: Members and bytes of text of a block, about; what hubs leave is compared block by block.
BLOCK, BLOCK_BYTES = 64, 1 << 20
#: Rows of an Arrow batch of block pairs.
BLOCK_ROWS = 16
#: (first texts, second texts) -> whether each pair is linked.
Verify = Callable[[list[str], list[str]], list[bool]]
#: (first texts, second texts) -> matrix of pairs: 0 if surely not linked, 2 if surely linked, 1 if that is left to Verify.
Possible = Callable[[list[str], list[str]], np.ndarray]


def components(edges: DataFrame) -> DataFrame:
    """node and root of every node of a table of edges (a, b); nodes of one component share their root.

    Contraction: every node takes the least id among itself and its neighbours, edges are renamed,
    loops and doubles go, and so on until no edge is left. Ids are hashes, so a path, too, shrinks by
    a constant factor a round. Minima are combined before the shuffle; a hub's edges are only joined,
    never gathered. Each round is written to the shared folder.
    """
    live = staged(edges.select("a", "b").where("a <> b").distinct(), "edges")
    if live.isEmpty():
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    both = live.unionAll(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
    roots = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "roots")
    step = roots
    while True:
        to_a = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        to_b = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        renamed = live.join(to_a, "a").join(to_b, "b").where("ra <> rb")
        live = staged(renamed.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        if live.isEmpty():
            return roots
        both = live.unionAll(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "step")
        moved = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
        roots = staged(roots.join(moved, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")


def _verified(pairs: DataFrame, texts: DataFrame, verify: Verify) -> DataFrame:
    """The linked ones of pairs (node, hub), by both texts. The hub's text is met last, so a popular hub is sent once."""
    small_batches(pairs.sparkSession)
    one = pairs.hint("merge").join(texts.select("node", F.col("text").alias("x")), "node")
    two = one.hint("merge").join(texts.select(F.col("node").alias("hub"), F.col("text").alias("y")), "hub").select("node", "hub", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = verify(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            kept = batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns, names=["a", "b"])

    return two.mapInArrow(run, "a binary, b binary")


def _merged(roots: DataFrame, new: DataFrame) -> DataFrame:
    """Roots after new links: only the components that these touch are joined anew."""
    ends = new.select(F.col("a").alias("node")).unionAll(new.select(F.col("b").alias("node"))).distinct()
    fresh = ends.join(roots, "node", "left_anti").select("node", F.col("node").alias("root"))
    known = staged(roots.unionAll(fresh), "known")
    a = new.join(known.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
    both = a.join(known.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
    moved = components(both.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    moved = moved.select(F.col("node").alias("root"), F.col("root").alias("next"))
    return staged(known.join(moved, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")


def _block_links(band: int, left: list[dict], right: list[dict] | None, verify: Verify, possible: Possible | None) -> list[tuple[bytes, bytes]]:
    """Links that join the components of two blocks of a bucket (of one block, if right is None), after all their pairs were tried or joined.

    A pair that shares several open buckets is compared in the first of them.
    """
    other = left if right is None else right
    numbers: dict[bytes, int] = {}
    a, b = (np.array([numbers.setdefault(m["root"], len(numbers)) for m in side]) for side in (left, other))
    open_ = a[:, None] != b[None, :]
    if right is None:
        open_ = np.triu(open_)
    state = np.ones(open_.shape, np.uint8)
    if open_.any() and possible is not None:
        state = possible([m["text"] for m in left], [m["text"] for m in other])
        open_ &= state > 0
    parent = list(range(len(numbers)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, j in zip(*np.nonzero(open_)):
        x, y = root(a[i]), root(b[j])
        if x != y and min(set(left[i]["bands"]).intersection(other[j]["bands"])) == band and (state[i, j] == 2 or verify([left[i]["text"]], [other[j]["text"]])[0]):
            parent[x] = y
            out.append((left[i]["node"], other[j]["node"]))
    return out


def _rest_links(open_: DataFrame, texts: DataFrame, verify: Verify, possible: Possible | None) -> DataFrame:
    """Links between the components of each bucket, all its pairs compared but those within a component.

    open_: band, node and root of the members. They are dealt into blocks by hash: a component of BLOCK
    members or more of a bucket has blocks of its own, the others share theirs. A row is a pair of
    blocks, so a bucket of n members gives at most (n / BLOCK) ** 2 rows.
    """
    spark = open_.sparkSession
    size = F.octet_length("text").cast("long").alias("bytes")
    sized = staged(open_.join(texts.select("node", size), "node"), "sized")
    each = sized.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    each = each.withColumn("own", F.when(F.col("n") >= BLOCK, F.col("root")).otherwise(F.unhex(F.lit(""))))
    slots = each.groupBy("band", "own").agg(F.ceil(F.greatest(F.sum("n") / BLOCK, F.sum("bytes") / BLOCK_BYTES)).cast("long").alias("slots"))
    groups = each.select("band", "root", "own").join(slots, ["band", "own"])
    slot = F.pmod(F.xxhash64("node", "band"), F.col("slots"))
    placed = staged(sized.select("band", "node", "root").join(groups, ["band", "root"]).select("band", "node", "root", F.struct("own", slot.alias("slot")).alias("block")), "placed")
    shared = placed.groupBy("node").agg(F.collect_list("band").alias("bands"))
    full = placed.join(shared, "node").hint("merge").join(texts, "node")
    blocks = staged(full.groupBy("band", "block").agg(F.collect_list(F.struct("node", "root", "text", "bands")).alias("members")), "blocks")
    one = blocks.select("band", F.col("block").alias("x"))
    two = blocks.select("band", F.col("block").alias("y"))
    met = one.join(two, "band").where((F.col("x") <= F.col("y")) & ((F.col("x.own") != F.col("y.own")) | (F.col("x.own") == F.unhex(F.lit("")))))
    met = staged(met, "block-pairs")
    left = met.join(blocks.select("band", F.col("block").alias("x"), F.col("members").alias("left")).hint("merge"), ["band", "x"])
    right = blocks.select("band", F.col("block").alias("y"), F.col("members").alias("right")).hint("merge")
    both = left.where("x <> y").join(right, ["band", "y"]).select("band", "left", "right")
    both = both.unionAll(left.where("x = y").select("band", "left", F.lit(None).cast(right.schema["right"].dataType).alias("right")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                band, left, right = (batch.column(c)[i].as_py() for c in range(3))
                a, b = zip(*found) if (found := _block_links(band, left, right, verify, possible)) else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    spark.conf.set(rows, str(BLOCK_ROWS))
    try:
        return staged(both.mapInArrow(run, "a binary, b binary"), "links")
    finally:
        spark.conf.set(rows, before)


def linked_classes(bands: DataFrame, texts: DataFrame, verify: Verify, possible: Possible | None = None) -> DataFrame:
    """node and root of the items of the components of verified links; items of one component share a root.

    bands: (band, node), a row for each bucket of an item. texts: (node, text), any number of equal rows a node.
    possible: a test of all pairs of two lists of texts at once that rightly decides most of them.

    Any two members of a bucket that are linked come into one component. To spare comparisons, the
    members first meet one of them, its hub, drawn by hash; in buckets whose members then lie in
    different components, all pairs from different components are compared.
    """
    members = staged(bands.select("band", "node").distinct(), "bands")
    buckets = members.groupBy("band").agg(F.min_by("node", F.xxhash64("node", "band")).alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = staged(members.join(buckets, "band"), "members")
    wanted = members.select("node").distinct()
    one_each = texts.groupBy("node").agg(F.first("text").alias("text"))
    texts = staged(one_each.join(wanted, "node", "left_semi"), "texts")
    pairs = members.where("node <> hub").select(F.least("node", "hub").alias("node"), F.greatest("node", "hub").alias("hub")).distinct()
    roots = components(staged(_verified(pairs, texts, verify), "links"))
    # Two members have met as node and hub.
    named = members.where("n > 2").select("band", "node").join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    split = named.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band")
    open_ = staged(named.join(split, "band", "left_semi"), "open")
    if open_.isEmpty():
        return roots
    rest = _rest_links(open_, texts, verify, possible)
    return roots if rest.isEmpty() else _merged(roots, rest)
