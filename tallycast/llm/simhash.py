"""SimHash near-duplicates: links of all fingerprints that differ in few bits, found by tables of pivot distances.

A fingerprint is 64 majority votes over the hashes of a text's word shingles. Every different
fingerprint gets its Hamming distances to a fixed set of reference fingerprints, its pivots. By the
triangle inequality two fingerprints at distance d or less differ by d or less in every one of these
coordinates, so a pair with a larger difference is discarded, and only survivors are compared bit by bit.

Two kinds of pivots serve two steps. The first are one base pivot and the base with one block of two
bits turned over, for each block: the difference of a coordinate to that of the base depends on this block
alone. d differing bits lie in at most d blocks; if blocks are dealt into more than d groups, all
differences of some of these groups are equal. They are the key of a bucket, so a pair that shares no
bucket is discarded unseen. The second are scattered pivots, whose largest coordinate difference
discards pairs inside a bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.llm.common import join_on_hot_key, small_batches, staged
from tallycast.llm.graph import components

SHINGLE = 4
SEED = 42
#: Fingerprints that differ in at most so many bits are linked.
DISTANCE = 4
BITS, BLOCK_BITS = 64, 2
BLOCKS = BITS // BLOCK_BITS
#: Chance that two random fingerprints have an equal difference in a block of two bits.
SAME = 0.375
#: Scattered pivots, and how many of them test whole blocks of pairs before single pairs are picked out.
SCATTERED, FIRST = 16, 4
#: Members of a bucket that one comparison takes; larger buckets are compared slot by slot.
SLOT = 8192
#: Pairs and shingles of one array step.
STEP_PAIRS, STEP_SHINGLES = 1 << 22, 1 << 16
#: Seconds for a row of a bucket and for a pair in it, roughly; they only choose the number of groups.
ROW_COST, PAIR_COST = 3e-6, 4e-9


def _pivots() -> tuple[np.ndarray, np.ndarray]:
    """The base pivot with its turned blocks, and the scattered pivots."""
    drawn = [xxhash.xxh64_intdigest(f"pivot {i}", SEED) for i in range(SCATTERED + 1)]
    turned = [drawn[0] ^ (((1 << BLOCK_BITS) - 1) << (BLOCK_BITS * j)) for j in range(BLOCKS)]
    return np.array([drawn[0], *turned], np.uint64), np.array(drawn[1:], np.uint64)


BASE, SPREAD = _pivots()


def distances(fingerprints: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Table of Hamming distances: a row for each fingerprint, a column for each pivot."""
    return np.bitwise_count(fingerprints[:, None] ^ pivots[None, :]).astype(np.int8)


def fingerprint(text: bytes) -> int:
    """SimHash of a text in UTF-8; zero if it has no word."""
    words = text.lower().split()  # of bytes: lower-cases A-Z alone, splits at space and the codes 9 to 13
    if not words:
        return 0
    joined = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate(([0], end[:-1] + 1))
    n = max(len(words) - SHINGLE + 1, 1)
    votes = np.zeros(BITS, np.int64)
    for a in range(0, n, STEP_SHINGLES):
        b = min(a + STEP_SHINGLES, n)
        ends = end[min(SHINGLE, len(words)) - 1 :][a:b]
        hashes = [xxhash.xxh64_intdigest(joined[x:y], SEED) for x, y in zip(start[a:b].tolist(), ends.tolist())]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(votes * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id (long) and fingerprint (long, the 64 bits) of every row; a null text counts as empty."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, "doc_id long, fingerprint long")


def groups_for(different: int, distance: int = DISTANCE) -> int:
    """Number of groups of blocks with the least estimated work; any number over `distance` finds all links."""

    def work(groups: int) -> float:
        keys = math.comb(groups, distance)
        chance = SAME ** (BLOCKS * (groups - distance) / groups)
        return keys * different * (ROW_COST + different / 2 * chance * PAIR_COST)

    return min(range(distance + 1, min(BLOCKS, distance + 9)), key=work)


def bucket_keys(fingerprints: np.ndarray, groups: int, distance: int = DISTANCE) -> np.ndarray:
    """Keys of the buckets of each fingerprint, one for each choice of groups that may be equal."""
    table = distances(fingerprints, BASE).astype(np.int64)
    turned = (table[:, :1] - table[:, 1:] + BLOCK_BITS) // 2 * 3 ** np.arange(BLOCKS, dtype=np.int64)
    each = np.stack([turned[:, g::groups].sum(1) for g in range(groups)], axis=1)
    return np.stack([each[:, list(c)].sum(1) for c in combinations(range(groups), groups - distance)], axis=1)


def joined(values: np.ndarray, side: np.ndarray | None = None, distance: int = DISTANCE) -> np.ndarray:
    """For each of a bucket's fingerprints the place of one in the same component of links inside the bucket.

    side: if given, only pairs of different sides are compared.
    """
    n = len(values)
    table = distances(values, SPREAD)
    root = np.arange(n)
    step = max(1, STEP_PAIRS // max(n, 1))
    for a in range(0, n, step):
        b = min(a + step, n)
        open_ = root[a:b, None] != root[None, a:]
        if side is not None:
            open_ &= side[a:b, None] != side[None, a:]
        for k in range(FIRST):
            open_ &= np.abs(table[a:b, k, None] - table[None, a:, k]) <= distance
        i, j = np.nonzero(open_)
        i, j = i[i < j] + a, j[i < j] + a
        near = np.abs(table[i, FIRST:] - table[j, FIRST:]).max(1, initial=0) <= distance
        i, j = i[near], j[near]
        near = np.bitwise_count(values[i] ^ values[j]) <= distance
        i, j = i[near], j[near]
        while len(i):
            x, y = root[i], root[j]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
            apart = root[i] != root[j]
            i, j = i[apart], j[apart]
    return root


def links(nodes: DataFrame, different: int, distance: int = DISTANCE) -> DataFrame:
    """(a, b): pairs of fingerprints in one component, enough to join all that differ in `distance` bits or less.

    nodes: a row for each of the `different` fingerprints. Members of a bucket of more than SLOT are dealt
    into slots by hash, and pairs of slots are compared, so no task holds more than two slots of a bucket.
    """
    spark = nodes.sparkSession
    groups = groups_for(different, distance)
    choices = math.comb(groups, distance)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            keys = bucket_keys(values.view(np.uint64), groups, distance)
            choice = np.tile(np.arange(choices, dtype=np.int32), len(values))
            yield pa.RecordBatch.from_arrays([pa.array(choice), pa.array(keys.ravel()), pa.array(np.repeat(values, choices))], names=["choice", "key", "node"])

    members = nodes.select("fingerprint").mapInArrow(spread, "choice int, key long, node long")
    members = staged(members, "buckets")
    large = members.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SLOT)
    large = staged(large.select("choice", "key", F.ceil(F.col("n") / SLOT).cast("int").alias("slots")), "large")
    slots = F.coalesce("slots", F.lit(1))
    dealt = members.join(large, ["choice", "key"], "left").withColumn("slot", F.pmod(F.xxhash64("node"), slots).cast("int"))
    other = F.explode(F.sequence(F.lit(0), slots - 1)).alias("other")
    met = dealt.select("choice", "key", "node", "slot", other).withColumns({"x": F.least("slot", "other"), "y": F.greatest("slot", "other")})
    rows = met.groupBy("choice", "key", "x", "y").agg(F.collect_list(F.struct("node", "slot")).alias("members")).where(F.size("members") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for values, sides in zip(batch.column(0), batch.column(1)):
                values, sides = (np.asarray(x.values) for x in (values, sides))
                root = joined(values.view(np.uint64), sides if sides.min() < sides.max() else None, distance)
                moved = np.flatnonzero(root != np.arange(len(root)))
                a.append(values[moved])
                b.append(values[root[moved]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    small_batches(spark)
    return rows.select("members.node", "members.slot").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of docs (doc_id, text).

    fingerprint: 16 hexadecimal digits. component_id: the least doc_id of the component of links of
    fingerprints that differ in at most `distance` bits; null ids do not count for it, and it is null where a
    component has no other. Null texts count as empty; texts without words have fingerprint zero and
    are linked like any other. Repeated rows stay, other columns are ignored, an empty table gives none.
    """
    rows = staged(fingerprints(docs), "fingerprints")
    nodes = rows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("first"))
    nodes = staged(nodes, "nodes")
    roots = components(links(nodes, nodes.count(), distance)).withColumnRenamed("node", "fingerprint")
    rooted = staged(nodes.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint")), "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("nodes"))
    named = join_on_hot_key(rooted, staged(least, "classes"), "root", "nodes", rooted.count()).select("fingerprint", "rows", "component_id")
    got = join_on_hot_key(rows, staged(named, "named"), "fingerprint", "rows", rows.count())
    return got.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
