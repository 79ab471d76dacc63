"""Prefix trie of conversations by whole-sequence collapse.

Each conversation is rebuilt as a sequence of turns, a turn being known by a digest of role and text.
Identical sequences collapse into one weighted sequence with the list of the conversations that end
there. Sequences that are proper prefixes of others go in an anti-join; the rest are the leaves. What
a node of the trie holds is a sum over the weighted sequences that start with it, so one row for each
prefix of a distinct sequence is enough, and no tree is ever gathered.

Sums over subtrees need no pairs of nodes with their ancestors. Every node belongs to the least leaf
below it, so a leaf owns the lower end of its own path. The subtree of a node then holds all that the
other leaves below it own, and of its own leaf's path what lies at its depth or deeper.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallycast.llm.checksums import crc32_sql
from tallycast.llm.common import join_on_hot_key, small_batches, staged

#: A conversation takes its first turns from the first of its block of BLOCK ids, fewer than HEADS of them.
BLOCK, HEADS = 5, 9
#: Ids of a piece of an end list are equal but for so many low bits.
PIECE_BITS = 16
EMPTY = hashlib.sha256(b"").hexdigest()
ROOT = b""


def head_turns(conv_id: str = "conv_id") -> Column:
    """How many turns a conversation takes from the head of its block."""
    return (F.crc32(F.col(conv_id).cast("string").cast("binary")) % HEADS).cast("int")


def _sequences(conversations: DataFrame) -> DataFrame:
    """conv_id and its original turns in order: an array of (key, bytes)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    framed = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turn = F.col("turn").cast("long")
    known = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            turn.isNotNull().alias("known"), F.coalesce(turn, F.lit(0)).alias("turn"), role.alias("role"),
            F.unhex(F.md5(framed.cast("binary"))).alias("key"), F.octet_length(text).alias("bytes"),
        ).alias("turn"),
    )
    ordered = known.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return ordered.select("conv_id", F.transform("turns", lambda t: F.struct(t["key"].alias("key"), t["bytes"].alias("bytes"))).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id and its rebuilt turns, an array of (key, bytes), for every id that is not null.

    The first h turns come from conversation conv_id - conv_id % 5 (all if it has fewer, none if absent),
    the rest are the conversation's own after its first h, with h = crc32(decimal conv_id) % 9. Turns stand
    by number, nulls first, then by role and digest; null role or text is empty; repeated rows all count.
    Rows without conv_id belong to no conversation. A conversation's turns are held in one row, 40 bytes a turn.
    """
    own = staged(_sequences(conversations), "sequences")
    head = own.select(F.col("conv_id").alias("head_id"), F.slice("turns", 1, HEADS - 1).alias("head"))
    both = own.withColumn("head_id", F.expr(f"conv_id - conv_id % {BLOCK}")).join(head, "head_id", "left")
    n = head_turns()
    first = F.when(F.col("head").isNull(), F.array().cast(own.schema["turns"].dataType)).otherwise(F.slice("head", F.lit(1), n))
    rest = F.slice("turns", n + 1, F.greatest(F.size("turns") - n, F.lit(0)))
    return both.select("conv_id", F.concat(first, rest).alias("turns"))


def _collapsed(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sequence, turns, n, first, node): the distinct sequences; and (sequence, conv_id) of every conversation."""
    keys = F.transform("turns", lambda t: F.hex(t["key"]))
    rows = staged(rebuilt(conversations).withColumn("sequence", F.unhex(F.md5(F.array_join(keys, "").cast("binary")))), "rebuilt")
    return rows.groupBy("sequence").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first"), F.first("turns").alias("turns")), rows.select("sequence", "conv_id")


def _end_lists(members: DataFrame) -> DataFrame:
    """sequence and the SHA-256 of its conversation ids, ascending and comma-joined.

    Ids are joined into pieces of at most 2**PIECE_BITS ids; the pieces of a sequence pass one hash in order.
    """
    small_batches(members.sparkSession)
    pieces = members.groupBy("sequence", F.shiftright("conv_id", PIECE_BITS).alias("piece")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    pieces = pieces.select("sequence", "piece", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    ordered = pieces.repartition("sequence").sortWithinPartitions("sequence", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, held = None, None
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for s, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if s == sequence:
                    held.update(b"," + ids.encode())
                    continue
                if held is not None:
                    done.append((sequence, held.hexdigest()))
                sequence, held = s, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string())], names=["sequence", "ends_sha256"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([sequence], pa.binary()), pa.array([held.hexdigest()])], names=["sequence", "ends_sha256"])

    return ordered.select("sequence", "ids").mapInArrow(run, "sequence binary, ends_sha256 string")


def _prefixes(sequences: DataFrame) -> DataFrame:
    """A row for every prefix of every distinct sequence: sequence, n, first, length, depth, node, parent, bytes.

    A node is a chain of digests: that of its parent and the key of its last turn; the root is empty bytes.
    """
    small_batches(sequences.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, depth, node, parent, size = [], [], [], [], []
            for i, turns in enumerate(batch.column(1).to_pylist()):
                last = ROOT
                at.append(i), depth.append(0), node.append(ROOT), parent.append(None), size.append(0)
                for d, t in enumerate(turns, 1):
                    parent.append(last)
                    last = hashlib.md5(last + t["key"]).digest()
                    at.append(i), depth.append(d), node.append(last), size.append(t["bytes"])
            at = pa.array(at, pa.int64())
            length = pa.array([len(t) for t in batch.column(1)], pa.int64())
            kept = [c.take(at) for c in (batch.column(0), batch.column(2), batch.column(3), length)]
            new = [pa.array(depth, pa.int64()), pa.array(node, pa.binary()), pa.array(parent, pa.binary()), pa.array(size, pa.int64())]
            yield pa.RecordBatch.from_arrays([*kept, *new], names=["sequence", "n", "first", "length", "depth", "node", "parent", "bytes"])

    schema = "sequence binary, n long, first long, length long, depth long, node binary, parent binary, bytes long"
    return sequences.select("sequence", "turns", "n", "first").mapInArrow(run, schema)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt conversations (see rebuilt), one row a node.

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens (over the subtree, each node's n_convs - 1 times the bytes of its last text) and ends_sha256
    (of the members that end here). Other columns are ignored; an empty table gives no node.
    """
    sequences, members = _collapsed(conversations)
    paths = staged(_prefixes(sequences), "prefixes")
    ends = paths.where("depth = length").select("sequence", "node")
    inner = paths.where("parent is not null").select(F.col("parent").alias("node")).distinct()
    leaves = ends.join(inner, "node", "left_anti").select("sequence", F.lit(1).alias("leaf"))
    marked = staged(paths.join(leaves, "sequence", "left"), "marked")

    total = {
        "n_convs": F.sum("n"), "conv_id": F.min("first"), "rows": F.count(F.lit(1)), "n_leaves": F.sum(F.coalesce("leaf", F.lit(0)).cast("long")),
        "owner": F.min(F.when(F.col("leaf") == 1, F.col("sequence"))),
    }
    nodes = staged(marked.groupBy("node", "depth", "parent", "bytes").agg(*[e.alias(c) for c, e in total.items()]), "nodes")
    worth = nodes.select("node", "rows", "owner", ((F.col("n_convs") - 1) * F.col("bytes")).alias("worth"))

    of_leaves = marked.where("leaf = 1").select("sequence", "depth", "node")
    met = staged(join_on_hot_key(of_leaves, worth, "node", "rows", marked.count()).withColumn("own", F.col("owner") == F.col("sequence")), "paths")
    below = Window.partitionBy("sequence").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tails = met.where("own").withColumn("tail", F.sum("worth").over(below))
    owned = met.where("own").groupBy("sequence").agg(F.sum("worth").alias("owned"))
    others = met.where("not own").select("sequence", "node").join(owned, "sequence").select("node", F.col("owned").alias("part"))
    saved = tails.select("node", F.col("tail").alias("part")).unionAll(others).groupBy("node").agg(F.sum("part").alias("saved_tokens"))

    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    listed = ends.join(_end_lists(members), "sequence").select("node", "ends_sha256")
    whole = nodes.join(saved, "node").join(children, "node", "left").join(listed, "node", "left")
    whole = staged(whole.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "whole")
    up = whole.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    inside = whole.where("parent is not null").drop("n_children").join(whole.select("node", "n_children"), "node")
    inside = join_on_hot_key(inside, up.withColumnRenamed("n_children", "fan"), "parent", "fan", whole.count())
    top = whole.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")]
    return inside.select(*columns).unionAll(top.select(*columns))


#: The same trie from lists of turns: a node is a digest of the list of its turns' digests.
ORACLE = f"""
with turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), md5(framed)) as pos, md5(framed) as key, bytes
  from (select conv_id, turn, role, coalesce(strlen(role), 0) || ':' || coalesce(role, '') || coalesce(text, '') as framed, coalesce(strlen(text), 0) as bytes
    from conversations where conv_id is not null)),
ids as (select conv_id, {crc32_sql("cast(conv_id as varchar)")} % {HEADS} as h from (select distinct conv_id from turns)),
taken as (
  select ids.conv_id, 0 as part, pos, key, bytes from ids join turns on turns.conv_id = ids.conv_id - ids.conv_id % {BLOCK} where pos <= h
  union all select conv_id, 1, pos, key, bytes from ids join turns using (conv_id) where pos > h),
seqs as (select conv_id, list(key order by part, pos) as keys, list(bytes order by part, pos) as sizes from taken group by conv_id),
whole as (select ids.conv_id, coalesce(keys, []) as keys, coalesce(sizes, []) as sizes from ids left join seqs using (conv_id)),
steps as (
  select conv_id, d as depth, len(keys) = d as ends, md5(array_to_string(keys[1:d], ',')) as node,
    case when d > 0 then md5(array_to_string(keys[1:d - 1], ',')) end as parent, case when d > 0 then sizes[d] else 0 end as bytes
  from (select *, unnest(range(len(keys) + 1)) as d from whole)),
nodes as (
  select node, depth, any_value(parent) as parent, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * any_value(bytes) as worth,
    sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (ends), '')) as ends_sha256
  from steps group by node, depth),
fans as (select parent as node, count(*) as n_children from nodes where parent is not null group by parent),
under as (select distinct a.node as top, a.depth as top_depth, b.node, b.depth from steps a join steps b on a.conv_id = b.conv_id and b.depth >= a.depth),
sums as (
  select top as node, top_depth as depth, sum(worth) as saved_tokens, count(*) filter (n_children is null) as n_leaves
  from under join nodes using (node, depth) left join fans using (node) group by top, top_depth)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(n_children, 0) as n_children, n_leaves, cast(saved_tokens as bigint) as saved_tokens, n.ends_sha256
from nodes n join sums using (node, depth) left join fans using (node) left join nodes p on p.node = n.parent and p.depth = n.depth - 1
"""
