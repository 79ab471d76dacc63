"""Token-id files: raw ids in shards, and per shard a minimal perfect hash index over document keys.

A shard is two files. `<shard>.bin` holds the ids of its documents one after the other, as raw
little-endian unsigned integers (16 bits if the vocabulary allows, else 32). `<shard>.idx` holds
one line of JSON (names, types and sizes of the arrays) and then the arrays themselves:

    words, ranks, levels   the hash function: bit vectors of its levels with running bit counts
    finger                 by slot: 32-bit fingerprint of the key
    first, copies          by slot: number of the first document of the key, and how many it has
    offset                 by document number: where its ids begin in the .bin file (one more at the end)
    keys                   by document number: the key, for listings and audits

A key's slot costs a few hash evaluations, whatever the shard's size; a key that is not in the
shard is refused by its fingerprint (a false match has probability 2**-32). A look-up reads the
line of JSON, the few numbers of the index that the key leads to, and the ids themselves.

Documents lie in the order of doc_id and, within one, of a hash of the text, so a doc_id with very
many rows goes on in the next shards.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallycast.llm.bpe import ids_of_texts
from tallycast.llm.common import partitions, small_batches, staged
from tallycast.llm.words import mix

END_ID = 0
SHARD_BYTES = 64 << 20
GAMMA = 2.0
#: What stands for a blank in the names of byte-level tokens (a fixed value).
BLANK = "\u0120"
#: New words encoded in a row.
WORDS = 256
#: The line of JSON at the head of an index is shorter than this.
HEAD_BYTES = 4096
MANIFEST = "part int, piece int, shard string, docs long, tokens long, least long, most long"


def _hash(keys: np.ndarray, level: int) -> np.ndarray:
    return mix(keys.astype(np.uint64) ^ np.uint64((level * 0x9E3779B97F4A7C15 + 0x1234567) & (2**64 - 1)))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


def build_hash(keys: np.ndarray) -> dict[str, np.ndarray]:
    """Minimal perfect hash of distinct 64-bit keys.

    Each level is a bit vector; keys that alone hash to a bit set it, all others go on to the next
    level. The slot of a key is the number of bits set before its own, so slots are 0 to n - 1.
    """
    words, sizes = [], []
    rest, level = keys, 0
    while len(rest):
        size = -(-max(64, int(GAMMA * len(rest))) // 64) * 64
        at = (_hash(rest, level) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size)[at] == 1
        bits = np.zeros(size, np.uint8)
        bits[at[alone]] = 1
        words.append(np.packbits(bits, bitorder="little").view("<u8"))
        sizes.append(size)
        rest, level = rest[~alone], level + 1
    flat = np.concatenate(words) if words else np.zeros(0, "<u8")
    ones = np.bitwise_count(flat).astype(np.int64)
    return {"words": flat, "ranks": np.concatenate(([0], np.cumsum(ones)))[:-1].astype("<i8"), "levels": np.array(sizes, "<i8")}


def slots_of(h: dict[str, Stored | np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Slot of each key; -1 for keys that surely are not in the set."""
    out = np.full(len(keys), -1, np.int64)
    rest, base = np.arange(len(keys)), 0
    for level, size in enumerate(h["levels"].tolist()):
        at = (_hash(keys[rest], level) % np.uint64(size)).astype(np.int64) + base
        word, bit = h["words"][at >> 6], (at & 63).astype(np.uint64)
        hit = (word >> bit) & np.uint64(1) == 1
        before = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
        out[rest[hit]] = h["ranks"][at[hit] >> 6] + before[hit]
        rest, base = rest[~hit], base + size
    return out


def build_index(keys: list[int | None], counts: list[int]) -> dict[str, np.ndarray]:
    """Index arrays of documents in file order, copies of a key adjacent; null keys get no slot."""
    known = np.array([k is not None for k in keys], bool)
    ids = np.array([0 if k is None else k for k in keys], np.int64)
    number = np.flatnonzero(known)
    distinct, first, copies = np.unique(ids[number], return_index=True, return_counts=True)
    h = build_hash(distinct)
    slot = slots_of(h, distinct)
    by_slot = np.argsort(slot)
    return h | {
        "finger": fingerprint(distinct)[by_slot].astype("<u4"),
        "first": number[first][by_slot].astype("<i8") if len(number) else np.zeros(0, "<i8"),
        "copies": copies[by_slot].astype("<i8"),
        "offset": np.concatenate(([0], np.cumsum(counts))).astype("<i8"),
        "keys": ids.astype("<i8"),
        "known": known,
    }


def pack_index(arrays: dict[str, np.ndarray], width: int) -> bytes:
    head = json.dumps({"width": width, "arrays": [[n, a.dtype.str, len(a)] for n, a in arrays.items()]}).encode() + b"\n"
    return head + b"".join(a.tobytes() for a in arrays.values())


class Stored:
    """An array in an open file; only the elements asked for are read."""

    def __init__(self, source, kind: str, n: int, at: int):
        self.source, self.kind, self.n, self.at = source, np.dtype(kind), n, at

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, places: np.ndarray) -> np.ndarray:
        size = self.kind.itemsize
        raw = b"".join(self.source.read_at(size, self.at + i * size) for i in places.tolist())
        return np.frombuffer(raw, self.kind)

    def all(self) -> np.ndarray:
        return np.frombuffer(self.source.read_at(self.n * self.kind.itemsize, self.at), self.kind)


def stored_index(source) -> tuple[dict[str, Stored | np.ndarray], int]:
    """Arrays of an index file, of which only the sizes of the levels are read, and the bytes of an id."""
    line = source.read_at(min(HEAD_BYTES, source.size()), 0)
    at = line.index(b"\n") + 1
    head, out = json.loads(line[:at]), {}
    for name, kind, n in head["arrays"]:
        out[name] = Stored(source, kind, n, at)
        at += n * out[name].kind.itemsize
    return out | {"levels": out["levels"].all()}, head["width"]


def find(index: dict[str, Stored | np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First document number and number of copies of each key; copies are 0 for keys not in the shard."""
    slot = slots_of(index, keys)
    safe = np.maximum(slot, 0)
    if not len(index["finger"]):
        return safe, np.zeros(len(keys), np.int64)
    hit = (slot >= 0) & (index["finger"][safe] == fingerprint(keys))
    return index["first"][safe], np.where(hit, index["copies"][safe], 0)


@lru_cache(2)
def tokenizer_of(path: str):
    """The byte-level tokenizer, whether each of its ids begins with a blank, a cache, and the bytes of an id."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    vocabulary = t.get_vocab()
    blank = np.zeros(max(vocabulary.values()) + 1, bool)
    blank[[i for token, i in vocabulary.items() if token[0] == BLANK]] = True
    return t, blank, {}, 2 if t.get_vocab_size() <= 1 << 16 else 4


def _encode_new(tokenizer, blank: np.ndarray, width: int, pieces: list[str]) -> dict[str, bytes]:
    """Ids of each piece. Words behind a blank are encoded many in a row: each begins at the next id with a blank."""
    words, others = [], []
    for p in pieces:
        (words if p[0] == " " and p[1:].isalpha() else others).append(p)
    rows = [words[i : i + WORDS] for i in range(0, len(words), WORDS)] + [[p] for p in others]
    out: dict[str, bytes] = {}
    for row, coded in zip(rows, tokenizer.encode_batch_fast(list(map("".join, rows)), add_special_tokens=False)):
        ids = np.array(coded.ids, f"<u{width}")
        raw = ids.tobytes()
        if len(row) == 1:
            out[row[0]] = raw
            continue
        cut = (np.append(np.flatnonzero(blank[ids]), len(ids)) * width).tolist()
        out.update(zip(row, [raw[a:b] for a, b in zip(cut, cut[1:])], strict=True))
    return out


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


class _Shard:
    """One shard being written: ids go straight to a file that gets its name when it is whole."""

    def __init__(self, folder: str, part: int, piece: int, width: int):
        self.store, root = _place(folder)
        self.name, self.part, self.piece, self.width = f"{part:06d}-{piece:04d}", part, piece, width
        self.path = f"{root}/{self.name}"
        self.mark = f".attempt-{TaskContext.get().taskAttemptId()}"
        self.out = self.store.open_output_stream(f"{self.path}.bin{self.mark}")
        self.keys: list[int | None] = []
        self.counts: list[int] = []
        self.bytes = 0

    def add(self, key: int | None, ids: bytes) -> None:
        self.out.write(ids)
        self.keys.append(key)
        self.counts.append(len(ids) // self.width)
        self.bytes += len(ids)

    def close(self) -> dict:
        self.out.close()
        with self.store.open_output_stream(f"{self.path}.idx{self.mark}") as f:
            f.write(pack_index(build_index(self.keys, self.counts), self.width))
        for end in ("bin", "idx"):  # a retried task replaces what it wrote before with the same bytes
            self.store.move(f"{self.path}.{end}{self.mark}", f"{self.path}.{end}")
        known = [k for k in self.keys if k is not None]
        return {"part": self.part, "piece": self.piece, "shard": self.name, "docs": len(self.keys), "tokens": sum(self.counts), "least": min(known, default=None), "most": max(known, default=None)}


def _write(folder: str, tokenizer_path: str, end_id: int, shard_bytes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokenizer, blank, cache, width = tokenizer_of(tokenizer_path)
    end = np.array([end_id], f"<u{width}").tobytes()
    part, rows, shard = TaskContext.get().partitionId(), [], None
    for batch in batches:
        keys, texts = batch.column(0).to_pylist(), batch.column(1).fill_null("").to_pylist()
        for key, ids in zip(keys, ids_of_texts(texts, cache, partial(_encode_new, tokenizer, blank, width))):
            if shard and shard.bytes >= shard_bytes:
                rows.append(shard.close())
                shard = None
            shard = shard or _Shard(folder, part, len(rows), width)
            shard.add(key, ids + end)
    if shard:
        rows.append(shard.close())
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    yield pa.RecordBatch.from_pylist(rows, pa.schema([(n, kinds[k]) for n, k in (c.split() for c in MANIFEST.split(", "))]))


def write(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode every whole text, append end_id, and write shards in ascending doc_id order; returns their manifest.

    The manifest has one row a shard with `start`, the number of ids in all shards before it. Null
    texts count as empty; null doc_ids come first and can be listed but not looked up; rows of one
    doc_id follow one another, through several shards if need be; other columns are ignored; an
    empty table writes no file.
    """
    spark = docs.sparkSession
    small_batches(spark)
    store, root = _place(folder)
    store.create_dir(root, recursive=True)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    order = F.col("doc_id").asc_nulls_first(), F.xxhash64("text")
    ordered = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order, "text")
    made = staged(ordered.mapInArrow(partial(_write, folder, tokenizer_path, end_id, shard_bytes), MANIFEST), "manifest")
    before = F.sum("tokens").over(Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1))  # one row a shard
    return made.withColumn("start", F.coalesce(before, F.lit(0)))


def _ids_at(source, index, width: int, number: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Offset and ids of documents by their numbers."""
    for a, b in zip(index["offset"][number].tolist(), index["offset"][number + 1].tolist()):
        yield a, np.frombuffer(source.read_at((b - a) * width, a * width), f"<u{width}")


READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])


def _rows(found: list[tuple[int | None, int, np.ndarray]]) -> pa.RecordBatch:
    k, s, ids = zip(*found) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(s, pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())], schema=READ)


def _read(folder: str, shard: str, start: int, keys: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Documents of a shard by the keys given, each at the offsets that the index returns for it; of all its keys and those without one, if None."""
    store, root = _place(folder)
    with store.open_input_file(f"{root}/{shard}.idx") as idx, store.open_input_file(f"{root}/{shard}.bin") as source:
        index, width = stored_index(idx)
        wanted: list[tuple[int | None, int]] = []
        if keys is None:
            index = {n: a.all() if isinstance(a, Stored) else a for n, a in index.items()}
            known = index["known"].astype(bool)
            keys = np.unique(index["keys"][known])
            wanted = [(None, i) for i in np.flatnonzero(~known).tolist()]
            if (find(index, keys)[1] == 0).any():
                raise ValueError(f"index of shard {shard} misses one of its keys")
        first, copies = find(index, keys)
        wanted += [(key, i) for key, a, n in zip(keys.tolist(), first.tolist(), copies.tolist()) for i in range(a, a + n)]
        for a in range(0, len(wanted), 256):
            part = wanted[a : a + 256]
            found = _ids_at(source, index, width, np.array([i for _, i in part], np.int64))
            yield _rows([(key, start + at, ids) for (key, _), (at, ids) in zip(part, found)])


def _list_shards(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, start in zip(batch.column("shard").to_pylist(), batch.column("start").to_pylist()):
            yield from _read(folder, shard, start, None)


def read_all(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start and ids (unsigned 32-bit, little-endian) of every document, read from the files.

    Each key of a shard is looked up through its index, and its ids are read at the offsets found
    there; a key that its index misses raises. Documents without a key are read by their numbers.
    """
    small_batches(manifest.sparkSession)
    shards = manifest.select("shard", "start").repartition(partitions(manifest.sparkSession), "shard")
    return shards.mapInArrow(partial(_list_shards, folder), "doc_id long, start long, ids binary")


def _route(shards: list[tuple[str, int, int, int]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, starts = pa.array([s[0] for s in shards], pa.string()), pa.array([s[1] for s in shards], pa.int64())
    least, most = (np.array([s[i] for s in shards], np.int64) for i in (2, 3))
    for batch in batches:
        keys = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
        low = np.searchsorted(most, keys, "left")
        n = np.maximum(np.searchsorted(least, keys, "right") - low, 0)
        at = pa.array(np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum()))
        yield pa.RecordBatch.from_arrays([names.take(at), starts.take(at), pa.array(np.repeat(keys, n), pa.int64())], names=["shard", "start", "doc_id"])


def _look_up(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for (shard, start), rows in groupby(zip(*(c.to_pylist() for c in batch.columns)), key=lambda r: r[:2]):
            yield from _read(folder, shard, start, np.array([key for *_, key in rows], np.int64))


def look_up(keys: DataFrame, manifest: DataFrame, folder: str) -> DataFrame:
    """Documents with the given doc_ids, each found through the indexes of the shards that may hold it.

    That is one shard, unless rows of one doc_id fill several. The driver holds one row a shard
    (64 MB of ids each). Null and unknown keys give no row; repeated ones count once.
    """
    spark = keys.sparkSession
    small_batches(spark)
    shards = manifest.where("least is not null").orderBy("part", "piece").select("shard", "start", "least", "most").collect()
    if not shards:
        return spark.createDataFrame([], "doc_id long, start long, ids binary")
    routed = keys.select(F.col("doc_id").cast("long")).distinct().mapInArrow(partial(_route, [tuple(r) for r in shards]), "shard string, start long, doc_id long")
    near = routed.repartition(partitions(spark), "shard").sortWithinPartitions("shard", "doc_id")
    return near.mapInArrow(partial(_look_up, folder), "doc_id long, start long, ids binary")
