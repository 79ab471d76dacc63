"""Byte-level BPE over pre-tokens: cached pair merging, and decoding by stored token offsets.

Pre-tokens come from array scans (pretokens.py). A bounded cache maps a pre-token to its ids; the
pre-tokens of a step that are not in it are merged together, all at once: in each round every
piece merges its leftmost pair of lowest rank. Pieces too long for that use a heap.
"""

from __future__ import annotations

import base64
import heapq
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress, count, repeat
from operator import is_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.llm.common import caches_of, emptied_between_operators, small_batches
from tallycast.llm.pretokens import pretokens

#: Pre-tokens held by one worker's cache, and the longest one held: memory stays bounded.
CACHE_PIECES = 600_000
CACHE_CHARS = 32
#: Widths in bytes of the arrays whose rows are pieces; longer pieces are merged by a heap.
WIDTHS = (4, 7, 10, 14, 20, 32)
#: Pieces that meet the cache together.
STEP_PIECES = 400_000
NONE = np.int32(2**31 - 1)
#: Slots of the pair table, a power of two.
TABLE = 1 << 20


def _slot(key: np.ndarray) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


class Ranks:
    """Vocabulary of a rank file: token bytes by id, byte offsets for decoding, and the mergeable pairs."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(ranks.values()) + 1
        self.tokens = [b""] * self.size
        for token, i in ranks.items():
            self.tokens[i] = token
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.offset = np.concatenate(([0], np.cumsum([len(t) for t in self.tokens])))
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = {(ranks[t[:k]], ranks[t[k:]]): i for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.table_keys, self.table_ranks = self._table()
        self.cache: dict[str, bytes] = {}

    def _table(self) -> tuple[np.ndarray, np.ndarray]:
        """Open-addressing table of the pairs, so that a whole array of pairs is looked up at once."""
        keys = np.array([a * self.size + b for a, b in self.pairs], np.int64)
        ranks = np.array(list(self.pairs.values()), np.int32)
        slots_keys, slots_ranks = np.full(TABLE, -1, np.int64), np.full(TABLE, NONE, np.int32)
        at, todo = _slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[slots_keys[at[todo]] == -1]
            _, one = np.unique(at[free], return_index=True)
            free = free[one]
            slots_keys[at[free]], slots_ranks[at[free]] = keys[free], ranks[free]
            todo = todo[slots_keys[at[todo]] != keys[todo]]
            at[todo] = (at[todo] + 1) & (TABLE - 1)
        return slots_keys, slots_ranks

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = _slot(key)
        found = self.table_keys[at]
        out = self.table_ranks[at]
        other = np.flatnonzero((found != key) & (found != -1))
        out[other] = NONE
        while len(other):
            at[other] = (at[other] + 1) & (TABLE - 1)
            found = self.table_keys[at[other]]
            hit = other[found == key[other]]
            out[hit] = self.table_ranks[at[hit]]
            other = other[(found != key[other]) & (found != -1)]
        return out

    def merge_rows(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of pieces of about the same, small length."""
        m = len(pieces)
        size = np.fromiter(map(len, pieces), np.int32, m)
        width = int(size.max())
        columns = np.arange(width, dtype=np.int32)
        inside = columns < size[:, None]
        grid, rank = np.zeros((m, width), np.int32), np.full((m, width), NONE, np.int32)
        grid[inside] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        both = inside[:, 1:]
        rank[:, :-1][both] = self.rank_of(grid[:, :-1][both], grid[:, 1:][both])
        out, count, live = np.zeros((m, width), "<u4"), size.copy(), np.arange(m)
        for used in range(width, 0, -1):  # columns in use shrink by one a round
            at = rank.argmin(1).astype(np.int32)
            best = rank[np.arange(len(live)), at]
            done = best == NONE
            if done.any():
                out[live[done], :used] = grid[done]
                count[live[done]] = size[done]
                keep = ~done
                live, at, best, grid, rank, size = live[keep], at[keep], best[keep], grid[keep], rank[keep], size[keep]
            if not len(live):
                break
            size = size - 1
            later = columns[: used - 1] > at[:, None]
            grid = np.where(later, grid[:, 1:], grid[:, :-1])
            rank = np.where(later, rank[:, 1:], rank[:, :-1])
            grid[np.arange(len(live)), at] = best
            rank[np.arange(len(live)), at] = NONE
            right = np.flatnonzero(at + 1 < size)
            left = np.flatnonzero(at > 0)
            new = self.rank_of(np.concatenate((best[right], grid[left, at[left] - 1])), np.concatenate((grid[right, at[right] + 1], best[left])))
            rank[right, at[right]] = new[: len(right)]
            rank[left, at[left] - 1] = new[len(right) :]
        flat = out[columns < count[:, None]].tobytes()
        cut = np.concatenate(([0], np.cumsum(count * 4))).tolist()
        return [flat[a:b] for a, b in zip(cut, cut[1:])]

    def merge_long(self, piece: bytes) -> bytes:
        """Ids of a piece of any length, in n log n steps."""
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (s := self.pairs.get((r, ids[k]))) is not None:
                    heapq.heappush(heap, (s, i, r, ids[k]))
            if (k := before[i]) >= 0 and (s := self.pairs.get((ids[k], r))) is not None:
                heapq.heappush(heap, (s, k, ids[k], r))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def encode_new(self, pieces: list[str]) -> dict[str, bytes]:
        groups: dict[int, list[tuple[str, bytes]]] = defaultdict(list)
        for p in pieces:
            raw = p.encode()
            groups[bisect_left(WIDTHS, len(raw))].append((p, raw))
        out: dict[str, bytes] = {}
        for i, group in groups.items():
            raws = [r for _, r in group]
            ids = self.merge_rows(raws) if i < len(WIDTHS) else list(map(self.merge_long, raws))
            out.update(zip([p for p, _ in group], ids))
        return out


@lru_cache(2)
def ranks_of(path: str) -> Ranks:
    return Ranks(path)


emptied_between_operators(ranks_of.cache_clear)


def cached_ids(pieces: list[str], cache: dict[str, bytes], encode_new) -> list[bytes]:
    """Ids of each piece: from the cache, or for all new ones at once."""
    found = list(map(cache.get, pieces))
    at = list(compress(count(), map(is_, found, repeat(None))))
    if at:
        missed = [pieces[i] for i in at]
        new = encode_new(list(dict.fromkeys(missed)))
        for i, p in zip(at, missed):
            found[i] = new[p]
        if len(cache) > CACHE_PIECES:  # the step at hand stays, and with it the frequent pieces
            cache.clear()
            new = dict(zip(pieces, found))
        cache.update(new if max(map(len, new)) <= CACHE_CHARS else {p: x for p, x in new.items() if len(p) <= CACHE_CHARS})
    return found


def ids_of_texts(texts: list[str], cache: dict[str, bytes], encode_new) -> Iterator[bytes]:
    """Ids of each whole text, in order; pieces of several steps meet the cache together."""
    open_text: list[bytes] = []
    pieces: list[str] = []
    cuts: list[tuple[int, bool]] = []  # end of a text, or of a part of one, in pieces

    def settle() -> Iterator[bytes]:
        ids, at = cached_ids(pieces, cache, encode_new), 0
        for end, goes_on in cuts:
            open_text.append(b"".join(ids[at:end]))
            at = end
            if not goes_on:
                yield b"".join(open_text)
                open_text.clear()
        pieces.clear()
        cuts.clear()

    for new, first, goes_on in pretokens(texts):
        cuts.extend((len(pieces) + end, goes_on) for end in first[1:].tolist())
        pieces.extend(new)
        if len(pieces) >= STEP_PIECES:
            yield from settle()
    yield from settle()


def decode_ids(ids: list[bytes], vocabulary: Ranks) -> list[bytes]:
    """Bytes of each list of ids, gathered by the offsets of tokens in one flat array."""
    every = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
    size = vocabulary.offset[every + 1] - vocabulary.offset[every]
    end = np.concatenate(([0], np.cumsum(size)))
    source = np.repeat(vocabulary.offset[every] - end[:-1], size) + np.arange(end[-1])
    flat = vocabulary.flat[source].tobytes()
    cut = end[np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids])))].tolist()
    return [flat[a:b] for a, b in zip(cut, cut[1:])]


def encode_batches(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    caches_of("bpe")
    vocabulary = ranks_of(path)
    for batch in batches:
        texts = batch.column(1).fill_null("").to_pylist()
        ids = pa.array(ids_of_texts(texts, vocabulary.cache, vocabulary.encode_new), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])


def decode_batches(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    caches_of("bpe")
    vocabulary = ranks_of(path)
    for batch in batches:
        ids = batch.column(1).to_pylist()
        parts: list[bytes] = []
        held: list[bytes] = []
        for x in ids:  # a few megabytes of ids at once
            held.append(x)
            if sum(map(len, held[-1:])) > 1 << 22 or len(held) >= 64:
                parts += decode_ids(held, vocabulary)
                held = []
        parts += decode_ids(held, vocabulary) if held else []
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, pa.binary())], names=["doc_id", "ids", "decoded"])


def encode(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit, one binary a row) of every whole text.

    Null and empty texts have no ids; repeated rows and null doc_ids stay as they are; other
    columns are dropped; an empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(lambda it: encode_batches(ranks_path, it), "doc_id long, ids binary")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Adds the decoded bytes to a table of doc_id and ids."""
    small_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(lambda it: decode_batches(ranks_path, it), "doc_id long, ids binary, decoded binary")


def encode_and_decode(docs: DataFrame, ranks_path: str) -> DataFrame:
    """What decode(encode(docs)) returns, by one Python worker a task, which holds one vocabulary, instead of two."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string"))
    return rows.mapInArrow(lambda it: decode_batches(ranks_path, encode_batches(ranks_path, it)), "doc_id long, ids binary, decoded binary")
