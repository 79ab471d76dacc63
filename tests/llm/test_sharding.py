"""Shards against brute force: the smallest capacity, atomic groups and gapless slots."""

import random
import zlib
from collections import defaultdict

import pytest

from tallycast.llm import sharding as s


def brute_capacity(sizes, shards):
    def needed(c):
        n, held = 1, 0
        for x in sizes:
            if x > c:
                return shards + 1
            if held + x > c:
                n, held = n + 1, 0
            held += x
        return n

    c = max(sizes)
    while needed(c) > shards:
        c += 1
    return c


def look_in(ends):
    def look(spans, width):
        best = {}
        for e in ends:
            for i, (a, b) in enumerate(spans):
                if a < e <= b:
                    k = ((e - a - 1) // width, i)
                    best[k] = max(best.get(k, 0), e)
        return sorted(best.values())

    return look


@pytest.mark.parametrize("seed", range(60))
def test_smallest_capacity(seed):
    rnd = random.Random(seed)
    sizes = [rnd.choice([rnd.randint(1, 9), rnd.randint(1, 400), rnd.randint(1, 4000)]) for _ in range(rnd.randint(1, 300))]
    shards = rnd.randint(1, 24)
    ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]
    got = s.smallest_capacity(ends[-1], max(sizes), shards, look_in(ends), cells=rnd.choice([4, 20]) * shards * shards + 50)
    assert got == brute_capacity(sizes, shards)


def best_least(sizes, shards, capacity):
    """The greatest possible least size of a shard, none beyond the capacity: a dynamic programme over cuts."""
    ends = [0]
    for x in sizes:
        ends.append(ends[-1] + x)
    best = {0: 10**18}
    for _ in range(shards):
        after = {}
        for i, least in best.items():
            for j in range(i, len(ends)):
                held = ends[j] - ends[i]
                if held > capacity:
                    break
                after[j] = max(after.get(j, -1), min(least, held))
        best = after
    return best[len(sizes)]


@pytest.mark.parametrize("seed", range(40))
def test_cuts_stay_within_any_feasible_capacity(seed):
    rnd = random.Random(seed)
    sizes = [rnd.choice([rnd.randint(1, 9), rnd.randint(1, 400), rnd.randint(1, 4000)]) for _ in range(rnd.randint(1, 300))]
    shards = rnd.randint(1, 24)
    ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]
    capacity = brute_capacity(sizes, shards)
    around = lambda x: (max((e for e in ends if e <= x), default=0), min((e for e in ends if e > x), default=ends[-1]))
    cuts = s.balanced_cuts(ends[-1], capacity, shards, around)
    assert len(cuts) == shards and cuts == sorted(cuts) and set(cuts) <= {0, *ends} and cuts[-1] == ends[-1]
    assert max(b - a for a, b in zip([0, *cuts], cuts)) == capacity


def test_near_equal_on_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    group, first = defaultdict(int), {}
    for r in docs.select("doc_id", "text").collect():
        group[r.text or ""] += len((r.text or "").encode()) + 8
        first[r.text or ""] = min(first.get(r.text or "", r.doc_id), r.doc_id)
    sizes = [group[t] for t in sorted(group, key=first.get)]
    held = defaultdict(int)
    for r in s.shards_by_bytes(docs).collect():
        held[r.shard] += r.size
    capacity = brute_capacity(sizes, 24)
    assert len(held) == 24 and max(held.values()) == capacity
    assert min(held.values()) >= 0.9 * min(best_least(sizes, 24, capacity), sum(sizes) / 24)


def check(rows, got, shards):
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted((d is None, d or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    slots, of = defaultdict(list), {}
    for r in got:
        slots[r.shard].append(r.slot)
        assert of.setdefault((r.text_crc32, r.size), r.shard) == r.shard and r.law == "bytes" and r.grown_shard is None
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(shards))


def test_shards(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice(["", None, "hot", "hot", "é" * rnd.randint(0, 90), "x" * rnd.randint(0, 300)])) for i in range(700)] + [(None, "hot"), (3, "hot"), (3, "hot")]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, size int, shard string")
    got = s.shards_by_bytes(docs).collect()
    check(rows, got, 24)
    sizes = defaultdict(int)
    first = {}
    for d, t in rows:
        sizes[t or ""] += len((t or "").encode()) + 8
        first[t or ""] = min(first.get(t or "", 10**9), -1 if d is None else d)
    order = [sizes[t] for t in sorted(sizes, key=lambda t: (first[t], zlib.crc32(t.encode())))]
    held = defaultdict(int)
    for r in got:
        held[r.shard] += r.size
    assert max(held.values()) <= max(max(order), -(-sum(order) // 24) + sorted(order)[-2])
    assert s.shards_by_bytes(docs.limit(0)).count() == 0
    assert [(r.shard, r.slot) for r in s.shards_by_bytes(spark.createDataFrame([(1, "a")], "doc_id long, text string")).collect()] in ([(i, 0)] for i in range(24))
