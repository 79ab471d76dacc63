"""SimHash components against all pairs, bucket keys and pivots against plain loops."""

import random
import re

import numpy as np
import pytest
import xxhash

from tallycast.llm import simhash as s

SCHEMA = "doc_id long, text string, fingerprint string, root string, node int"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, distance=4):
    prints = [plain_fingerprint(t) for _, t in rows]
    seen, out = [None] * len(rows), [None] * len(rows)
    for i in range(len(rows)):
        if seen[i] is not None:
            continue
        seen[i], todo, group = i, [i], []
        while todo:
            a = todo.pop()
            group.append(a)
            for b in range(len(rows)):
                if seen[b] is None and (prints[a] ^ prints[b]).bit_count() <= distance:
                    seen[b] = i
                    todo.append(b)
        least = min((rows[a][0] for a in group if rows[a][0] is not None), default=None)
        for a in group:
            out[a] = least
    return sorted(((d, f"{p:016x}", c) for (d, _), p, c in zip(rows, prints, out)), key=str)


def got(spark, rows):
    df = spark.createDataFrame([(d, t, "x", "y", 1) for d, t in rows], SCHEMA)
    return sorted((tuple(r) for r in s.near_duplicates(df).select("doc_id", "fingerprint", "component_id").collect()), key=str)


def texts(rnd, n):
    out = []
    for i in range(n):
        words = [rnd.choice(["Öl", "the", "A b", "x y", "Run", "ÀB", "end.", "z" * 9]) + str(rnd.randint(0, 60)) for _ in range(rnd.choice([0, 1, 3, 4, 5, 200]))]
        out.append(rnd.choice([" ", "\t", " \x0b\n", "  "]).join(words))
        for _ in range(rnd.randint(0, 3)):  # chains of copies with one word changed
            if words:
                words[rnd.randrange(len(words))] = f"new{rnd.random()}"
            out.append(" ".join(words))
    return out


def test_components_match_all_pairs(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([i, -i]), t) for i, t in enumerate(texts(rnd, 60))]
    rows += [(None, rows[5][1]), (None, "only here and nowhere else at all"), (900, None), (901, ""), (901, ""), (902, "\x1c"), (903, "\x85 \x85")]
    assert got(spark, rows) == brute(rows)
    assert len({c for *_, c in brute(rows)}) < len(rows)


def test_empty_table_and_long_text(spark):
    assert got(spark, []) == []
    words = [f"W{i % 7919}" for i in range(700_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "other"]))]
    assert len(rows[0][1]) > 3_000_000
    a, b = (plain_fingerprint(t) for _, t in rows)
    assert got(spark, rows) == [(1, f"{a:016x}", 1), (2, f"{b:016x}", 1 if (a ^ b).bit_count() <= 4 else 2)]


@pytest.mark.parametrize("groups", [5, 6, 8])
def test_near_fingerprints_share_a_bucket(groups):
    rnd = random.Random(groups)
    for _ in range(300):
        a = rnd.getrandbits(64)
        b = a
        for bit in rnd.sample(range(64), rnd.randint(0, 4)):
            b ^= 1 << bit
        keys = s.bucket_keys(np.array([a, b], np.uint64), groups)
        assert (keys[0] == keys[1]).any()
        table = s.distances(np.array([a, b], np.uint64), s.SPREAD)
        assert table[0, 3] == (a ^ int(s.SPREAD[3])).bit_count() and np.abs(table[0] - table[1]).max() <= 4


@pytest.mark.parametrize("seed", range(4))
def test_joined_in_small_steps(seed, monkeypatch):
    monkeypatch.setattr(s, "STEP_PAIRS", 70)
    rnd = random.Random(seed)
    values = []
    for _ in range(12):
        x = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 9)):
            values.append(x)
            for bit in rnd.sample(range(64), rnd.randint(1, 6)):
                x ^= 1 << bit
    rnd.shuffle(values)
    values = sorted(set(values), key=lambda v: hash((v, seed)))

    def parts(pairs):
        root = list(range(len(values)))
        for i, j in pairs:
            old, new = root[i], root[j]
            root = [new if r == old else r for r in root]
        return {frozenset(i for i in range(len(values)) if root[i] == r) for r in set(root)}

    pairs = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 4]
    assert parts(enumerate(s.joined(np.array(values, np.uint64)).tolist())) == parts(pairs)
    side = np.array([rnd.randint(0, 1) for _ in values])
    assert parts(enumerate(s.joined(np.array(values, np.uint64), side).tolist())) == parts([(i, j) for i, j in pairs if side[i] != side[j]])


def test_large_buckets_go_by_slots(spark, monkeypatch):
    monkeypatch.setattr(s, "SLOT", 16)
    rnd = random.Random(9)
    base = [rnd.getrandbits(64) for _ in range(3)]
    values = {b ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for b in base for _ in range(60)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    found = [(r.a, r.b) for r in s.links(nodes, len(signed)).collect()]

    def classes(pairs):
        root = {v: v for v in signed}
        for a, b in pairs:
            old, new = root[a], root[b]
            root = {k: new if r == old else r for k, r in root.items()}
        return {frozenset(k for k in signed if root[k] == r) for r in set(root.values())}

    near = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
    assert classes(found) == classes(near)


def test_groups_grow_with_the_table():
    assert s.groups_for(0) == s.groups_for(50_000) == 5 and s.groups_for(10**7) == 6 and s.groups_for(10**10) > 6
