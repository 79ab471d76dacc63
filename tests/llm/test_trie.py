"""The prefix trie against a plain tree."""

import hashlib
import random
import zlib

from tallycast.llm import trie as t

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth string, n int"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append(((turn is not None, turn or 0), role, digest, text))
    own = {c: [(r, x) for _, r, _, x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        whole[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = {}
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    out = []
    for node, convs in members.items():
        below = [v for v in members if v[: len(node)] == node]
        children = [v for v in below if len(v) == len(node) + 1]
        ends = ",".join(map(str, sorted(c for c in convs if len(whole[c]) == len(node))))
        leaves = sum(not any(len(u) == len(v) + 1 and u[:-1] == v for u in below) for v in below)
        saved = sum((len(members[v]) - 1) * len(v[-1][1].encode()) for v in below if v)
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in t.prefix_trie(df).select(*COLUMNS).collect()), key=str)


def conversations(rnd, n):
    texts = ["", None, "hello", "été", "a,b", "1:x"]
    rows = []
    for _ in range(n):
        c = rnd.choice([rnd.randint(-12, 60), rnd.randint(0, 10**9)])
        if any(r[0] == c for r in rows):
            continue
        rows += [(c, rnd.choice([k, None, -k]), rnd.choice(["user", "u", None]), rnd.choice(texts)) for k in range(rnd.choice([1, 2, 3, 9, 14]))]
    return rows


def test_trie_matches_plain_tree(spark):
    rnd = random.Random(2)
    rows = conversations(rnd, 60) + [(None, 1, "user", "lost"), (None, None, None, None)]
    rows += rows[:5]  # repeated rows
    rnd.shuffle(rows)
    assert got(spark, rows) == brute(rows)


def test_copies_ties_and_turnless(spark, monkeypatch):
    monkeypatch.setattr(t, "PIECE_BITS", 3)  # end lists of many pieces
    rows = [(c, k, "user", f"turn {k}") for c in range(-40, 200) for k in range(3)]  # one conversation many times
    rows += [(c, 0, "user", "x") for c in range(1001, 1200) if c % 5]  # the head is absent: some keep no turn
    rows += [(500_000, 1, "u", "same"), (500_000, 1, "u", "same"), (500_000, 1, "a", "same")]
    assert got(spark, rows) == brute(rows)


def test_framing_tells_role_from_text(spark):
    rows = [(10, 1, "user", "s"), (20, 1, "use", "rs"), (30, 1, "", "users"), (40, 1, None, "users")]
    assert got(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, 1, "user", "x")]) == []


def test_long_text_and_long_conversation(spark):
    rows = [(5, 1, "user", "long " * 1_000_000), (6, 1, "user", "long " * 1_000_000)]
    assert got(spark, rows) == brute(rows)
    rows = [(c, k, "user", f"t{k}" if c < 12 or k < 1500 else "other") for c in (10, 11, 12) for k in range(3000)]
    found = got(spark, rows)
    assert max(r[1] for r in found) == 3000 and len(found) == 1 + 3000 + 1500 and max(r[5] for r in found) == 2
    every = sum(len(f"t{k}") for k in range(3000)) + 2 * sum(len(f"t{k}") for k in range(1500)) - sum(len(f"t{k}") for k in range(1500))
    assert next(r for r in found if r[1] == 0)[6] == every
