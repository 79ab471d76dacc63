"""Near-duplicate classes, signatures and components against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest

from tallycast.llm import graph
from tallycast.llm import neardup as nd
from tallycast.llm.common import text_key


def shingles(text):
    w = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(rows):
    texts = sorted({t or "" for _, t in rows})
    parent = {t: t for t in texts}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    sets = {t: shingles(t) for t in texts}
    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * len(sets[a] | sets[b]):
                parent[root(b)] = root(a)
    least = {}
    for d, t in rows:
        r = root(t or "")
        least[r] = min(x for x in (least.get(r), d) if x is not None) if (least.get(r) is not None or d is not None) else None
    return {(d, least[root(t or "")]) for d, t in rows}


def corpus(seed=1, n=60):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(n):
        base = [rnd.choice(words) for _ in range(rnd.choice([3, 6, 40, 90]))]
        texts.append(" ".join(base))
        for _ in range(rnd.choice([0, 0, 1, 4])):
            edit = list(base)
            edit[rnd.randrange(len(edit))] = rnd.choice(words)
            texts.append(" ".join(edit))
    rnd.shuffle(texts)
    return texts


def test_classes_match_brute_force(spark):
    texts = [*corpus(), "", None, "", "!!", "??", "same text", "same text", "x " * 2000]
    rows = [(i * 2, t) for i, t in enumerate(texts)] + [(4, texts[2]), (None, texts[0]), (None, "only null id")]
    docs = spark.createDataFrame([(*r, b"x", 1) for r in rows], "doc_id long, text string, node binary, root int")
    got = {(r.doc_id, r.class_id) for r in nd.near_duplicates(docs).collect()}
    assert got == brute_classes(rows)
    assert nd.near_duplicates(docs).count() == len(rows)
    kept = nd.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    classes = {c for _, c in got}
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(c for c in classes if c is not None) and ids.count(None) == 1
    assert nd.near_duplicates(docs.limit(0)).count() == 0 and nd.without_near_duplicates(docs.limit(0)).count() == 0


def test_star_of_a_large_group(spark):
    """Copies near one base but not near each other: their links go through the base only."""
    rnd = random.Random(2)
    base = [f"w{rnd.randrange(900)}" for _ in range(120)]
    texts = [" ".join(base)]
    for i in range(80):
        edit = list(base)
        for at in (7 * i % 110 + 3, (7 * i + 55) % 110 + 3):
            edit[at] = f"new{i}x{at}"
        texts.append(" ".join(edit))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.class_id for r in nd.near_duplicates(docs).collect()} == {0}


def test_signatures_estimate_probability_jaccard():
    rnd = np.random.default_rng(3)
    slots = 4096
    for _ in range(5):
        a = (np.arange(60, dtype=np.uint64), rnd.integers(1, 9, 60))
        b = (np.arange(20, 80, dtype=np.uint64), rnd.integers(1, 9, 60))
        text = np.repeat([0, 1], 60)
        sig = nd.prob_minhash(text, np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]).astype(float), 2, slots)
        exact, plain = nd.similarity(a, b)
        assert abs((sig[0] == sig[1]).mean() - exact) < 0.04 and plain == 0.5
    same = nd.prob_minhash(np.repeat([0, 1], 60), np.concatenate([a[0], a[0]]), np.concatenate([a[1], a[1] * 3]).astype(float), 2, 64)
    assert (same[0] == same[1]).mean() == 1.0 or nd.similarity(a, (a[0], a[1] * 3))[0] == pytest.approx(1.0)


def test_bands_are_tuned():
    bands, rows = nd.tuned_bands()
    assert 1 - (1 - 0.8**rows) ** bands >= nd.RECALL and bands * rows <= nd.SLOTS


def test_components(spark):
    rnd = random.Random(4)
    path = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 80)]
    loose = [(2000 + rnd.randrange(60), 2000 + rnd.randrange(60)) for _ in range(50)]
    edges = [(a, b) for a, b in path + star + loose if a != b]
    df = spark.createDataFrame(edges, "a long, b long").select(text_key("a").alias("a"), text_key("b").alias("b"))
    got = {bytes(r.node): bytes(r.root) for r in graph.components(df).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    import hashlib

    key = {x: hashlib.md5(str(x).encode()).digest() for x in parent}
    want, have = defaultdict(set), defaultdict(set)
    for x in parent:
        want[root(x)].add(key[x])
        have[got[key[x]]].add(key[x])
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, have.values()))


def test_pairs_beside_a_large_component(spark):
    """Members linked only with each other, in buckets that also hold a component of more members than any number of hubs."""
    groups = {"g": 150, "a": 2, "b": 3, "c": 1}
    texts = [f"{g}{i}" for g, n in groups.items() for i in range(n)]
    rows = [(band, t.encode()) for band in range(6) for t in texts]
    bands = spark.createDataFrame(rows, "band long, node binary")
    docs = spark.createDataFrame([(t.encode(), t) for t in texts], "node binary, text string")
    compared = lambda a, b: [x[0] == y[0] for x, y in zip(a, b)]
    got = {bytes(r.node).decode(): bytes(r.root) for r in graph.linked_classes(bands, docs, compared).collect()}
    classes = defaultdict(set)
    for t, r in got.items():
        classes[r].add(t)
    assert sorted(map(sorted, classes.values())) == sorted(sorted(f"{g}{i}" for i in range(n)) for g, n in groups.items() if n > 1)


def test_links_between_members_of_large_buckets(spark):
    """Blocks meet each other: pairs that no hub joins, in a bucket of many blocks."""
    texts = [f"{i % 140}:{i}" for i in range(280)]
    bands = spark.createDataFrame([(7, t.encode()) for t in texts], "band long, node binary")
    docs = spark.createDataFrame([(t.encode(), t) for t in texts], "node binary, text string")
    alike = lambda a, b: [x.split(":")[0] == y.split(":")[0] for x, y in zip(a, b)]
    roots = {bytes(r.node).decode(): bytes(r.root) for r in graph.linked_classes(bands, docs, alike).collect()}
    assert len(set(roots.values())) == 140 and all(roots[f"{i}:{i}"] == roots[f"{i}:{i + 140}"] for i in range(140))


def test_bounds_rule_out_no_near_pair():
    rnd = random.Random(8)
    texts = [*corpus(9, 30), *(" ".join(["a b c d e f g h"] * n + [f"v{rnd.randrange(60)}" for _ in range(60)]) for n in (1, 2, 9, 30))]
    may = nd.may_be_near(texts, texts)
    assert not may.all()
    for i, a in enumerate(texts):
        assert all(may[i][np.array(nd.near([a] * len(texts), texts))])


def test_plain_near_copies_with_a_repeated_line(spark):
    """Plain Jaccard is 0.9 or more and probability Jaccard under a half: only bands of plain signatures find these."""
    rnd = random.Random(11)
    rows = []
    for i in range(30):
        words = [f"w{rnd.randrange(5000)}" for _ in range(154)]
        line = words[40:54]
        rows += [(str(2 * i), " ".join(words)), (str(2 * i + 1), " ".join(words + line * 20))]
    (a, b) = (nd._set_of(t) for _, t in rows[:2])
    weighted, plain = nd.similarity(a, b)
    assert weighted < 0.5 and plain > 0.9
    bands = nd.band_rows(spark.createDataFrame(rows, "node string, text string").selectExpr("cast(node as binary) node", "text"))
    keys = defaultdict(set)
    for r in bands.collect():
        keys[int(bytes(r.node).decode())].add(r.band)
    assert all(keys[2 * i] & keys[2 * i + 1] for i in range(30))
