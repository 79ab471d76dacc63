"""Spelling variants against all pairs, trees against plain distances."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallycast.llm import spelling as s

SCHEMA = "doc_id long, text string, word string, n string, root int, leaf int, length string"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def got(spark, rows):
    df = spark.createDataFrame([(d, t, "w", "n", 1, 2, "l") for d, t in rows], SCHEMA)
    return sorted((tuple(r) for r in s.spelling_variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def edited(rnd, w):
    i = rnd.randrange(len(w))
    return rnd.choice([w[:i] + w[i + 1 :], w[:i] + rnd.choice("abéÉß×") + w[i:], w[:i] + rnd.choice("abéÿÀ") + w[i + 1 :]])


def test_forms_match_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(s, "LEAF_WORDS", 24)  # dealing trees with many leaves, as on large tables
    monkeypatch.setattr(s, "SAMPLE_A_LEAF", 6)
    monkeypatch.setattr(s, "FINE", 5)
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abcé") for _ in range(rnd.randint(5, 8))) for _ in range(60)]
    words += [edited(rnd, w) for w in words for _ in range(3)]
    words += [edited(rnd, w) for w in words[-60:]]
    rows = []
    for i in range(160):
        chosen = [w for w in rnd.choices(words, weights=[3000 / (1 + 7 * k) for k in range(len(words))], k=60)]
        rows.append((rnd.choice([i, None, -i]), rnd.choice([" ", "-", "1", "Ā", "\n"]).join(rnd.choice([w, w.upper() if w.isascii() else w]) for w in chosen)))
    rows += [rows[3]] * 4 + [(7, None), (None, None), (8, ""), (9, "12 34")]
    want = brute(rows)
    assert got(spark, rows) == want
    assert sum(f is not None for _, f, *_ in want) > 20 and any(f is not None and f != r for _, f, r, *_ in want)


def test_empty_table_long_words_and_texts(spark):
    assert got(spark, []) == []
    long = "ab" * 30_000
    rows = [(i, f"{long} {long}x filler {'Muster ' * 100_000}") for i in range(5)] + [(9, f"{long[1:]} Mustér " * 6)]
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("seed", range(6))
def test_near_pairs(seed, monkeypatch):
    monkeypatch.setattr(s, "FINE", 1 + seed)
    monkeypatch.setattr(s, "STEP_PAIRS", 64)
    rnd = random.Random(seed)
    home = sorted({"".join(rnd.choice("abzÀÿ") for _ in range(6)) for _ in range(200)})
    for k in (6, 5):
        queries = sorted({"".join(rnd.choice("abzÀÿ") for _ in range(k)) for _ in range(150)})
        i, j = s.near_pairs(s.code_rows(home, 6), s.code_rows(queries, k))
        assert sorted(zip(i.tolist(), j.tolist())) == [(a, b) for a in range(len(queries)) for b in range(len(home)) if one_edit(queries[a], home[b])]


def test_boxes_hold_all_that_is_near():
    rnd = np.random.default_rng(5)
    points = s.letter_counts(rnd.integers(97, 109, (500, 9)).astype(np.uint16))
    root, leaves = s.tree(points, 10)
    of = np.full(500, -1)
    for node, rows in s.reached(root, points, 0):
        assert (of[rows] == -1).all() and set(rows) == set(node.rows)
        of[rows] = node.leaf
    assert leaves > 30 and set(of) == set(range(leaves))
    apart = np.abs(points[:, None].astype(int) - points[None]).sum(2)
    met = np.zeros((500, 500), bool)
    for node, rows in s.reached(root, points, 2):
        met[np.ix_(rows, node.rows)] = True
    assert met[apart <= 2].all() and met.mean() < 0.5
