"""Spaced seeds: the masks' guarantee, and overlaps against a plain comparison of all alignments."""

import itertools
import random
import re

from tallycast.llm import decontamination as dc


def test_masks_see_every_pair_of_substitutions():
    marked = [[i for i, c in enumerate(m) if c == "1"] for m in dc.MASKS]
    assert all(len(m) == dc.SPAN for m in dc.MASKS)
    for bad in itertools.combinations(range(dc.WINDOW), dc.WINDOW - dc.LEAST):
        assert any(not {o + j for j in m} & set(bad) for m in marked for o in range(dc.WINDOW - dc.SPAN + 1))


def brute(rows, items):
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    out = set()
    for d, t in rows:
        a = words(t)
        for i, x in items:
            b = words(x)
            for shift in range(-len(b) + 1, len(a)):
                same = [k for k in range(len(b)) if 0 <= k + shift < len(a) and a[k + shift] == b[k]]
                windows = [[q for q in same if k <= q <= k + dc.WINDOW - 1] for k in same]
                windows = [w for w in windows if len(w) >= dc.LEAST]
                if windows:
                    first, last = min(w[0] for w in windows), max(w[-1] for w in windows)
                    out.add((d, i, shift + first, first, last - first + 1))
    return out


def test_overlaps(spark):
    rnd = random.Random(7)
    vocabulary = "the of and to river stone garden cloud apple été straße x1 lamp road tree".split()
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, prose(rnd.randint(8, 45))) for i in range(12)] + [(90, None), (91, "")]
    rows = [(i, prose(rnd.randint(0, 70))) for i in range(40)]
    for n, i in enumerate((1, 5, 9, 11)):
        w = items[n * 2][1].split()
        for k in range(0, len(w), 8):
            w[k] = "changed"
        rows[i] = (i, f"{prose(5)} {' '.join(w).upper()}!! {prose(9)}")
    rows += [(77, items[3][1] + ". " + items[3][1]), (77, items[3][1] + ". " + items[3][1]), (78, None), (None, items[4][1]), (79, "x " * 5000)]
    docs = spark.createDataFrame([(*r, 0, []) for r in rows], "doc_id long, text string, seed int, words array<string>")
    bench = spark.createDataFrame([(*i, "e") for i in items], "item_id long, text string, equal string")
    got = {tuple(r) for r in dc.overlaps(docs, bench).drop("key").collect()}
    want = brute(rows, items)
    assert len(want) > 5 and got == want
    bad = {d for d, *_ in want}
    clean = dc.decontaminated(docs, bench)
    assert clean.columns == docs.columns and sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(d) for d, _ in rows if d not in bad)
    assert dc.overlaps(docs.limit(0), bench).count() == 0 and dc.overlaps(docs, bench.limit(0)).count() == 0
