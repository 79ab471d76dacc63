"""SpotSigs against a brute-force version."""

import hashlib
import random

import pytest

from tallycast.llm import spotsigs as s

WORDS = "the a of und le el river house stone garden cloud apple winter summer music paper".split()


def sets(text):
    """Word-by-word signatures, written plainly."""
    words = text.lower().split()
    out = set()
    for i, w in enumerate(words):
        if w in s.COMMON:
            chain = [x for x in words[i + 1 :] if x not in s.COMMON][: s.CHAIN]
            if len(chain) == s.CHAIN:
                out.add((w, *chain))
    return out or set(words)


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    out = [" ".join(rnd.choices(WORDS, k=rnd.randint(0, 60))) for _ in range(60)]
    return [*out, "", "river stone", "the", out[0], out[0], " ".join(rnd.choices(WORDS, k=5000))]


@pytest.mark.parametrize("cells", [1, 3])
def test_probes(spark, texts, cells):
    docs = spark.createDataFrame([(i * 3, t, t) for i, t in enumerate(texts)], "doc_id long, text string, next_text string").repartition(5)
    assert {r.doc_id: r.next_text for r in s.following(docs, cells).collect()} == {i * 3: texts[i - 1] for i in range(len(texts))}
    got = {r.doc_id: r for r in s.probes(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r, after = got[i * 3], texts[i - 1]
        half = len(t) // 2
        want = t[: len(t) - half] + after[:half]
        assert r.n_chars == len(t) and hashlib.sha256(r.edited_text.encode()).digest() == hashlib.sha256(want.encode()).digest()
        assert r.near_edited == pytest.approx(jaccard(sets(t), sets(want)))
        assert r.near_next == pytest.approx(jaccard(sets(t), sets(after)))
        assert s.likeness(s.read(r.fingerprint), s.read(r.edited_fingerprint)) == r.near_edited
    assert got[0].fingerprint != got[3].fingerprint


def test_odd_rows(spark):
    rows = [(None, None), (5, "x y"), (5, "a b"), (5, "a b"), (9, "!!")]
    got = s.probes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r.doc_id) for r in got) == ["5", "5", "5", "9", "None"]
    assert s.probes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = s.probes(spark.createDataFrame([(1, "the river stone")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_similar_loses_no_pair(spark, texts):
    rnd = random.Random(4)
    near = [" ".join(w for w in t.split() if rnd.random() > 0.04) for t in texts for _ in range(2)]
    docs = spark.createDataFrame(list(enumerate([*texts, *near])), "doc_id long, text string")
    prints = s.fingerprints(docs)
    every = sorted({r.fingerprint for r in prints.collect()})
    want = {(a, b) for i, a in enumerate(every) for b in every[i + 1 :] if a and b and s.likeness(s.read(a), s.read(b)) >= 0.8}
    got = {tuple(sorted((r.a, r.b))) for r in s.similar(prints).collect()}
    assert want and got == want
