"""Quality rules, compression distance and cross-entropy difference: held-out accuracy and brute force."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallycast.llm import lm_scoring as lm
from tallycast.llm import quality, toxicity
from tallycast.llm.queries import QUERIES
from tallycast.llm.training import remainder
from tallycast.llm.words import words_of

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (None, "x"), (3, "a b"), (3, "a b"), (4, "word " * 20000), (5, "¡!?")]


def area(score, label):
    good, bad = score[label == 1], score[label == 0]
    return float((good[:, None] > bad[None, :]).mean() + 0.5 * (good[:, None] == bad[None, :]).mean())


@pytest.mark.parametrize(("name", "label", "fold", "rest", "least"), [("op8_quality_rules", "quality", 4, 2, 0.97), ("op10_toxicity", "toxic", 3, 1, 0.8)])
def test_held_out(spark, name, label, fold, rest, least):
    got = QUERIES[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "left").toPandas()
    assert len(got) == 1000 and got["score"].between(0, 1).all()
    assert (got["held_out"] == [zlib.crc32(str(d).encode()) % fold == rest for d in got["doc_id"]]).all()
    assert (got["predicted"] == (got["score"] >= 0.7)).all()
    held = got[got["held_out"] & got[label].notna()]
    assert area(held["score"].to_numpy(), held[label].to_numpy()) > least


def test_odd_rows(spark):
    docs = spark.createDataFrame([(*r, 0.5, "l") for r in ODD], "doc_id long, text string, score double, label string")
    labels = spark.createDataFrame([(1, 0, 0), (3, 1, 1), (9, 1, None)], "doc_id long, quality int, toxic int")
    none = F.lit(False)
    model = quality.fit_on(docs, labels, none)
    assert quality.score(docs, model).count() == len(ODD)
    assert quality.scored(docs, model).columns == ["doc_id", "text", "label", "score"]
    assert quality.fit_on(docs, labels.limit(0), none).rules == [] and quality.score(docs.limit(0), model).count() == 0
    toxic = toxicity.fit_on(docs, labels, none)
    assert toxicity.score(docs, toxic).count() == len(ODD) and toxicity.score(docs.limit(0), toxic).count() == 0
    assert {r.score for r in toxicity.score(docs, toxicity.fit_on(docs, labels.limit(0), none)).collect()} < {0.0, *[r.score for r in toxicity.score(docs, toxicity.fit([], [])).collect()]}
    model = lm.fit(docs, docs.limit(0))
    assert lm.score(docs, model).count() == len(ODD) and lm.score(docs.limit(0), model).count() == 0


def test_rules_follow_the_trees():
    text = "Tree\n  If (feature 0 <= 1.5)\n   If (feature 1 > 2.0)\n    Predict: 1\n   Else (feature 1 <= 2.0)\n    Predict: 2\n  Else (feature 0 > 1.5)\n   Predict: 3\n"
    a, b = quality.STATISTICS[:2]
    assert [r.parts for r in quality.rules_of(text)] == [((a, True, 1.5),), ((a, True, 1.5), (b, False, 2.0)), ((a, True, 1.5), (b, True, 2.0)), ((a, False, 1.5),)]


def test_statistics_by_hand():
    x = dict(zip(quality.STATISTICS, quality.statistics(["Ab ab AB\n12 !", "", "zz zz"]).T))
    assert x["log_words"].tolist() == pytest.approx([math.log(5), 0, math.log(3)])
    assert x["upper_share"][0] == pytest.approx(3 / 6) and x["number_share"][0] == pytest.approx(2 / 9)
    assert x["repeat_share"].tolist() == pytest.approx([2 / 4, 0, 1 / 2]) and x["line_words"].tolist() == pytest.approx([2, 0, 2])
    assert x["top_share"].tolist() == pytest.approx([3 / 4, 0, 1])


def test_windows_hold_the_whole_text():
    text = "word " * 500 + "é" * 700
    parts = toxicity.windows(text)
    joined = parts[0][:-1] + b"".join(p[:-1] for p in parts[1:-1]) + parts[-1]
    assert joined == b" " + text.encode() + b" " and max(map(len, parts)) <= toxicity.WINDOW + 1


@pytest.mark.parametrize("head", [0, 3, 100])
def test_language_models(spark, head):
    """Both losses by hand, whichever words are broadcast or joined; rows alike, and texts with words never seen."""
    texts = ["the cat sat on the mat", "the dog sat", "", None, "the cat the cat ran", "odd words here only once once"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    target = docs.where("doc_id in (0, 4)")
    model = lm.fit(docs, target, 4, head)
    words = [(t or "").split() for t in texts]
    count = Counter(w for ws in words for w in ws)
    of = dict(zip(count, words_of([" ".join(count)]).hash.view(np.int64).tolist()))
    known = sorted(count, key=lambda w: (-count[w], of[w]))[:4]
    assert sorted(of[w] for w in known) == model.tables.classes.tolist()
    assert len(model.tables.head) <= head and len(model.tables.head) + model.tail.count() == len(count) - 4

    def loss(sample, ws):
        line = lambda x: ["<s>", *(w if w in known else "?" for w in x), "</s>"]
        pairs = Counter(p for x in sample for p in zip(line(x), line(x)[1:]))
        after, kinds, unigram = Counter(), Counter(), Counter()
        for (a, b), n in pairs.items():
            after[a] += n
            kinds[a] += 1
            unigram[b] += n
        total = sum(unigram.values()) + len(known) + 2
        out = 0.0
        for a, b in zip(line(ws), line(ws)[1:]):
            one = (unigram[b] + 1) / total
            rest = kinds[a] / (kinds[a] + after[a]) if after[a] else 1.0
            out -= math.log((1 - rest) * (pairs[a, b] / after[a] if after[a] else 0) + rest * one)
        other = Counter(w for x in sample for w in x if w not in known)
        every = sum(other.values()) + len(count) - len(known) + 1
        return (out - sum(math.log((other[w] + 1) / every) for w in ws if w not in known)) / (len(ws) + 1)

    asked = [*texts, "the unheard of word", "the unheard of word"]
    rows = spark.createDataFrame([*enumerate(texts), (9, asked[-1]), (9, asked[-1]), (9, "cat"), (None, "cat")], "doc_id long, text string")
    got = lm.score(rows, model).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in got) == sorted([(False, i, len(w) + 1) for i, w in enumerate(words)] + [(False, 9, 5), (False, 9, 5), (False, 9, 2), (True, 0, 2)])
    for r in got:
        ws = words[r.doc_id] if r.doc_id in range(len(words)) else asked[-1].split() if r.n_tokens == 5 else ["cat"]
        assert r.background_loss == pytest.approx(loss(words, ws), abs=1e-5)
        assert r.target_loss == pytest.approx(loss([words[0], words[4]], ws), abs=1e-5)
        assert r.difference == pytest.approx(r.target_loss - r.background_loss)


def test_language_models_grow_with_the_corpus(spark):
    sizes = []
    for sf in ("sf0.001", "sf0.01"):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
        model = lm.fit(docs, docs.limit(0), 1000, 500)
        words = {w for r in docs.select("text").collect() for w in words_of([r.text or ""]).hash.tolist()}
        assert 0 < len(model.tables.head) <= 500 and len(words) == 1000 + len(model.tables.head) + model.tail.count()
        sizes.append(len(words))
    assert sizes[1] > 2 * sizes[0]


def test_pipeline(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "decontamination", "token_ids"]
    ids = [r.doc_id for r in got.collect()]
    assert len(set(ids)) == len(ids) and 0 < len(ids) < docs.count()
    odd = spark.createDataFrame([(*r, "en", "s", 1) for r in ODD], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, "/root/testdata/sf0.001")
        assert name == "token_ids" or out.columns == docs.columns
        out.collect()
        assert stage(spark, odd.limit(0), "/root/testdata/sf0.001").count() == 0


def test_folds(spark):
    df = spark.createDataFrame([(5,), (-7,), (None,)], "doc_id long").select("doc_id", remainder(4).alias("r"))
    assert {r.doc_id: r.r for r in df.collect()} == {5: zlib.crc32(b"5") % 4, -7: zlib.crc32(b"-7") % 4, None: 0}
