"""The pipeline against brute force: every stage on what the stage before kept, on a small corpus."""

import hashlib
import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tiktoken.load import load_tiktoken_bpe

import corpus_pipeline
from tallycast.llm import quality
from tallycast.llm.training import remainder

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghijklmnopqrst") for _ in range(rnd.randint(3, 8))) for _ in range(n))


def corpus():
    rnd = random.Random(11)
    item = prose(rnd, 20)
    passage, paragraph = prose(rnd, 70), prose(rnd, 80)
    texts = [prose(rnd, rnd.randint(60, 140)) for _ in range(60)]
    texts += [prose(rnd, 30) + "\n" + paragraph, prose(rnd, 45) + "\n" + paragraph, prose(rnd, 52) + "\n" + paragraph]
    texts += [f"{prose(rnd, 55)} {passage} {prose(rnd, 51)}" for _ in range(3)]
    texts += [texts[0], texts[0] + " end", texts[1].rsplit(" ", 1)[0], texts[2]]
    words = item.split()
    words[4] = "other"
    texts += [f"{prose(rnd, 40)} {item} {prose(rnd, 40)}", f"{prose(rnd, 40)} {' '.join(words)}", f"{prose(rnd, 40)} {' '.join(item.split()[:10])}"]
    junk = [" ".join(["buy now"] * rnd.randint(20, 90)) + "!!! $$$ 1234 " * rnd.randint(5, 30) for _ in range(30)]
    rows = [(i * 3, t) for i, t in enumerate([*texts, *junk, None, ""])]
    labels = [(d, 0 if t in junk else 1) for d, t in rows if t]
    return rows, labels, item


def words_of(text):
    return text.lower().split()


def chains(text, n):
    w = words_of(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def near_groups(texts):
    """Components of texts whose sets of five words have a Jaccard similarity of 0.8 or more."""
    sets = {d: chains(t or "", 5) for d, t in texts.items()}
    group = {d: d for d in texts}
    for a, b in combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if (texts[a] or "") == (texts[b] or "") or both and both >= 0.8 * len(sets[a] | sets[b]):
            old, new = sorted((group[a], group[b]), reverse=True)
            group = {d: new if g == old else g for d, g in group.items()}
    out = defaultdict(set)
    for d, g in group.items():
        out[g].add(d)
    return out


def overlaps(text, item):
    """Whether 11 of 13 aligned words are equal anywhere."""
    a, b = words_of(text), words_of(item)
    for shift in range(-len(b), len(a)):
        same = [0 <= i + shift < len(a) and a[i + shift] == w for i, w in enumerate(b)]
        if any(sum(same[i : i + 13]) >= 11 for i in range(len(b))):
            return True
    return False


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows, labels, item = corpus()
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], COLUMNS)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = f"{folder}/{name}"
        stage(spark, out[-1], folder).write.parquet(path)
        out.append(spark.read.parquet(path))
    return folder, item, out


def texts_of(df):
    rows = df.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    return {r.doc_id: r.text for r in rows}


def test_quality(spark, stages):
    folder, _, out = stages
    model = quality.fit_on(out[0], spark.read.parquet(f"{folder}/labels.parquet"), remainder(4) == 2)
    before, after = texts_of(out[0]), texts_of(out[1])
    x = dict(zip(quality.STATISTICS, quality.statistics([t or "" for t in before.values()]).T))
    total = model.bias + sum(w * r.holds(x) for r, w in model.rules) + np.zeros(len(before))
    assert after == {d: t for (d, t), s in zip(before.items(), 1 / (1 + np.exp(-total))) if s >= corpus_pipeline.LEAST_QUALITY}
    assert not any(t and "$$$" in t for t in after.values()) and len(after) > 60


def test_near_duplicates(stages):
    before, after = texts_of(stages[2][1]), texts_of(stages[2][2])
    groups = near_groups(before)
    assert any(len(g) > 2 for g in groups.values())
    assert after == {min(g): before[min(g)] for g in groups.values()}


def test_repeated_passages(stages):
    before, after = texts_of(stages[2][2]), texts_of(stages[2][3])
    seen = defaultdict(set)
    for d, t in before.items():
        for c in chains(t or "", 50):
            seen[c].add(d)
    repeated = {c for c, ds in seen.items() if len(ds) > 1}
    assert repeated
    owners = defaultdict(set)
    for d, t in after.items():
        for c in chains(t or "", 50) & repeated:
            owners[c].add(d)
    assert owners.keys() == repeated and all(len(ds) == 1 for ds in owners.values())  # each stays, in one text
    for d, t in before.items():
        held = words_of(t or "")
        gone = np.zeros(len(held), bool)
        for i in range(len(held) - 49):
            gone[i : i + 50] |= tuple(held[i : i + 50]) in repeated
        left = words_of(after.get(d) or "")
        unique = [w for w, g in zip(held, gone) if not g]
        assert left in (held, unique)


def test_decontamination(stages):
    _, item, out = stages
    before, after = texts_of(out[3]), texts_of(out[4])
    assert after == {d: t for d, t in before.items() if not overlaps(t or "", item)}
    assert len(before) - len(after) == 2


def test_token_ids(spark, stages):
    folder, _, out = stages
    ranks = load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = set()
    for d, t in texts_of(out[4]).items():
        ids = library.encode_ordinary(t or "")
        want.add((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    columns = "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"
    assert {tuple(r[c] for c in columns) for r in out[5].collect()} == want
    assert {tuple(r[c] for c in columns) for r in corpus_pipeline.run(spark, folder).collect()} == want
