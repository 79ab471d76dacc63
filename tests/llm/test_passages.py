"""Repeated passages and paragraphs against brute force."""

import random
from collections import defaultdict

import pytest

from tallycast.llm import passages as p

WORDS = [f"{a}{b}" for a in "kr st el mo an tu vi".split() for b in "ar en il os u ta ke ri zo".split()]


def prose(rnd, n, lines=0):
    out = [rnd.choice(WORDS) for _ in range(n)]
    for _ in range(lines):
        out[rnd.randrange(n)] += ".\n"
    return " ".join(out)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    texts = [prose(rnd, rnd.randint(0, 160), rnd.choice([0, 3])) for _ in range(60)]
    passage = prose(rnd, 56)
    multi = prose(rnd, 70, 3)
    long_line = prose(rnd, 110).split(" ")
    for i in (3, 9, 20, 31):
        w = texts[i].split(" ")
        texts[i] = " ".join([*w[:7], passage, *w[7:]])
    for i in (4, 12):
        texts[i] = texts[i] + " tail " + multi + " end"
    for i in (5, 15, 25):
        edit = list(long_line)
        edit[i * 3] = "changed"
        texts[i] = texts[i] + "\n" + " ".join(edit) + "\nlast"
    texts += [texts[7], texts[7] + "", "short", "short", "", None, "a " * 300]
    return [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[8])]


def test_nothing_repeated_is_left(spark, rows):
    docs = spark.createDataFrame([(d, t, len(t or ""), 1) for d, t in rows], "doc_id long, text string, n_chars long, node int")
    lost = p.removals(docs).collect()
    assert {r.kind for r in lost} == {"copy", "passage", "paragraph"}
    flagged = {r.doc_id for r in lost}
    assert len({3, 9, 20, 31} & flagged) == 3 and len({4, 12} & flagged) == 1 and len({5, 15, 25} & flagged) == 2
    assert flagged <= {3, 9, 20, 31, 4, 12, 5, 15, 25, 7, 60, 61, 8, None}
    out = p.deduplicated(docs)
    assert out.columns == docs.columns
    seen = defaultdict(set)
    for r in out.distinct().collect():
        assert r.n_chars == len(r.text or "")
        w = (r.text or "").replace("\n", " ").replace(".", "").split()
        for i in range(len(w) - p.LEAST + 1):
            seen[tuple(w[i : i + p.LEAST])].add((r.doc_id, r.text))
    assert max(map(len, seen.values())) == 1
    whole = " ".join(r.text or "" for r in out.collect())
    assert all(x in whole for x in ("changed", "tail", "short"))
    kept = {r.doc_id: r.text for r in out.collect()}
    assert all(kept[d] == t for d, t in rows if d not in flagged)


def test_chains_cover_every_passage():
    rnd = random.Random(6)
    for _ in range(40):
        shared = prose(rnd, p.LEAST)
        a, b = (f"{prose(rnd, rnd.randint(0, 90))} {shared} {prose(rnd, rnd.randint(0, 90))}" for _ in range(2))
        text, chain, at = p.chains_of([a, "x", b])
        assert set(chain[text == 0]) & set(chain[text == 2])


def test_cut():
    assert p.cut("ab\ncd\nef", [3], [5]) == "ab\nef"
    assert p.cut("abcdef", [1, 2, 0], [3, 4, 1]) == "ef"
    assert p.cut("abc", [], []) == "abc"


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert p.removals(docs).count() == 0 and p.deduplicated(docs).count() == 0


def windows(text):
    w = text.split()
    return {tuple(w[i : i + p.LEAST]) for i in range(len(w) - p.LEAST + 1)}


def left_after(spark, texts):
    """Texts by key (in the given order) without their passages."""
    docs = spark.createDataFrame([(i, str(i).encode(), t) for i, t in enumerate(texts)], "key long, node binary, text string")
    lost = defaultdict(list)
    for r in p.repeated_passages(docs).collect():
        assert r.kept_key < r.key
        lost[r.key].append((r.begin, r.end))
    return [p.cut(t, *zip(*lost[i])) if i in lost else t for i, t in enumerate(texts)]


def test_the_first_text_of_a_chain_has_only_a_part(spark):
    rnd = random.Random(21)
    texts: list[str] = []
    passages = [prose(rnd, p.LEAST) for _ in range(8)]
    texts += [f"{prose(rnd, 30)} before {' '.join(x.split()[:-1])} other {prose(rnd, 30)}" for x in passages]
    for i in range(2):
        texts += [f"{prose(rnd, 20)} before{i} {x} behind{i} {prose(rnd, 25)}" for x in passages]
    assert not any(windows(a) & windows(b) for a in texts[:8] for b in texts[8:])
    left = left_after(spark, texts)
    assert left[:16] == texts[:16]
    assert all(x not in t for x, t in zip(passages, left[16:]))


def test_every_place_of_a_passage_goes(spark):
    """Twice in the later text, and behind a decoy of the passage's middle in the earlier one."""
    rnd = random.Random(22)
    x = prose(rnd, 60)
    decoy = " ".join(x.split()[8:52])
    texts = [f"{prose(rnd, 20)} {decoy} {prose(rnd, 40)} one {x} one {prose(rnd, 20)}", f"{prose(rnd, 9)} {decoy} {prose(rnd, 15)} two {x} two {prose(rnd, 70)} two {x} two {prose(rnd, 8)}"]
    left = left_after(spark, texts)
    assert left[0] == texts[0] and x not in left[1] and not windows(left[1]) & windows(texts[0])
    assert len(left[1].split()) == len(texts[1].split()) - 120


def test_texts_are_cut_by_one_worker_a_task(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plan = p.deduplicated(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.partition("== Initial Plan ==")[0].count("ArrowEvalPython") == 1


def test_the_driver_plans_a_few_tables_at_once(spark, rows):
    """The joins that find the pieces are not part of the plan that cuts them, and that one shuffles the texts once."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = p.deduplicated(docs)
    query = out._jdf.queryExecution()
    assert query.optimizedPlan().collectLeaves().size() <= 8  # documents and three kinds of pieces, for rows that are cut and those that are not
    out.collect()
    final = query.executedPlan().toString().partition("== Initial Plan ==")[0]
    assert "ReusedExchange [row#" in final


def test_windows_of_many_texts_are_those_of_each_alone():
    rnd = random.Random(23)
    shared = prose(rnd, 70, 2)
    texts = [f"{prose(rnd, 30)} {shared} {prose(rnd, 9)}", "", "short", f"\u00c4rger {shared}", prose(rnd, 120)]
    chains = p.chains_of(texts)[1]
    together = list(zip(*(c.tolist() for c in p.windows_of(texts, chains))))
    alone = [(i, *w[1:]) for i, t in enumerate(texts) for w in zip(*(c.tolist() for c in p.windows_of([t], chains)))]
    assert together == alone and len({w[0] for w in together}) == 3
    for i, _, _, at, begin, end in together:
        assert texts[i][begin:end].replace(".", "").split() == texts[i].replace(".", "").split()[at : at + p.LEAST]


def test_runs_of_windows_go_on_across_batches(spark):
    places = [*range(0, 60), 110, 111, 400, 449, 499, 549]  # at 50 words or more from the last, a run ends
    rows = [(key, 1, at, 10 * at, 10 * at + 500) for key in (5, 6) for at in places] + [(5, 2, 3, 30, 530)]
    random.Random(24).shuffle(rows)
    runs = [(0, 1090), (1100, 1610), (4000, 4990), (4990, 5490), (5490, 5990)]
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "7")
    try:
        windows = spark.createDataFrame(rows, "key long, kept_key long, at long, begin long, end long")
        got = sorted(tuple(r) for r in p.merged(windows).collect())
    finally:
        spark.conf.set(limit, before)
    assert got == sorted([(key, b, e, 1) for key in (5, 6) for b, e in runs] + [(5, 30, 530, 2)])


def test_texts_are_searched_for_paragraphs_and_their_bands_at_once(spark):
    rnd = random.Random(25)
    one, other = prose(rnd, 60), prose(rnd, 55)
    docs = spark.createDataFrame([(1, b"x", f"{one}\nshort\n{other}"), (2, b"y", f"{one}\n")], "doc_id long, node binary, text string").coalesce(1)
    found = p.paragraph_rows(docs, p.LEAST).orderBy("doc_id", "begin").collect()
    assert [(r.doc_id, r.begin, r.end) for r in found] == [(1, 0, len(one)), (1, len(one) + 7, len(one) + 7 + len(other)), (2, 0, len(one))]
    bands = p.tuned_bands(p.THRESHOLD, p.RECALL, p.SLOTS)[0]
    assert found[0].paragraph == found[2].paragraph and [len(r.bands) for r in found] == [bands, bands, 0]
