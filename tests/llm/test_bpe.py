"""Byte-level BPE against the public library, and exact decoding."""

import base64
import random

import numpy as np
import public_tokenizers as P
import regex
import tiktoken

from tallycast.llm import bpe
from tallycast.llm.common import bounded, caches_of
from tallycast.llm.pretokens import automaton, pretokens

PATH = P.path("byte_bpe_50k.tiktoken")
ALPHABET = "aé1'  \n\tstmdrevl!ñ٣　’"


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pretokens_match_the_pattern():
    pattern, rnd = regex.compile(P.PATTERN), random.Random(1)
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 40))) for _ in range(2000)]
    pieces, first, _ = next(iter(pretokens(texts)))
    assert [pieces[a:b] for a, b in zip(first, first[1:])] == [pattern.findall(t) for t in texts]
    long = "".join(rnd.choice(ALPHABET) for _ in range(5000)) + "a" * 500 + " " * 300 + "b"
    assert [p for ps, _, _ in pretokens([long], window=64) for p in ps] == pattern.findall(long)
    cut = "a\U0010ffff b's\n"
    assert next(iter(pretokens([cut, "", cut])))[0] == pattern.findall(cut) * 2


def test_functions_form_a_small_monoid():
    _, compose, action, _, m = automaton()
    assert m < 64 and len(compose) == m * m and action.max() < 11


def test_operator(spark):
    rnd = random.Random(2)
    wide = "".join(chr(rnd.choice([rnd.randint(32, 0xD7FF), rnd.randint(0xE000, 0x10FFFF)])) for _ in range(3000))
    texts = ["", None, "a" * 3000, " " * 700, "İx <|endoftext|>", wide, "it's", "it's"]
    docs = spark.createDataFrame([(i if i else None, t, "extra", b"") for i, t in enumerate(texts)], "doc_id long, text string, ids string, decoded binary")
    got = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    enc = library()
    want = sorted(((t or "").encode(), enc.encode_ordinary(t or "")) for t in texts)
    assert sorted((bytes(r.decoded), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def test_round_trip_by_one_worker_a_task(spark):
    docs = spark.createDataFrame([(1, "one two\n three"), (2, None), (None, "İx it's")], "doc_id long, text string")
    both = bpe.encode_and_decode(docs, PATH)
    assert both._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(both.collect(), key=str) == sorted(bpe.decode(bpe.encode(docs, PATH), PATH).collect(), key=str)


def test_a_worker_drops_the_caches_of_another_operator():
    caches_of("bpe")
    one = bpe.ranks_of(PATH)
    caches_of("bpe")
    assert bpe.ranks_of(PATH) is one
    caches_of("neardup")
    assert bpe.ranks_of.cache_info().currsize == 0
    made = []
    cached = bounded(lambda text: made.append(text) or np.zeros(1))
    cached("a"), cached("a"), caches_of("passages"), cached("a")
    assert made == ["a", "a"]


def test_a_full_cache_keeps_the_pieces_at_hand(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 2)
    asked, cache, long = [], {}, "x" * (bpe.CACHE_CHARS + 1)

    def encode_new(pieces):
        asked.append(pieces)
        return {p: p.encode() for p in pieces}

    for step in (["a", "b", "c", "a"], ["a", "d", long, "d"], ["d", "a", "b"]):
        assert bpe.cached_ids(step, cache, encode_new) == [p.encode() for p in step]
    assert asked == [["a", "b", "c"], ["d", long], ["b"]] and long not in cache
