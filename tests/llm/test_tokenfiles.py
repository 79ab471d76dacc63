"""Token files: exact round trip against the library on whole texts, and keyed access."""

import random

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tallycast.llm import tokenfiles as tf

TEXTS = ["", None, "It's we'll 'tis\n\n  x  ", "ab " * 3000, "née 12345 ４５ !!! 's's", "same", "same"]


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    folder = "file://" + str(tmp_path_factory.mktemp("shards"))
    rows = [(i * 7, t, "x") for i, t in enumerate(TEXTS)] + [(14, "again", "y"), (None, "no key", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    return rows, folder, tf.write(docs, P.path("byte_bpe_50k.json"), folder, shard_bytes=64)


def whole(text):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return t.encode(text or "", add_special_tokens=False).ids + [0]


def test_round_trip(spark, written):
    rows, folder, manifest = written
    got = tf.read_all(manifest, folder).collect()
    want = sorted((r[0] if r[0] is not None else -1, whole(r[1])) for r in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += len(r.ids) // 4


def test_keyed_access(spark, written):
    _, folder, manifest = written
    keys = spark.createDataFrame([(0,), (14,), (21,), (22,), (-5,), (10**12,), (None,), (21,)], "doc_id long")
    got = tf.look_up(keys, manifest, folder).collect()
    assert sorted(r.doc_id for r in got) == [0, 14, 14, 21]
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in got if r.doc_id == 21] == [whole(TEXTS[3])]


def test_one_key_for_all_rows(spark, tmp_path):
    folder = f"file://{tmp_path}"
    docs = spark.range(400).selectExpr("cast(5 as long) as doc_id", "concat('word ', id) as text")
    manifest = tf.write(docs, P.path("byte_bpe_50k.json"), folder, shard_bytes=256)
    assert manifest.select("part").distinct().count() > 1 and manifest.count() > 4
    want = sorted(whole(f"word {i}") for i in range(400))
    for got in (tf.read_all(manifest, folder), tf.look_up(spark.createDataFrame([(5,), (6,)], "doc_id long"), manifest, folder)):
        rows = sorted(got.collect(), key=lambda r: r.start)
        assert sorted(np.frombuffer(r.ids, "<u4").tolist() for r in rows) == want
        assert [r.start for r in rows[1:]] == np.cumsum([len(r.ids) // 4 for r in rows])[:-1].tolist()


class Counted:
    """A file that counts the bytes read from it."""

    def __init__(self, raw):
        self.raw, self.read = raw, 0

    def size(self):
        return len(self.raw)

    def read_at(self, n, at):
        self.read += n
        return self.raw[at : at + n]


def test_a_look_up_reads_as_little_of_a_large_index_as_of_a_small_one():
    read = []
    for n in (10**3, 10**5):
        keys = list(range(0, 3 * n, 3))
        raw = tf.pack_index(tf.build_index(keys, [2] * n), 2)
        source = Counted(raw)
        index, _ = tf.stored_index(source)
        for k in range(200):
            first, copies = tf.find(index, np.array([keys[k * n // 200]], np.int64))
            assert copies.tolist() == [1] and index["offset"][first].tolist() == [2 * (k * n // 200)]
        read.append((source.read - tf.HEAD_BYTES) / 200)
        assert tf.find(index, np.array([1], np.int64))[1].tolist() == [0]
    assert max(read) < 100


def test_empty_table(spark, tmp_path):
    folder = f"file://{tmp_path}"
    manifest = tf.write(spark.createDataFrame([], "doc_id long, text string"), P.path("byte_bpe_50k.json"), folder)
    assert manifest.count() == 0 and tf.read_all(manifest, folder).count() == 0
    assert tf.look_up(spark.createDataFrame([(1,)], "doc_id long"), manifest, folder).count() == 0


def test_hash_is_minimal_and_perfect():
    rnd = random.Random(5)
    for n in (0, 1, 2, 1000, 20000):
        keys = np.array(sorted({rnd.getrandbits(62) for _ in range(n)}), np.int64)
        h = tf.build_hash(keys)
        assert sorted(tf.slots_of(h, keys).tolist()) == list(range(len(keys)))
    index = tf.build_index(keys.tolist(), [1] * len(keys))
    foreign = np.array([rnd.getrandbits(62) for _ in range(5000)], np.int64)
    assert tf.find(index, foreign)[1].sum() == 0
    first, copies = tf.find(index, keys)
    assert (copies == 1).all() and (first == np.arange(len(keys))).all()
