"""Cross-entropy difference: how much likelier a text is under a target model than under a background model.

Both models are of the same form over one vocabulary, all words of the whole corpus. The CLASSES most
frequent words are classes of their own, all other words make up one more; a text begins and ends with
a mark. A word's probability is that of its class after the class before it, times the word's share in
its class. The former is a bigram share interpolated with the class's own share (Witten-Bell: the more
different classes follow, the more weight the latter has), which is smoothed by one count a class; the
latter is smoothed by one count a word, with one count more for words that the corpus has not.
The background model counts every document, the target model those labelled good.

The table of shares has a row for every different word of the corpus, so it grows with the corpus and
stays distributed. Only its head, words from such a count on that HEAD words at most have it, goes to
the tasks beside the tables of (CLASSES + 3) ** 2 class bigrams. What a document has of the other
words is joined with the table by word; none of them is frequent, so no key is hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.llm.common import small_batches, staged
from tallycast.llm.words import Words, steps, words_of

CLASSES = 1000
#: Words whose shares are broadcast at most (16 bytes each).
HEAD = 1 << 17
#: Cells of word counts a doubling, from which the least count of the head is chosen.
GRADES = 16


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """word (hash) and n over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            found = [words_of(texts[a:b]).hash.view(np.int64) for a, b in steps(texts)]
            word, n = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(n.astype(np.int64))], names=["word", "n"])

    return _texts(docs).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, size: int = CLASSES) -> np.ndarray:
    """Sorted hashes of the most frequent words; equal counts are ordered by hash."""
    top = counts.orderBy(F.desc("n"), "word").limit(size).collect()
    return np.sort(np.array([r.word for r in top], np.int64))


def head_count(counts: DataFrame, most: int = HEAD) -> int:
    """A least count that at most `most` words have."""
    grade = F.floor(F.log2("n") * GRADES)
    held, least = 0, 2**62
    for r in counts.groupBy(grade.alias("grade")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).orderBy(F.desc("grade")).collect():
        held += r.words
        if held > most:
            break
        least = r.least
    return least


def numbers_of(w: Words, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bigram codes (first * (V + 3) + second) of all texts, first offsets by text, and which words are of the common class.

    V is the class of all words not in `classes`, V + 1 begin, V + 2 end.
    """
    v, texts = len(classes), len(w.first) - 1
    word = w.hash.view(np.int64)
    at = np.minimum(np.searchsorted(classes, word), max(v - 1, 0))
    number = np.where(classes[at] == word, at, v) if v else np.full(len(word), v)
    count = w.count
    line = np.empty(len(word) + 2 * texts, np.int64)
    begin = w.first[:-1] + 2 * np.arange(texts)
    inside = np.ones(len(line), bool)
    inside[begin] = inside[begin + count + 1] = False
    line[begin], line[begin + count + 1], line[inside] = v + 1, v + 2, number
    pairs = line[:-1] * (v + 3) + line[1:]
    keep = np.ones(len(pairs), bool)
    keep[begin[1:] - 1] = False
    return pairs[keep] if texts else pairs[:0], np.concatenate(([0], np.cumsum(count + 1))), number == v


def bigram_counts(docs: DataFrame, classes: np.ndarray) -> np.ndarray:
    """Square table of class bigram counts over all texts of docs."""
    side = len(classes) + 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            found = [numbers_of(words_of(texts[a:b]), classes)[0] for a, b in steps(texts)]
            pair, n = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n.astype(np.int64))], names=["pair", "n"])

    got = _texts(docs).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(side * side)
    out[got["pair"].to_numpy(np.int64)] = got["n"].to_numpy(float)
    return out.reshape(side, side)


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """Natural logarithms of the interpolated bigram probabilities, flat by bigram code."""
    follow = counts.sum(0) + 1
    follow[-2] = 0  # nothing is followed by the begin mark
    unigram = follow / follow.sum()
    after, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
    share = np.divide(counts, after, out=np.zeros_like(counts), where=after > 0)
    rest = np.divide(kinds, kinds + after, out=np.ones_like(after), where=after > 0)
    with np.errstate(divide="ignore"):
        return np.log((1 - rest) * share + rest * unigram).astype(np.float32).ravel()


@dataclass
class Tables:
    """What tasks score with: classes, class bigrams, and log shares of the head of the other words."""

    classes: np.ndarray
    bigrams: tuple[np.ndarray, np.ndarray]
    head: np.ndarray
    shares: tuple[np.ndarray, np.ndarray]


@dataclass
class Model:
    """Tables, the log shares of all other words (word, target, background), and those of a word never seen."""

    tables: Tables
    tail: DataFrame
    unseen: tuple[float, float]


def fit(docs: DataFrame, target: DataFrame, size: int = CLASSES, most: int = HEAD) -> Model:
    """Models of all documents and of the target documents, over all words of all documents.

    Words of target documents that docs has not count as unseen. Null texts count as empty; empty
    tables give models in which all words are alike. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    counts = staged(word_counts(docs), "words")
    classes = most_frequent(counts, size)
    bigrams = log_probabilities(bigram_counts(target, classes)), log_probabilities(bigram_counts(docs, classes))
    top = spark.createDataFrame([(int(w),) for w in classes], "word long")
    others = counts.join(F.broadcast(top), "word", "left_anti").join(word_counts(target).withColumnRenamed("n", "m"), "word", "left")
    others = staged(others.select("word", "n", F.coalesce("m", F.lit(0)).alias("m")), "other-words")
    whole = others.agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n"), F.sum("m").alias("m")).first()
    unseen = tuple(-float(np.log((whole[c] or 0) + whole.words + 1)) for c in ("m", "n"))
    shares = others.select("word", "n", *[(F.log(F.col(c) + 1.0) + F.lit(u)).alias(name) for c, u, name in zip(("m", "n"), unseen, ("target", "background"))])
    least = head_count(others, most)
    head = shares.where(F.col("n") >= least).orderBy("word").toPandas()
    tables = Tables(classes, bigrams, head["word"].to_numpy(np.int64), (head["target"].to_numpy(float), head["background"].to_numpy(float)))
    return Model(tables, shares.where(F.col("n") < least).drop("n"), unseen)


def score_texts(t: Tables, texts: list[str]) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Tokens (with the end mark) of each text, its log probabilities (target, background) as far as the tables go, and
    what is left: text number, word and count."""
    count, logs = [np.zeros(0, np.int64)], [np.zeros((0, 2))]
    left: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
    for a, b in steps(texts):
        w = words_of(texts[a:b])
        pairs, first, common = numbers_of(w, t.classes)
        count.append(np.diff(first))
        owner, word = np.repeat(np.arange(b - a), w.count)[common], w.hash.view(np.int64)[common]
        at = np.minimum(np.searchsorted(t.head, word), max(len(t.head) - 1, 0))
        known = t.head[at] == word if len(t.head) else np.zeros(len(word), bool)
        of_class = [np.add.reduceat(table[pairs].astype(float), first[:-1]) for table in t.bigrams]
        of_word = [np.bincount(owner[known], share[at[known]], b - a) for share in t.shares]
        logs.append(np.column_stack([c + s for c, s in zip(of_class, of_word)]))
        owner, word = owner[~known], word[~known]
        order = np.lexsort((word, owner))
        owner, word = owner[order], word[order]
        begin = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (word[1:] != word[:-1]))[: len(word)])
        for out, x in zip(left, (owner[begin] + a, word[begin], np.diff(np.append(begin, len(word))))):
            out.append(x)
    return np.concatenate(count), np.vstack(logs), tuple(map(np.concatenate, left))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (nats a token) and difference (target less background; lower: more like the target).

    Null texts count as empty; an empty text has one token, the end mark. Rows alike in doc_id and text
    are scored together and given back once each; null doc_ids stay. Other columns are ignored, an
    empty table gives none. Texts are told apart by doc_id and 64 bits.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model.tables)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    names = ["doc_id", "key", "word", "n", "n_tokens", "target", "background"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id, key, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            n, logs, (row, word, count) = score_texts(shared.value, texts)
            whole = [doc_id, key, key, pa.array(np.zeros(len(n), np.int64)), pa.array(n.astype(np.int64)), pa.array(logs[:, 0]), pa.array(logs[:, 1])]
            yield pa.RecordBatch.from_arrays(whole, names=names)
            at, none = pa.array(row), pa.nulls(len(row), pa.float64())
            yield pa.RecordBatch.from_arrays([doc_id.take(at), key.take(at), pa.array(word), pa.array(count.astype(np.int64)), pa.nulls(len(row), pa.int64()), none, none], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    # A row of a whole text stands under its key in place of a word, with no count, so these rows spread.
    parts = rows.mapInArrow(run, "doc_id long, key long, word long, n long, n_tokens long, target double, background double")
    shares = model.tail.select("word", F.col("target").alias("t"), F.col("background").alias("b"))
    met = parts.join(shares, "word", "left")
    logs = [F.sum(F.coalesce(c, F.lit(0.0)) + F.col("n") * F.coalesce(s, F.lit(u))).alias(c) for c, s, u in zip(("target", "background"), ("t", "b"), model.unseen)]
    each = met.groupBy("doc_id", "key").agg(F.count("n_tokens").alias("rows"), F.sum("n_tokens").alias("tokens"), *logs)
    lost = each.select("doc_id", "rows", "tokens", *[(-F.col(c) / F.col("tokens")).alias(f"{c}_loss") for c in ("target", "background")])
    again = lost.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    out = again.select("doc_id", F.expr("tokens div rows").alias("n_tokens"), "target_loss", "background_loss")
    return out.withColumn("difference", F.col("target_loss") - F.col("background_loss"))


def labelled(docs: DataFrame, labels: DataFrame, label: str = "quality", value: int = 1) -> DataFrame:
    """The documents that carry a label. Labels grow with the documents, so they are never broadcast.

    Null ids and null labels match nothing; a document with several labels is kept if one of them is the value.
    """
    return docs.join(labels.where(F.col(label) == value).select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")


def most_like_target(scores: DataFrame, below: float = 0.0) -> DataFrame:
    """Scores of the documents likelier under the target model by the given margin."""
    return scores.where(F.col("difference") < below)
