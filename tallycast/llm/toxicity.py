"""Toxicity by compression distance: which of two zstandard dictionaries makes a text shorter.

Two dictionaries are trained from labelled rows. The ordinary one is trained on ordinary text; the
toxic one is trained on what toxic texts hold and ordinary texts lack, and stands before the same
ordinary content, so that both compress ordinary text alike and their difference is due to toxic
content. (Plain dictionaries of either class differ mostly by chance: 0.77 of held-out area under
the curve on the test tables, against 0.98.) Near copies are counted once when words are compared
between classes. A text is cut into windows at blanks; the bytes that the toxic dictionary saves in
each window are summed up in a few statistics, which a logistic fit calibrates to a score. A
penalised fit sees both classes with equal weight; the threshold on its score is THRESHOLD.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame

from tallycast.llm.common import small_batches
from tallycast.llm.training import training_rows
from tallycast.llm.words import SEP, fold, steps, words_of

WINDOW = 200
THRESHOLD = 0.7
#: Sizes of the dictionaries in bytes.
ORDINARY_BYTES, TOXIC_BYTES = 16384, 4096
#: A word marks a class if it is so many times as frequent there, and in so many different texts.
RATIO, LEAST_TEXTS = 20.0, 5
#: A text counts as a near copy if this share of its sampled word chains was seen before.
COPIED = 0.3
FLAT = 1.0
#: Labelled rows of each class that are learned from at most: the driver holds their texts.
TRAIN_ROWS = 2500


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    bias: float


def windows(text: str, size: int = WINDOW) -> list[bytes]:
    """Windows of about `size` bytes of the lower-cased text, cut at blanks where there are any."""
    raw = b" " + text.lower().encode() + b" "
    out, at = [], 0
    while at < len(raw):
        end = at + size
        if end < len(raw):
            cut = raw.rfind(b" ", at + size // 2, end)
            end = cut if cut > at else end
        out.append(raw[at : end + 1])
        at = end if end + 1 < len(raw) else len(raw)
    return out


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    settings = zstandard.ZstdCompressionParameters.from_level(3, min_match=6, strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings)


class Gauge:
    """Statistics of the bytes saved by the toxic dictionary."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = _compressor(ordinary), _compressor(toxic + ordinary)

    def statistics(self, text: str) -> list[float]:
        parts = windows(text)
        plain, toxic = self.ordinary.compress, self.toxic.compress
        saved = np.array([len(plain(w)) - len(toxic(w)) for w in parts], float)
        top = np.sort(saved)[::-1]
        gain = np.maximum(saved, 0)
        return [top[0], top[:3].mean(), gain.mean(), np.maximum(saved - 3, 0).mean(), saved.mean(), np.log1p(gain.sum()), np.log1p(len(parts))]


def _fresh(texts: list[str]) -> list[int]:
    """Numbers of the texts that are no near copies of earlier ones."""
    seen: set[int] = set()
    kept = []
    for i, t in enumerate(texts):
        h = words_of([t]).hash
        n = max(1, len(h) - 5)
        chains = h[:n].copy()
        for j in range(1, min(6, len(h))):
            chains = chains * np.uint64(31) + h[j : j + n]
        sample = chains[chains % np.uint64(4) == 0].tolist()
        if sum(c in seen for c in sample) <= COPIED * len(sample):
            kept.append(i)
        seen.update(sample)
    return kept


def _spelled(texts: list[str]) -> list[list[str]]:
    out, same = [], {}
    for a, b in steps(texts):
        joined = SEP.join(map(fold, texts[a:b]))
        w = words_of(texts[a:b])
        spelled = [same.setdefault(s, s) for s in (joined[x:y] for x, y in zip(w.start.tolist(), w.end.tolist()))]
        out += [spelled[x:y] for x, y in zip(w.first.tolist(), w.first[1:].tolist())]
    return out


def _dictionary(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """Content chosen by the library's trainer; tiny sets, which it refuses, are taken as they are."""
    try:
        raw = zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes()
        return raw[max(0, len(raw) - size + 256) :]
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[:size]


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Ridge logistic fit by Newton steps on a few columns."""
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    share = max(y.mean(), 1e-9)
    weight = np.where(y == 1, 0.5 / share, 0.5 / max(1 - share, 1e-9))
    w = np.zeros(z.shape[1])
    ridge = np.full(z.shape[1], FLAT)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (weight * p * (1 - p))) @ z + np.diag(ridge), z.T @ (weight * (p - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], centre, scale, float(w[-1])


def fit(texts: list[str], labels: list[int]) -> Model:
    """Dictionaries and calibration from labelled texts; one half of the texts trains the dictionaries first.

    To calibrate on differences as unseen texts have them, dictionaries of each half are measured on
    the other half; the final dictionaries are trained on all texts. Without both classes the score
    is the share of the one that is there.
    """
    y = np.array(labels, float)
    if len(set(labels)) < 2:
        share = float(y.mean()) if len(y) else 0.0
        return Model(b" ", b" ", np.zeros(7), np.zeros(7), np.ones(7), -20.0 if share == 0 else 20.0)
    spelled = _spelled(texts)
    fresh = np.array(_fresh(texts))

    def dictionaries(chosen: np.ndarray) -> tuple[bytes, bytes]:
        count = [Counter(), Counter()]
        n = [1, 1]
        for i in chosen:
            count[int(y[i])].update(set(spelled[i]))
            n[int(y[i])] += 1
        ratio = {w: ((c + 0.5) / n[1]) / ((count[0][w] + 0.5) / n[0]) for w, c in count[1].items()}
        marks = {w for w, r in ratio.items() if r > RATIO and count[1][w] >= LEAST_TEXTS}
        common = {w for w, c in count[0].items() if c >= LEAST_TEXTS and ratio.get(w, 0) < 1}
        toxic = [(" " + " ".join(s) + " ").encode() for i in chosen if y[i] == 1 and (s := [w for w in spelled[i] if w in marks])]
        plain = [(" " + " ".join(s) + " ").encode() for i in chosen if y[i] == 0 and (s := [w for w in spelled[i] if w in common])]
        return _dictionary(plain, ORDINARY_BYTES, 64, 8) or b" ", _dictionary(toxic, TOXIC_BYTES, 32, 6) or b" "

    half = np.arange(len(texts)) % 2 == 0
    x = np.zeros((len(texts), 7))
    for trained in (half, ~half):
        gauge = Gauge(*dictionaries(fresh[trained[fresh]]))
        for i in np.flatnonzero(~trained):
            x[i] = gauge.statistics(texts[i])
    ordinary, toxic = dictionaries(fresh)
    return Model(ordinary, toxic, *_logistic(x[fresh], y[fresh]))


def fit_on(docs: DataFrame, labels: DataFrame, held_out: Column) -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out (TRAIN_ROWS of each class)."""
    rows = sorted((r.doc_id, r.text, r.label) for r in training_rows(docs, labels, "toxic", held_out, TRAIN_ROWS).collect())
    order = np.random.default_rng(7).permutation(len(rows))
    return fit([rows[i][1] for i in order], [rows[i][2] for i in order])


def score_texts(model: Model, gauge: Gauge, texts: list[str]) -> np.ndarray:
    x = np.array([gauge.statistics(t) for t in texts]).reshape(len(texts), 7)
    z = ((x - model.centre) / model.scale) @ model.weights + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text; null counts as empty; rows and null doc_ids stay as they are."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gauge = Gauge(model.ordinary, model.toxic)
        for batch in batches:
            got = score_texts(model, gauge, batch.column(1).fill_null("").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
