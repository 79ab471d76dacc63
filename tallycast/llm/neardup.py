"""Near-duplicate documents by ProbMinHash over weighted word shingles, banding and verification.

A text's elements are its shingles of five words, weighted by how often they occur. ProbMinHash draws
for each element the arrivals of a Poisson process whose rate is its weight; every arrival falls into
a random one of SLOTS slots, and a slot keeps the element that arrived first. Once all slots are
taken, arrivals later than the latest of them cannot win, so most elements stop after the first.
Two signatures agree in a slot with the probability Jaccard similarity of the two texts. Where shingles
repeat, a second signature takes each once, and agrees with the plain Jaccard similarity. Equal bands
of signatures make candidates, whose similarity is then computed from their whole texts: a pair is
linked if the probability Jaccard similarity, or the plain one of the two shingle sets, is THRESHOLD
or more. Classes are the components of links; copies of one text count as one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.llm.common import bounded, caches_of, join_on_hot_key, packed, small_batches, staged, text_key
from tallycast.llm.graph import linked_classes
from tallycast.llm.words import mix, shingles_of, steps, words_of

THRESHOLD = 0.8
RECALL = 0.999
SLOTS = 64
#: Cells of shingle hashes, for bounds of the similarity, and what rounding may cost these.
CELLS, SLACK = 4096, 1e-3
#: Shingles of one step of comparing sets all with all.
SHARED_STEP = 4096


def tuned_bands(threshold: float = THRESHOLD, recall: float = RECALL, slots: int = SLOTS) -> tuple[int, int]:
    """(bands, rows a band): the longest bands by which a pair at the threshold is found with the wanted probability."""
    for rows in range(slots, 0, -1):
        bands = slots // rows
        if 1 - (1 - threshold**rows) ** bands >= recall:
            return bands, rows
    return slots, 1


def weighted_shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, shingle and count of every different shingle of each text."""
    numbers, values, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in steps(texts):
        value, first = shingles_of(words_of(texts[a:b]))
        text = np.repeat(np.arange(a, b), np.diff(first))
        order = np.lexsort((value, text))
        value, text = value[order], text[order]
        begin = np.flatnonzero(np.concatenate(([True], (value[1:] != value[:-1]) | (text[1:] != text[:-1])))) if len(value) else np.zeros(0, np.int64)
        numbers.append(text[begin])
        values.append(value[begin])
        counts.append(np.diff(np.append(begin, len(value))))
    return np.concatenate(numbers), np.concatenate(values), np.concatenate(counts)


def prob_minhash(text: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, slots: int = SLOTS) -> np.ndarray:
    """Signature (slots elements) of each of `texts` weighted sets; of an empty set all zero."""
    first = np.full(texts * slots, np.inf)
    owner = np.zeros(texts * slots, np.uint64)
    at = np.zeros(len(element))
    live = np.arange(len(element))
    draw = 0
    while len(live):
        draw += 1
        seed = mix(element[live] + np.uint64(draw * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        at[live] += -np.log(((seed >> np.uint64(11)).astype(float) + 0.5) / 2**53) / weight[live]
        slot = text[live] * slots + (mix(seed ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(slots)).astype(np.int64)
        np.minimum.at(first, slot, at[live])
        won = first[slot] == at[live]
        owner[slot[won]] = element[live[won]]
        latest = first.reshape(texts, slots).max(1)
        live = live[at[live] < latest[text[live]]]
    return owner.reshape(texts, slots)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(signatures), bands), np.uint64)
    for j in range(rows):
        keys = mix(keys * np.uint64(0x100000001B3) + signatures[:, j : bands * rows : rows])
    return mix(keys + np.arange(bands, dtype=np.uint64)).view(np.int64)


def band_rows(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(band, node) of every different text in docs (node, text); texts without a word have no band.

    A text in which a shingle repeats has two signatures, by counts and by the set alone, one for
    either similarity; without repeats both are the same.
    """
    small_batches(docs.sparkSession)
    bands, rows = tuned_bands(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches_of("neardup")
        for batch in batches:
            of = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))  # copies at hand count once
            nodes, texts = list(of), list(of.values())
            text, element, count = weighted_shingles(texts)
            keys = band_keys(prob_minhash(text, element, count.astype(float), len(texts)), bands, rows)
            some = np.flatnonzero(np.bincount(text, minlength=len(texts)))
            again = np.unique(text[count > 1])
            if len(again):
                part = np.isin(text, again)
                sets = prob_minhash(np.searchsorted(again, text[part]), element[part], np.ones(part.sum()), len(again))
                keys, some = np.concatenate([keys[some], band_keys(sets, bands, rows)]), np.concatenate([some, again])
            else:
                keys = keys[some]
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(nodes, pa.binary()).take(pa.array(np.repeat(some, bands)))], names=["band", "node"])

    return docs.select("node", "text").mapInArrow(run, "band long, node binary")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Exact probability Jaccard and plain Jaccard of two weighted sets (sorted elements, counts)."""
    every = np.union1d(a[0], b[0])
    if not len(every):
        return 0.0, 0.0
    x, y = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
    x[np.searchsorted(every, a[0])], y[np.searchsorted(every, b[0])] = a[1], b[1]
    shared = (x > 0) & (y > 0)
    kinds, n = np.unique(np.stack([x, y]), axis=1, return_counts=True)  # elements of equal weights are alike
    kx, ky = kinds[0].astype(float), kinds[1].astype(float)
    both = np.flatnonzero((kx > 0) & (ky > 0))
    total = sum(n[k] / (n * np.maximum(kx / kx[k], ky / ky[k])).sum() for k in both)
    return float(total), float(shared.sum() / len(every))


@bounded
def _set_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    _, element, count = weighted_shingles([text])
    return element, count


def near(first: list[str], second: list[str], threshold: float = THRESHOLD) -> list[bool]:
    out = []
    for x, y in zip(first, second):
        a, b = _set_of(x), _set_of(y)
        if a[1].max(initial=1) == 1 == b[1].max(initial=1):  # without repeats both similarities are the plain one
            both = len(np.intersect1d(a[0], b[0], assume_unique=True))
            out.append(both > 0 and both >= threshold * (len(a[0]) + len(b[0]) - both))
        else:
            out.append(max(similarity(a, b)) >= threshold)
    return out


def shared_counts(first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray], sizes: tuple[int, int]) -> np.ndarray:
    """Matrix of the numbers of elements that any two sets share, by products of membership matrices. A side: number of the set, element."""
    out = np.zeros(sizes, np.int64)
    shared = np.intersect1d(first[1], second[1])
    for at in range(0, len(shared), SHARED_STEP):
        part = shared[at : at + SHARED_STEP]
        sides = []
        for (owner, element), size in zip((first, second), sizes):
            place = np.minimum(np.searchsorted(part, element), len(part) - 1)
            held = part[place] == element
            side = np.zeros((size, len(part)), np.float32)
            side[owner[held], place[held]] = 1
            sides.append(side)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    return out


def may_be_near(first: list[str], second: list[str], threshold: float = THRESHOLD, weighted: bool = True) -> np.ndarray:
    """Matrix of all pairs: 2 if the plain Jaccard similarity reaches the threshold, 1 if the probability one may, 0 if none does.

    Plain similarities are exact, and without repeated shingles both are the same. The probability Jaccard
    similarity is the chance that two draws, one from each text's shares, are equal, so it is at most
    the sum of the lesser shares, and of those of cells.
    """
    sides = [(weighted_shingles(texts), len(texts)) for texts in (first, second)]
    (a, n), (b, m) = sides
    both = shared_counts(a[:2], b[:2], (n, m))
    sizes = [np.bincount(owner, minlength=k) for (owner, _, _), k in sides]
    out = np.where((both > 0) & (both >= threshold * (sizes[0][:, None] + sizes[1][None, :] - both)), 2, 0).astype(np.uint8)
    repeats = [np.bincount(owner, count > 1, k) > 0 for (owner, _, count), k in sides]
    if weighted and (repeats[0].any() or repeats[1].any()):
        shares = []
        for (owner, element, count), k in sides:
            cell = owner * CELLS + (element % np.uint64(CELLS)).astype(np.int64)
            each = np.bincount(cell, count, k * CELLS).reshape(k, CELLS)
            shares.append((each / np.maximum(each.sum(1, keepdims=True), 1)).astype(np.float32))
        for i, x in enumerate(shares[0]):
            open_ = np.flatnonzero((out[i] == 0) & (repeats[0][i] | repeats[1]) & (both[i] > 0))
            out[i, open_[np.minimum(shares[1][open_], x).sum(1) >= threshold - SLACK]] = 1
    return out


def _nodes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("node"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) of every row, and (node, rows, first, class_id) of every different text.

    class_id is the least doc_id of the class; null ids do not count for it (it is null where a class
    has no other). Null texts count as empty; texts without words are alike only if equal.
    """
    docs = _nodes(docs)
    roots = linked_classes(band_rows(docs, threshold), docs.select("node", "text"), lambda a, b: near(a, b, threshold), lambda a, b: may_be_near(a, b, threshold))
    rows = staged(docs.select("doc_id", "node"), "rows")
    texts = rows.groupBy("node").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("first"))
    rooted = staged(texts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("class_id"), F.count(F.lit(1)).alias("texts"))
    least = staged(least, "classes")
    named = join_on_hot_key(rooted, least, "root", "texts", rooted.count())
    return rows, staged(named.select("node", "rows", "first", "class_id"), "named")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and class_id of every row of docs (see classes); other columns are ignored, an empty table gives none."""
    rows, named = classes(docs, threshold)
    return join_on_hot_key(rows, named, "node", "rows", rows.count()).select("doc_id", "class_id")


def without_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that stand for their class: the one of least doc_id (of equal ids that of the least text key), once.

    A class all of whose ids are null keeps its text of the least key. All columns stay as they are,
    whatever their names; an empty table stays empty.
    """
    _, named = classes(docs, threshold)
    best = named.where(F.col("first") == F.col("class_id")).groupBy("class_id").agg(F.min("node").alias("node"))
    unnamed = named.where("class_id is null").select(F.lit(None).cast("long").alias("class_id"), "node")
    kept = best.unionByName(unnamed).select(F.coalesce("class_id", F.lit(-(2**63))).alias("place"), "node")
    keyed = packed(docs, place=F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), node=text_key())
    return keyed.join(kept.hint("merge"), ["place", "node"], "left_semi").dropDuplicates(["place", "node"]).select("row.*")
