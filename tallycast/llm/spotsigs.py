"""Document fingerprints by SpotSigs: chains of content words that follow common words.

A common word (an antecedent) that occurs in a text starts a chain of the next CHAIN content words,
skipping common ones; antecedent and chain together are one spot signature. The fingerprint is the
set of a text's signatures, as hashes, written as text, so likeness needs nothing but fingerprints:
it is the Jaccard similarity of the two sets. A text without any full chain is fingerprinted by its
words, and one without words by its visible characters, so that equal texts, and only texts alike,
are alike. Empty texts have an empty fingerprint; two of them are alike (1), one and another text
are not (0).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.llm.common import partitions, small_batches, staged
from tallycast.llm.words import STEP, code_points, mix, steps, words_of

CHAIN = 2
#: Frequent function words of English, German, French and Spanish.
COMMON = """
a an and are as at be by for from has he in is it of on or that the this to was were which with
auf aus bei das dem den der des die ein eine er für ich im in ist mit nicht sich sie und von zu
au avec ce dans de des du elle en est et il la le les ne par pas pour que qui sur un une
al como con de del el en es la las lo los no para por que se su un una y
""".split()
#: Fingerprints are 32-bit hashes: 4 bytes a signature.
KIND = "<u4"
#: Set lengths of one partition differ by less than this threshold allows.
THRESHOLD = 0.8
#: Sentinel of a null doc_id in the order of documents.
LOWEST = -(2**63)


@lru_cache(1)
def common_hashes() -> np.ndarray:
    return np.unique(words_of(sorted(set(COMMON))).hash)


def _signature_sets(texts: list[str]) -> list[np.ndarray]:
    w = words_of(texts)
    n = len(w.hash)
    common = common_hashes()
    at = np.minimum(np.searchsorted(common, w.hash), len(common) - 1)
    anchor = common[at] == w.hash
    content = np.flatnonzero(~anchor)
    text = np.repeat(np.arange(len(texts)), w.count)
    spots = np.flatnonzero(anchor)
    begin = np.searchsorted(content, spots)
    full = begin + CHAIN <= len(content)
    last = content[np.minimum(begin + CHAIN - 1, max(len(content) - 1, 0))] if len(content) else np.zeros(len(spots), np.int64)
    full &= text[last] == text[spots] if n else full
    spots, begin = spots[full], begin[full]
    value = w.hash[spots].copy()
    for j in range(CHAIN):
        value = value * STEP + w.hash[content[begin + j]]
    value = (mix(value) >> np.uint64(32)).astype(KIND)
    cut = np.searchsorted(text[spots], np.arange(len(texts) + 1))
    out = []
    for d in range(len(texts)):
        part = value[cut[d] : cut[d + 1]]
        if not len(part):
            part = (w.hash[w.first[d] : w.first[d + 1]] >> np.uint64(32)).astype(KIND)
        if not len(part) and texts[d]:
            seen = code_points(texts[d]).astype(np.uint64)
            part = (mix(seen * STEP + np.uint64(len(seen))) >> np.uint64(32)).astype(KIND)
        out.append(np.unique(part))
    return out


def signature_sets(texts: list[str]) -> list[np.ndarray]:
    return [s for a, b in steps(texts) for s in _signature_sets(texts[a:b])]


def written(signatures: np.ndarray) -> str:
    return base64.b64encode(signatures.astype(KIND).tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), KIND)


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets; 0 at once where their lengths alone keep it below `least`."""
    if not len(a) and not len(b):
        return 1.0
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = len(a) + len(b) - len(np.union1d(a, b))
    return both / (len(a) + len(b) - both)


def edited(text: str, following: str) -> str:
    """The last half of the text is replaced by as much of the next one's beginning."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


PAIRS = "doc_id long, text string, next_text string"


def _cells(bounds: np.ndarray, edges: dict[int, int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their cell; the first document of a cell goes also behind the last of the cell before."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        cell = np.searchsorted(bounds, ids, "left").astype(np.int64)
        again = np.array([i for i, x in enumerate(ids.tolist()) if x in edges], np.int64)
        take = np.concatenate([np.arange(len(ids)), again]).astype(np.int64)
        to = np.concatenate([cell, [edges[x] for x in ids[again].tolist()]]).astype(np.int64)
        tail = np.concatenate([np.zeros(len(ids), bool), np.ones(len(again), bool)])
        rows = batch.take(pa.array(take))
        yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(tail), rows.column(0), rows.column(1), rows.column(2)], names=["cell", "tail", "place", "doc_id", "text"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document with the one after it in its cell; the row of the cell behind gives a text only."""
    held: tuple[int, int | None, str] | None = None
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("next_text", pa.string())])
    for batch in batches:
        out: list[tuple] = []
        for cell, tail, doc, text in zip(*(batch.column(c).to_pylist() for c in ("cell", "tail", "doc_id", "text"))):
            if held and held[0] == cell:
                out.append((held[1], held[2], text))
            held = None if tail else (cell, doc, text)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def following(docs: DataFrame, cells_a_task: int = 4) -> DataFrame:
    """doc_id, text and next_text, the text of the next document in descending doc_id order (the first follows the last).

    Texts are shuffled once, to cells of neighbouring ids; the driver holds one id a cell. Equal ids
    are ordered by their texts; null ids come last; null texts count as empty.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce("doc_id", F.lit(LOWEST)).alias("place"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    count = cells_a_task * partitions(spark)
    shares = [i / count for i in range(1, count)]
    bounds = sorted(set(rows.agg(F.percentile_approx("place", shares, 100 * count).alias("b")).first().b or [])) if shares else []
    edges_schema = "cell long, most long"

    def most(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cell = np.searchsorted(np.array(bounds, np.int64), b["place"].to_numpy(), "left").astype(np.int64)
            yield b["place"].groupby(cell).max().rename_axis("cell").reset_index(name="most")

    firsts = rows.select("place").mapInPandas(most, edges_schema).groupBy("cell").agg(F.max("most").alias("most")).collect()
    firsts = sorted((r.cell, r.most) for r in firsts)
    edges = {firsts[i][1]: firsts[i + 1][0] if i + 1 < len(firsts) else firsts[0][0] for i in range(len(firsts))}
    dealt = rows.mapInArrow(partial(_cells, np.array(bounds, np.int64), edges), "cell long, tail boolean, place long, doc_id long, text string")
    # A cell with one row in the tail holds all rows of that id; only the first of them follows.
    near = dealt.repartition(partitions(spark), "cell").sortWithinPartitions("cell", "tail", F.desc("place"), F.xxhash64("text"), "text")
    return near.mapInArrow(_pairs, PAIRS)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, after = batch.column("text").to_pylist(), batch.column("next_text").to_pylist()
        changed = [edited(t, x) for t, x in zip(texts, after)]
        of = dict(zip(every := list(dict.fromkeys([*texts, *after, *changed])), signature_sets(every)))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array(changed, pa.string()),
                pa.array([written(of[t]) for t in texts], pa.string()),
                pa.array([written(of[t]) for t in changed], pa.string()),
                pa.array([likeness(of[t], of[c]) for t, c in zip(texts, changed)], pa.float64()),
                pa.array([likeness(of[t], of[x]) for t, x in zip(texts, after)], pa.float64()),
            ],
            names=["doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )


def probes(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next document's."""
    schema = "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return following(docs).mapInArrow(_fingerprints, schema)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every whole text; null counts as empty; rows and null doc_ids stay as they are."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = signature_sets(batch.column(1).fill_null("").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(written, sets), pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def similar(prints: DataFrame, least: float = THRESHOLD) -> DataFrame:
    """Pairs of different fingerprints with a likeness of `least` or more: fingerprint a, fingerprint b, likeness.

    Sets are partitioned by length: set lengths of a pair differ by a factor of 1/least at most, so a
    set meets those of its own length band and of the next. Within a band two sets are compared only
    if they share one of their rarest signatures (the prefix that a likeness of `least` must touch),
    each pair once, and merging stops by length before it starts. Copies stand for one fingerprint.
    """
    spark = prints.sparkSession
    small_batches(spark)
    step = -np.log(least)

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for f in b["fingerprint"]:
                s = read(f)
                if len(s):
                    band = int(np.log(len(s)) / step)
                    prefix = np.sort(mix(s.astype(np.uint64)).astype(np.int64))[: len(s) - int(np.ceil(least * len(s) - 1e-9)) + 1]
                    yield pd.DataFrame({"fingerprint": f, "size": len(s), "band": band, "signature": prefix})

    distinct = prints.select("fingerprint").distinct()
    spots = staged(distinct.mapInPandas(keys, "fingerprint string, size long, band long, signature long"), "spots")
    left = spots.select(F.col("fingerprint").alias("a"), F.col("size").alias("n"), F.explode(F.array("band", F.col("band") + 1)).alias("band"), "signature")
    right = spots.select(F.col("fingerprint").alias("b"), F.col("size").alias("m"), "band", "signature")
    met = left.join(right, ["band", "signature"]).where((F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("a") < F.col("b"))))
    met = met.where(F.col("n") >= least * F.col("m")).select("a", "b").distinct()

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["likeness"] = [likeness(read(x), read(y), least) for x, y in zip(b["a"], b["b"])]
            yield b[b["likeness"] >= least]

    return met.mapInPandas(compare, "a string, b string, likeness double")


