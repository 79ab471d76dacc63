"""Substring deduplication: repeated paragraphs by MinHash banding, and repeated passages inside paragraphs.

Paragraphs are the lines of a text; those of LEAST words or more take part.

1. Paragraphs. MinHash signatures over shingles of five words are cut into bands, tuned for high
   recall at a Jaccard similarity of 0.8; paragraphs that collide are joined and their exact Jaccard
   similarity is verified; components of the verified pairs are classes. Of each class one stays.
2. Passages. A passage may be copied into the middle of another paragraph, where whole paragraphs
   are not alike. So each text also gives the 12-word chains that have the least hash of 39 following
   one another: any LEAST words in a row hold one, and the same words give the same one, wherever
   they stand. Of texts that share a chain, all windows of LEAST words that have it as their least are
   hashed, at every place; a window that an earlier text has, too, is a repeated passage, and
   overlapping ones are one.
3. A text equal to an earlier one is repeated as a whole, if it has LEAST words.

Texts are ordered by a hash of the text (copies of one text by doc_id); a passage or paragraph stays
in the first text that has it, so no removal depends on another. Repeats within one text stay, but
for paragraphs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.llm.common import caches_of, join_on_hot_key, packed, small_batches, staged, text_key
from tallycast.llm.graph import linked_classes
from tallycast.llm.neardup import band_keys, may_be_near, prob_minhash, tuned_bands, weighted_shingles
from tallycast.llm.words import STEP, Words, mix, steps, word_starts, words_of

LEAST = 50
THRESHOLD, RECALL, SLOTS = 0.8, 0.995, 24
CHAIN = 12
RUN = LEAST - CHAIN + 1
#: Stands for a null doc_id.
LOWEST = -(2**63)


def _lines(text: str) -> list[tuple[int, int]]:
    """Begin and end of each line."""
    out, at = [], 0
    for line in text.split("\n"):
        out.append((at, at + len(line)))
        at += len(line) + 1
    return out


def _paragraphs(texts: list[str], least: int) -> list[list[tuple[int, int, bytes]]]:
    """Begin, end and key of the paragraphs of `least` words or more of each text."""
    out: list[list[tuple[int, int, bytes]]] = []
    for a, b in steps(texts):
        starts = word_starts(texts[a:b])
        base = 0
        for text in texts[a:b]:
            start = starts[slice(*np.searchsorted(starts, [base, base + len(text)]))] - base
            found = []
            if len(start) >= least:
                spans = _lines(text)
                n = np.diff(np.searchsorted(start, [s[0] for s in spans] + [len(text) + 1]))
                found = [(*spans[i], hashlib.blake2b(text[spans[i][0] : spans[i][1]].strip().encode(), digest_size=16).digest()) for i in np.flatnonzero(n >= least)]
            out.append(found)
            base += len(text) + 1
    return out


def paragraph_rows(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, node (of the text), begin, end, paragraph (key) and bands of the paragraphs that take part; of equal ones of a batch only the first has bands."""
    bands, rows = tuned_bands(THRESHOLD, RECALL, SLOTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches_of("passages")
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = _paragraphs(texts, least)
            row = pa.array(np.repeat(np.arange(batch.num_rows), [len(f) for f in found]))
            flat = [p for f in found for p in f]
            b, e, k = zip(*flat) if flat else ((), (), ())
            of: dict[bytes, str] = {}
            fresh = np.zeros(len(flat) + 1, np.int32)
            for i, (d, p) in enumerate(((d, p) for d, f in enumerate(found) for p in f), 1):
                if p[2] not in of:
                    of[p[2]] = texts[d][p[0] : p[1]]
                    fresh[i] = bands
            text, element, _ = weighted_shingles(list(of.values()))
            keys = band_keys(prob_minhash(text, element, np.ones(len(element)), len(of), SLOTS), bands, rows)
            banded = pa.ListArray.from_arrays(pa.array(np.cumsum(fresh, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(row), batch.column("node").take(row), pa.array(b, pa.int64()), pa.array(e, pa.int64()), pa.array(k, pa.binary()), banded], names=["doc_id", "node", "begin", "end", "paragraph", "bands"])

    return docs.select("doc_id", "node", "text").mapInArrow(run, "doc_id long, node binary, begin long, end long, paragraph binary, bands array<long>")


def _paragraph_texts(docs: DataFrame, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            of = {k: t[b:e] for t, found in zip(texts, _paragraphs(texts, least)) for b, e, k in found}
            yield pa.RecordBatch.from_arrays([pa.array(of.keys(), pa.binary()), pa.array(of.values(), pa.string())], names=["node", "text"])

    return docs.select("text").mapInArrow(run, "node binary, text string")


def alike(first: list[str], second: list[str]) -> list[bool]:
    """Whether the exact Jaccard similarity of the shingles of each two paragraphs reaches the threshold."""
    number = {t: i for i, t in enumerate(dict.fromkeys([*first, *second]))}
    text, shingle, _ = weighted_shingles(list(number))
    sets = np.split(shingle, np.searchsorted(text, np.arange(1, len(number))))
    out = []
    for x, y in zip(first, second):
        a, b = sets[number[x]], sets[number[y]]
        every = np.sort(np.concatenate((a, b)))  # no set has a shingle twice
        both = np.count_nonzero(every[1:] == every[:-1])
        out.append(bool(both >= THRESHOLD * (len(a) + len(b) - both)))
    return out


def repeated_paragraphs(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, node, begin, end of paragraphs of a class that are not its first, and kept_doc_id."""
    found = staged(paragraph_rows(docs, least), "paragraphs")
    bands = found.select(F.explode("bands").alias("band"), F.col("paragraph").alias("node"))
    roots = linked_classes(bands, _paragraph_texts(docs, least), alike, lambda a, b: may_be_near(a, b, THRESHOLD, weighted=False)).withColumnRenamed("node", "paragraph")
    rows = found.drop("bands")
    counted = rows.groupBy("paragraph").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "doc_id", "begin")).alias("first"))
    rooted = counted.join(roots, "paragraph", "left").withColumn("root", F.coalesce("root", "paragraph"))
    rooted = staged(rooted, "rooted")
    best = rooted.groupBy("root").agg(F.min("first").alias("best"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds")).where("all > 1")
    named = join_on_hot_key(rooted.select("paragraph", "n", "root"), staged(best, "best"), "root", "kinds", rooted.count())
    total = rows.count()
    kept = join_on_hot_key(rows, staged(named.select("paragraph", "n", "best"), "named"), "paragraph", "n", total)
    other = ~(F.col("best.node").eqNullSafe(F.col("node")) & F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.begin") == F.col("begin")))
    return kept.where(other).select("doc_id", "node", "begin", "end", F.col("best.doc_id").alias("kept_doc_id"))


def _slide(x: np.ndarray, width: int, take) -> np.ndarray:
    """take (minimum or maximum) over x[i : i + width] for all i with a full window."""
    done = 1
    while done * 2 <= width:
        x = take(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return take(x[: len(x) - rest], x[rest:]) if rest else x


def _least_chains(texts: list[str]) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, their chain hashes, the least chain hash of each window of LEAST words (0 over two texts), and the text of each word."""
    w = words_of(texts)
    n = len(w.hash)
    text = np.repeat(np.arange(len(texts)), w.count)
    if n < LEAST:
        return w, np.zeros(0, np.uint64), np.zeros(0, np.uint64), text
    chain = np.zeros(n - CHAIN + 1, np.uint64)
    for j in range(CHAIN):
        chain = chain * STEP + w.hash[j : n - CHAIN + 1 + j]
    chain = mix(chain)
    least = _slide(chain, RUN, np.minimum)
    begin = np.arange(len(least))
    least[text[begin] != text[begin + LEAST - 1]] = 0  # windows over two texts select nothing
    return w, chain, least, text


def chains_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, chain hash and word position of the selected chains, each hash of a text once."""
    w, chain, least, text = _least_chains(texts)
    if not len(least):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = np.concatenate([np.zeros(RUN - 1, np.uint64), least, np.zeros(RUN - 1, np.uint64)])
    at = np.flatnonzero((_slide(padded, RUN, np.maximum) == chain) & (chain != 0))
    order = np.lexsort((at, chain[at], text[at]))
    at = at[order]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (chain[at[1:]] != chain[at[:-1]]) | (text[at[1:]] != text[at[:-1]])
    at = at[fresh]
    return text[at], chain[at].view(np.int64), at - w.first[text[at]]


def windows_of(texts: list[str], chains: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text number, least chain, hash, word position, begin and end (code points) of the windows of LEAST words whose least chain is one of `chains`."""
    w, chain, least, text = _least_chains(texts)
    at = np.flatnonzero(np.isin(least, chains.view(np.uint64)) & (least != 0))
    window = np.zeros(len(at), np.uint64)
    for j in (*range(0, RUN, CHAIN), RUN - 1):  # chains that together cover the window
        window = window * STEP + chain[at + j]
    of = text[at]
    base = np.cumsum([0, *(len(t) + 1 for t in texts)])[of]
    return of, least[at].view(np.int64), mix(window).view(np.int64), at - w.first[of], w.start[at] - base, w.end[at + LEAST - 1] - base


def chain_rows(docs: DataFrame) -> DataFrame:
    """chain and key (60 bits of the text key) of the selected chains of every different text of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            keys, texts = np.array(list(of), np.int64), list(of.values())
            for a, b in steps(texts):
                text, chain, _ = chains_of(texts[a:b])
                yield pa.RecordBatch.from_arrays([pa.array(chain), pa.array(keys[text + a])], names=["chain", "key"])

    return docs.select("key", "text").mapInArrow(run, "chain long, key long")


def window_rows(texts: DataFrame) -> DataFrame:
    """chain and window (together the id), key, at, begin and end of the windows of texts (key, text, chains).

    Texts of one step are searched for the chains of all of them: a chain that one shares is shared wherever it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a, b in steps(texts):
                chains = np.unique(batch.column(2).slice(a, b - a).flatten().to_numpy())
                text, chain, window, *places = windows_of(texts[a:b], chains)
                yield pa.RecordBatch.from_arrays([pa.array(chain), pa.array(window), pa.array(keys[text + a]), *(pa.array(x.astype(np.int64)) for x in places)], names=["chain", "window", "key", "at", "begin", "end"])

    return texts.select("key", "text", "chains").mapInArrow(run, "chain long, window long, key long, at long, begin long, end long")


def merged(windows: DataFrame) -> DataFrame:
    """key, begin, end and kept_key of runs of overlapping windows (key, kept_key, at, begin, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = np.zeros((5, 0), np.int64)  # the last run, as one window with the begin of its first
        for batch in batches:
            key, kept, at, begin, end = np.concatenate([open_, np.stack([c.to_numpy() for c in batch.columns])], axis=1)
            if len(key):
                apart = (key[1:] != key[:-1]) | (kept[1:] != kept[:-1]) | (at[1:] >= at[:-1] + LEAST)
                first = np.concatenate(([0], np.flatnonzero(apart) + 1))
                open_ = np.array([[key[-1]], [kept[-1]], [at[-1]], [begin[first[-1]]], [end[-1]]])
                done, last = first[:-1], first[1:] - 1
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[done], begin[done], end[last], kept[done])], names=["key", "begin", "end", "kept_key"])
        yield pa.RecordBatch.from_arrays([pa.array(open_[i]) for i in (0, 3, 4, 1)], names=["key", "begin", "end", "kept_key"])

    dealt = windows.select("key", "kept_key", "at", "begin", "end").repartition("key").sortWithinPartitions("key", "kept_key", "at")
    return dealt.mapInArrow(run, "key long, begin long, end long, kept_key long")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """key, begin, end of passages of a text that an earlier text has, and kept_key.

    A window is kept in the text of least key that has it, at all its places there, and goes at every
    place from all others. Windows are equal if two 64-bit hashes are. Two different texts of one
    60-bit key (a chance of 3e-8 a text among 3e10) are left as they are.
    """
    rows = staged(chain_rows(docs), "chains")
    met = rows.groupBy("chain").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high")
    held = join_on_hot_key(rows, staged(met.select("chain", "n"), "shared-chains"), "chain", "n", rows.count())
    wanted = staged(held.groupBy("key").agg(F.collect_set("chain").alias("chains")), "wanted")
    one_each = docs.groupBy("key").agg(F.first("text").alias("text"), F.min("node").alias("node"), F.max("node").alias("other")).where("node = other").select("key", "text")
    windows = staged(window_rows(one_each.join(wanted.hint("merge"), "key")), "windows")
    first = windows.groupBy("chain", "window").agg(F.min("key").alias("kept_key"), F.max("key").alias("high"), F.count(F.lit(1)).alias("n")).where("kept_key <> high").drop("high")
    later = join_on_hot_key(windows, staged(first, "first-windows"), ["chain", "window"], "n", windows.count()).where("key <> kept_key")
    return merged(later)


def removals(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, node (text key), begin, end (code points), kept_doc_id and kind of what goes from each document.

    kind is `copy`, `passage` or `paragraph`; pieces of different kinds may overlap. Null and short
    texts lose nothing; rows alike in doc_id and text count as one document and give their pieces
    once; null doc_ids are taken as one id below all others. Other columns are ignored, and an empty
    table gives none. Each kind is written to the shared folder, so a caller's plan does not hold
    the joins that found the pieces: the driver plans these once, one kind at a time.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")  # in the order of the whole text key
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("doc_id"), text_key().alias("node"), key.alias("key"), text.alias("text"))
    words = F.size(F.split(F.trim("text"), r"\s+", least))  # at most `least`: no text is split beyond that
    rows = base.select("doc_id", "node", "key", F.char_length("text").cast("long").alias("n_chars"), words.alias("words")).distinct()
    rows = staged(rows, "rows")
    texts = staged(rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.min("key").alias("key"), F.count(F.lit(1)).alias("copies")), "nodes")
    again = join_on_hot_key(rows, texts.where("copies > 1").select("node", "first", "copies"), "node", "copies", rows.count())
    again = again.where((F.col("doc_id") != F.col("first")) & (F.col("words") >= least))
    copies = again.select("doc_id", "node", F.lit(0).cast("long").alias("begin"), F.col("n_chars").alias("end"), F.col("first").alias("kept_doc_id"), F.lit("copy").alias("kind"))
    copies = staged(copies, "copies")
    paragraphs = staged(repeated_paragraphs(base, least).distinct().withColumn("kind", F.lit("paragraph")), "repeated-paragraphs")
    passages = staged(repeated_passages(base), "passages")
    named = passages.join(texts.select("key", "node", "first"), "key").join(texts.select(F.col("key").alias("kept_key"), F.col("first").alias("kept_doc_id")), "kept_key")
    named = named.select(F.col("first").alias("doc_id"), "node", "begin", "end", "kept_doc_id", F.lit("passage").alias("kind")).distinct()
    named = staged(named, "repeated-passages")
    every = copies.unionByName(paragraphs).unionByName(named)
    return every.withColumns({c: F.nullif(F.col(c), F.lit(LOWEST)) for c in ("doc_id", "kept_doc_id")})


def cut(text: str, begins: list[int], ends: list[int]) -> str:
    """The text without the given pieces; the line break behind a piece that fills its line goes too."""
    out, at = [], 0
    for b, e in sorted(zip(begins, ends)):
        if e < len(text) and text[e] == "\n" and (b == 0 or text[b - 1] == "\n"):
            e += 1
        if b > at:
            out.append(text[at:b])
        at = max(at, e)
    return "".join(out) + text[at:]


def deduplicated(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows of docs with their repeated pieces cut out; rows of which nothing but blanks is left go.

    All columns stay, whatever their names; text is the cut text, and n_chars, where there is such a
    column, its length. Null texts and rows that lose nothing stay as they are; an empty table stays empty.
    """
    lost = removals(docs, least).groupBy(F.coalesce("doc_id", F.lit(LOWEST)).alias("place"), "node")
    lost = lost.agg(F.collect_set(F.struct("begin", "end")).alias("lost"))

    @F.pandas_udf("string")
    def cut_text(text: pd.Series, begins: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([t if b is None else cut(t, b, e) for t, b, e in zip(text, begins, ends)], dtype=object)

    shortened = cut_text.asNondeterministic()  # so that the filter on its result stays above it: once a row, by one worker a task

    never_null = F.coalesce(text_key(), F.lit("").cast("binary"))  # else the second use of the join filters nulls, and shuffles all texts again
    keyed = packed(docs, place=F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)), node=never_null)
    met = keyed.join(lost.hint("merge"), ["place", "node"], "left")
    text = shortened(F.col("row.text"), F.col("lost.begin"), F.col("lost.end"))
    touched = met.where("lost is not null").select("row", text.alias("text")).where(F.trim("text") != "")
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return met.where("lost is null").select("row.*").unionAll(touched.select(row.alias("row")).select("row.*"))
