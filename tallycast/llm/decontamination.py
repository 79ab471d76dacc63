"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

Words are lower-cased runs of letters, digits and marks. A seed reads only the marked positions of
its mask, so it is equal in two texts that differ at the others. The two MASKS together have a seed
inside every 13 aligned words of which at most two differ, wherever those are (a test goes through
all cases), so the search loses no overlap that the verification would accept. Seeds of the
benchmark are joined with those of all documents; around every hit the aligned words themselves are
compared.

An overlap is reported where, on one alignment, LEAST or more of WINDOW consecutive words are equal
(words beyond either text count as different): 11 of 13, a similarity of 0.8 or more. Overlapping
windows of one alignment are one overlap, from its first equal word to its last.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallycast.llm.common import packed, text_key

WINDOW, LEAST = 13, 11
MASKS = ("111101001", "100110111")
SPAN = 9
#: Benchmark words of one block; the seeds of a block are broadcast, two for each word.
BLOCK_WORDS = 200_000
#: Stands for a null doc_id.
LOWEST = -(2**63)


def word_hashes(text: str) -> Column:
    words = F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), r"[^\p{L}\p{N}\p{M}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _seeded(rows: DataFrame, keep: list[str]) -> DataFrame:
    """One row a position and mask: the kept columns, `at` and `seed`. The words stay behind, so rows are small."""
    last = F.size("words") - SPAN
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    placed = rows.select(*keep, "words", F.explode(places).alias("at"))
    of_mask = [F.xxhash64(F.lit(m), *[F.get("words", F.col("at") + j) for j, c in enumerate(mask) if c == "1"]) for m, mask in enumerate(MASKS)]
    return placed.select(*keep, "at", F.explode(F.array(*of_mask)).alias("seed"))


def _accepted(aligned: DataFrame) -> DataFrame:
    """Adds the first and last equal word, by item position, of the accepted windows of an alignment (words, item_words, shift)."""
    count = F.size("item_words")
    same = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.coalesce(F.get("words", k + F.col("shift")) == F.get("item_words", k), F.lit(False)).cast("int"))
    compared = aligned.withColumn("equal", same)

    def held(k: Column) -> Column:  # equal words of the window that begins with word k
        return F.aggregate(F.slice("equal", k + 1, WINDOW), F.lit(0), lambda s, x: s + x)

    begins = F.filter(F.sequence(F.lit(0), count - 1), lambda k: (F.get("equal", k) == 1) & (held(k) >= LEAST))
    found = compared.withColumn("begins", begins).where(F.size("begins") > 0)
    ends = F.transform("begins", lambda k: F.array_max(F.filter(F.sequence(k, F.least(k + WINDOW, count) - 1), lambda q: F.get("equal", q) == 1)))
    return found.select("*", F.array_min("begins").alias("first"), F.array_max(ends).alias("last"))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, key (text key), item_id, doc_word, item_word, n_words of every overlap of a document and a benchmark item.

    Positions are word numbers from 0. Null texts count as empty. Texts and items too short for LEAST
    equal words give nothing. Repeated rows of a document give each overlap once; null ids are kept.
    Other columns are ignored. The benchmark is taken in blocks of bounded size, each against all
    documents, so its seeds can be broadcast; texts are met again only to compare alignments with a hit.
    """
    items = benchmark.select("item_id", word_hashes("text").alias("words")).where(F.size("words") >= LEAST)
    total = items.agg(F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("n")).first().n
    blocks = max(1, -(-total // BLOCK_WORDS))
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("place")
    rows = docs.select(place, text_key().alias("key"), word_hashes("text").alias("words"))
    placed = _seeded(rows, ["place", "key"])
    texts = docs.select(place, text_key().alias("key"), "text")
    out = []
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == b)
        item_seeds = _seeded(block, ["item_id"]).select("item_id", F.col("at").alias("item_at"), "seed")
        hits = placed.join(F.broadcast(item_seeds), "seed")
        shifts = hits.select("place", "key", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
        met = texts.join(shifts.hint("merge"), ["place", "key"]).withColumn("words", word_hashes("text"))
        aligned = met.join(F.broadcast(block.select("item_id", F.col("words").alias("item_words"))), "item_id")
        out.append(_accepted(aligned.select("place", "key", "item_id", "shift", "words", "item_words")).select("place", "key", "item_id", "shift", "first", "last"))
    found = reduce(DataFrame.unionAll, out).groupBy("place", "key", "item_id", "shift").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return found.select(
        F.nullif(F.col("place"), F.lit(LOWEST)).alias("doc_id"), "key", "item_id",
        (F.col("shift") + F.col("first")).cast("long").alias("doc_word"),
        F.col("first").cast("long").alias("item_word"),
        (F.col("last") - F.col("first") + 1).cast("long").alias("n_words"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text overlaps no benchmark item; all columns stay as they are, whatever their names.

    Null texts overlap nothing; an empty table, or an empty benchmark, takes no row away.
    """
    found = overlaps(docs, benchmark).select("key").distinct()
    return packed(docs, key=text_key()).join(found.hint("merge"), "key", "left_anti").select("row.*")


#: The same overlaps without seeds: every pair of equal words, by alignment.
ORACLE = """
with dw as (
  select doc_id, unnest(w) as word, generate_subscripts(w, 1) - 1 as pos from (
    select doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}\\p{M}]+'), lambda x: x <> '') as w from documents)),
iw as (
  select item_id, unnest(w) as word, generate_subscripts(w, 1) - 1 as item_at from (
    select item_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}\\p{M}]+'), lambda x: x <> '') as w from benchmark)),
same as (select doc_id, item_id, pos - item_at as shift, item_at from dw join iw using (word)),
dense as (select * from same qualify count(*) over (partition by doc_id, item_id, shift) >= 11),
held as (
  select *, count(*) over w as n, max(item_at) over w as last_at from dense
  window w as (partition by doc_id, item_id, shift order by item_at range between current row and 12 following))
select doc_id, item_id, cast(shift + min(item_at) as bigint) as doc_word, cast(min(item_at) as bigint) as item_word,
  cast(max(last_at) - min(item_at) + 1 as bigint) as n_words
from held where n >= 11 group by doc_id, item_id, shift
"""
