"""Spelling variants: all pairs of words one edit apart, by k-d trees over letter counts.

A word of letters has a vector of letter counts. An inserted or deleted letter moves it by 1 in L1
distance, a replaced one by 2 (none if the letters are the same, and then the words are not one
replacement apart). So near words are looked for among words of equal length within distance 2 and of a
length one greater within distance 1, in a k-d tree for each length, and letter order is verified.

The upper levels of each tree deal the words out: they are fitted on a bounded sample of words, every word goes to the
one leaf that holds its vector, and as a query to all leaves whose box is near enough. Inside a leaf a
finer tree of the same kind, with tight boxes, finds the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.llm.checksums import crc32_sql
from tallycast.llm.common import staged

RUN = r"[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A run whose hash is a multiple of this loses a letter.
DAMAGE = 199
#: A form is at least so many times as frequent as its variant.
RATIO = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of one leaf of the dealing tree, about; words of the sample that fits it, on average at most; sample words a leaf.
LEAF_WORDS, SAMPLE, SAMPLE_A_LEAF = 16384, 1 << 18, 32
#: Words of a leaf of the trees inside a task.
FINE = 48
#: Letters: a to z, then the code points from U+00C0 to U+00FF.
LETTERS = 26 + 64
#: Pairs of one array step.
STEP_PAIRS = 1 << 20


def counted_words(docs: DataFrame) -> DataFrame:
    """word and n (occurrences) of the words of docs (doc_id, text), from LEAST_LENGTH letters and LEAST_COUNT occurrences on.

    A null text has no word; a null doc_id counts as empty text in the hash that decides on a lost letter.
    """
    run = F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(r"([A-Za-zÀ-ÿ]{%d,})" % LEAST_LENGTH), F.lit(1))).alias("run")
    name = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))
    runs = docs.where("text is not null").select(name.alias("name"), run).select("name", F.translate("run", UPPER, LOWER).alias("run"))
    h = runs.withColumn("h", F.crc32(F.concat("name", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    lost = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = h.select(F.when(F.col("h") % DAMAGE == 0, lost).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def code_rows(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length, a row a word."""
    return np.frombuffer("".join(words).encode("utf-16-le"), np.uint16).reshape(len(words), length)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """Vectors of letter counts; counts beyond 127 stay 127, which can only lessen distances."""
    letter = np.where(codes < 0xC0, codes.astype(np.int64) - 97, codes.astype(np.int64) - 0xC0 + 26)
    flat = np.arange(len(codes))[:, None] * LETTERS + letter
    return np.minimum(np.bincount(flat.ravel(), minlength=len(codes) * LETTERS), 127).astype(np.int8).reshape(len(codes), LETTERS)


@dataclass
class Node:
    """A box of a k-d tree: words with at most `cut` of letter `axis` go left, the others right; a leaf has a number."""

    axis: int = -1
    cut: int = 0
    left: Node | None = None
    right: Node | None = None
    leaf: int = -1
    rows: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def tree(points: np.ndarray, most: int) -> tuple[Node, int]:
    """A k-d tree over count vectors with leaves of at most `most` points (more, if their vectors are equal), cut at the median of the widest letter; and its number of leaves."""
    leaves = 0

    def grow(rows: np.ndarray) -> Node:
        nonlocal leaves
        if len(rows) > most:
            spread = points[rows].var(0)
            axis = int(spread.argmax())
            if spread[axis] > 0:
                column = points[rows, axis]
                cut = min(int(np.median(column)), int(column.max()) - 1)
                return Node(axis, cut, grow(rows[column <= cut]), grow(rows[column > cut]))
        leaves += 1
        return Node(leaf=leaves - 1, rows=rows)

    return grow(np.arange(len(points))), leaves


def reached(root: Node, queries: np.ndarray, radius: int) -> Iterator[tuple[Node, np.ndarray]]:
    """The leaves whose box is within `radius` of some queries, with these queries' rows.

    The distance to a box is the sum over letters of what a count lies outside the box; bounds are those of the cuts above.
    """
    stack = [(root, np.arange(len(queries)), np.zeros(len(queries), np.int16), {})]
    while stack:
        node, rows, away, bounds = stack.pop()
        if not len(rows):
            continue
        if node.left is None:
            yield node, rows
            continue
        low, high = bounds.get(node.axis, (0, 127))
        x = queries[rows, node.axis].astype(np.int16)
        before = np.maximum(low - x, 0) + np.maximum(x - high, 0)
        for side, a, b in ((node.left, low, min(high, node.cut)), (node.right, max(low, node.cut + 1), high)):
            new = away - before + np.maximum(a - x, 0) + np.maximum(x - b, 0)
            near = new <= radius
            stack.append((side, rows[near], new[near], bounds | {node.axis: (a, b)}))


def _unary(counts: np.ndarray) -> np.ndarray:
    """Bits whose number of differences is at most the L1 distance: letters share 42 fields, each count sets as many of 3 bits."""
    fields = np.zeros((len(counts), 42), np.int64)
    fields[:, :26] = counts[:, :26]
    for j in range(64):
        fields[:, 26 + j % 16] += counts[:, 26 + j]
    bits = (np.uint64(1) << np.minimum(fields, 3).astype(np.uint64)) - np.uint64(1)
    shift = np.uint64(3) * np.arange(21, dtype=np.uint64)
    return np.stack([(bits[:, :21] << shift).sum(1, dtype=np.uint64), (bits[:, 21:] << shift).sum(1, dtype=np.uint64)])


def one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Which rows are exactly one edit apart; words of `long` are as long, or longer by one letter."""
    n = short.shape[1]
    if long.shape[1] == n:
        return (short != long).sum(1) == 1
    same, shifted = short == long[:, :n], short == long[:, 1:]
    ahead = np.logical_and.accumulate(same, axis=1).sum(1)
    behind = np.logical_and.accumulate(shifted[:, ::-1], axis=1).sum(1)
    return ahead + behind >= n


def near_pairs(home: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query row, home row) of all pairs one edit apart; queries are as long as home words, or shorter by one letter."""
    radius = 2 if home.shape[1] == queries.shape[1] else 1
    points, asked = letter_counts(home), letter_counts(queries)
    packed, sought = _unary(points), _unary(asked)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for node, rows in reached(tree(points, FINE)[0], asked, radius):
        box = points[node.rows]
        low, high = box.min(0), box.max(0)
        for a in range(0, len(rows), step := max(1, STEP_PAIRS // max(len(node.rows), LETTERS))):
            part = rows[a : a + step]
            x = asked[part]
            part = part[(np.maximum(low - x, 0) + np.maximum(x - high, 0)).sum(1) <= radius]
            apart = np.bitwise_count(sought[0][part, None] ^ packed[0][None, node.rows]) + np.bitwise_count(sought[1][part, None] ^ packed[1][None, node.rows])
            i, j = np.nonzero(apart <= radius)
            i, j = part[i], node.rows[j]
            edit = one_edit(queries[i], home[j])
            found.append((i[edit], j[edit]))
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def dealing_trees(words: DataFrame) -> dict[int, Node]:
    """The upper tree of each length that has more than LEAF_WORDS words.

    Fitted on words drawn by hash: 4 * SAMPLE_A_LEAF for each LEAF_WORDS words, but SAMPLE in all on average
    at most; beyond that, leaves grow with the number of words. Nothing but the sample reaches the driver.
    """
    sizes = {r.length: r.n for r in words.groupBy(F.length("word").alias("length")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LEAF_WORDS).collect()}
    if not sizes:
        return {}
    total = sum(sizes.values())
    share = min(4 * SAMPLE_A_LEAF / LEAF_WORDS, SAMPLE / total)
    drawn = words.where(F.length("word").isin(list(sizes))).where(F.pmod(F.xxhash64("word", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))
    of: dict[int, list[str]] = {}
    for r in drawn.select("word").orderBy("word").collect():
        of.setdefault(len(r.word), []).append(r.word)
    return {k: tree(letter_counts(code_rows(w, k)), max(SAMPLE_A_LEAF, int(LEAF_WORDS * len(w) / sizes[k])))[0] for k, w in of.items()}


def _dealt(words: DataFrame, trees: dict[int, Node]) -> DataFrame:
    """(length, leaf, word, n, query): each word to its leaf, and as a query to leaves near it of its own length and the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single = Node(leaf=0)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            out: list[tuple[int, int, bool, np.ndarray]] = []
            for length in np.unique(size).tolist():
                at = np.flatnonzero(size == length)
                counts = letter_counts(code_rows([texts[i] for i in at], length))
                for into, radius, query in ((length, 0, False), (length, 2, True), (length + 1, 1, True)):
                    out += [(into, node.leaf, query, at[rows]) for node, rows in reached(trees.get(into, single), counts, radius)]
            rows = pa.array(np.concatenate([r for *_, r in out]) if out else np.zeros(0, np.int64))
            many = np.array([len(r) for *_, r in out], np.int64)
            length, leaf, query = (np.repeat(np.array([o[k] for o in out], kind), many) for k, kind in enumerate((np.int32, np.int32, np.bool_)))
            yield pa.RecordBatch.from_arrays([pa.array(length), pa.array(leaf), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(query)], names=["length", "leaf", "word", "n", "query"])

    return words.select("word", "n").mapInArrow(run, "length int, leaf int, word string, n long, query boolean")


def _in_leaf(group: pa.Table) -> pa.Table:
    """Of each word with near words in a leaf: their number, and the greatest count with the first word that has it."""
    texts, n, query = (group.column(c) for c in ("word", "n", "query"))
    texts, n, query = texts.to_pylist(), n.to_numpy(), query.to_numpy(zero_copy_only=False)
    length = group.column("length")[0].as_py()
    home = np.flatnonzero(~query)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    here = code_rows([texts[i] for i in home], length)
    words, others = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in (length, length - 1):
        asked = np.flatnonzero(query & (size == k))
        if len(asked) and len(home):
            i, j = near_pairs(here, code_rows([texts[i] for i in asked], k))
            words.append(asked[i])
            others.append(home[j])
            if k < length:  # the longer word is no query of the shorter one's tree
                words.append(home[j])
                others.append(asked[i])
    word, other = np.concatenate(words), np.concatenate(others)
    order = np.lexsort((np.argsort(np.argsort(np.array(texts, object)))[other], -n[other], word))
    word, other = word[order], other[order]
    begin = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if len(word) else np.zeros(0, np.int64)
    many = np.diff(np.append(begin, len(word)))
    best = other[begin]
    take = group.column("word").combine_chunks()
    return pa.table({"word": take.take(pa.array(word[begin])), "near": pa.array(many), "best_n": pa.array(n[best]), "best": take.take(pa.array(best))})


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best (its near word of greatest n, the first in code-point order of equal ones) and best_n, of words that have near words."""
    dealt = _dealt(words, dealing_trees(words))
    parts = dealt.groupBy("length", "leaf").applyInArrow(_in_leaf, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("order"), F.col("best"))).alias("best")
    return parts.groupBy("word").agg(F.sum("near").alias("n_near"), best).select("word", "n_near", "best.best", (-F.col("best.order")).alias("best_n"))


def _rooted(forms: DataFrame) -> DataFrame:
    """word and root of a table (word, form) without circles: pointers double until none moves."""
    at = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        moved = at.join(at.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        new = staged(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if new.where("moved").isEmpty():
            return new.select("word", "root")
        at = new.select("word", "root")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of docs (doc_id, text; see counted_words).

    Two words are near if they differ by one inserted, deleted or replaced code point. A word's form is its near word of
    greatest n (of equal ones the first in code-point order), if that is RATIO times the word's n or more; its root is
    where forms end. n grows along forms, so there are no circles, and paths have at most log(n) / log(RATIO) steps.
    Repeated rows count each time, other columns are ignored; an empty table gives no words.
    """
    words = staged(counted_words(docs), "words")
    near = words.join(near_words(words), "word", "left")
    held = F.col("best_n") >= RATIO * F.col("n")
    found = staged(near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(held, F.col("best")).alias("form"), F.when(held, F.col("best_n")).alias("form_n")), "forms")
    roots = _rooted(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")



#: Words that share a pattern with one letter left open are a replacement apart; a word is a deletion from each with a letter more.
ORACLE = f"""
with recursive runs as (
  select coalesce(cast(doc_id as varchar), '') || ':' || run as name, run, count(*) as k from (
    select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}')), '{UPPER}', '{LOWER}') as run from documents)
  group by all),
hashed as (select run, k, {crc32_sql("name")} as h from runs),
words as (
  select case when h % {DAMAGE} = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, cast(sum(k) as bigint) as n
  from hashed group by 1 having length(word) >= {LEAST_LENGTH} and n >= {LEAST_COUNT}),
open_ as (select word, i, left(word, i - 1) as a, substr(word, i + 1) as b from (select word, unnest(range(1, length(word) + 1)) as i from words)),
shorter as (select distinct o.word, w.word as other from open_ o join words w on w.word = o.a || o.b),
near as (
  select x.word, y.word as other from open_ x join open_ y using (i, a, b) where x.word <> y.word
  union select word, other from shorter union select other, word from shorter),
best as (
  select word, count(*) as n_near, first(other order by m desc, other) as other, max(m) as m
  from (select near.word, other, words.n as m from near join words on words.word = other) group by word),
found as (
  select words.word, n, coalesce(n_near, 0) as n_near, case when m >= {RATIO} * n then other end as form, case when m >= {RATIO} * n then m end as form_n
  from words left join best using (word)),
walk as (
  select word, word as last from found
  union all select walk.word, found.form from walk join found on found.word = walk.last where found.form is not null)
select found.word, form, last as root, n, n_near, form_n
from found join walk using (word) where not exists (select 1 from found f where f.word = last and f.form is not null)
"""
