"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted trees are grown on a bounded sample of labelled rows. Every path from a root to a node is a
conjunction of comparisons, and so a rule. A lasso logistic fit keeps few of them. The kept rules
become Spark column expressions over the statistics, so scoring is one projection.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tallycast.llm.common import caches_of, columns_free, packed, small_batches
from tallycast.llm.pretokens import LETTER, NUMBER, OTHER, SPACE, class_table
from tallycast.llm.training import training_rows
from tallycast.llm.words import SEP, SEP_CODE, code_points, fold, steps, words_of

THRESHOLD = 0.7
TREES, DEPTH = 20, 3
LASSO = 0.002
#: Statistics of a text, all inputs of the rules.
STATISTICS = (
    "log_chars",  # logarithm of 1 + code points
    "log_words",
    "word_chars",  # mean length of a word
    "upper_share",  # upper-case letters among letters
    "number_share",  # digits among visible code points
    "symbol_share",  # neither letters nor digits among visible code points
    "mark_share",  # marks other than . , ; : ' " ( ) - among visible code points
    "space_share",
    "line_words",  # words a line
    "repeat_share",  # words equal to the one before
    "distinct_share",  # different words among words
    "chain_share",  # different three-word chains among all
    "top_share",  # share of the most frequent word
    "lone_share",  # blanks followed by a visible mark
)
PLAIN_MARKS = ".,;:'\"()-"


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values, dtype=float)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _distinct(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of different values of each text, and the count of the most frequent one."""
    n = np.diff(first)
    different, most = np.zeros(len(n)), np.zeros(len(n))
    text = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((values, text))
    v, t = values[order], text[order]
    if len(v):
        begin = np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1]) | (t[1:] != t[:-1]))))
        size = np.diff(np.append(begin, len(v)))
        np.add.at(different, t[begin], 1)
        np.maximum.at(most, t[begin], size)
    return different, most


def statistics(texts: list[str]) -> np.ndarray:
    """One row of STATISTICS for each text that fits an array step together with the others."""
    joined = SEP.join(texts)
    cp = code_points(joined)
    at = np.flatnonzero(cp == SEP_CODE)
    kind = class_table()[cp].copy()
    kind[at] = 9
    begin, end = np.concatenate(([0], at + 1)), np.append(at, len(cp))
    bounds = np.append(begin, len(cp))
    chars = (end - begin).astype(float)
    letters, numbers, other, space = (_sums(kind == k, bounds) for k in (LETTER, NUMBER, OTHER, SPACE))
    low = code_points(fold(joined))
    upper = _sums((low != cp) & (kind == LETTER), bounds)
    plain = np.isin(cp, [ord(c) for c in PLAIN_MARKS])
    marks = _sums((kind == OTHER) & ~plain, bounds)
    lines = _sums(cp == 10, bounds) + 1
    lone = _sums(np.append((cp[:-1] == 32) & (kind[1:] == OTHER), False) if len(cp) else cp, bounds)
    w = words_of(texts)
    words = w.count.astype(float)
    length = _sums(w.end - w.start, w.first)
    inner = np.ones(len(w.hash), bool)
    inner[w.first[:-1][w.first[:-1] < len(w.hash)]] = False
    same = np.zeros(len(w.hash))
    same[1:] = (w.hash[1:] == w.hash[:-1]) & inner[1:]
    different, most = _distinct(w.hash, w.first)
    third = w.hash.copy()
    if len(third) > 2:
        third[2:] += w.hash[1:-1] * np.uint64(31) + w.hash[:-2] * np.uint64(961)
    chains, _ = _distinct(third, w.first)
    visible, safe = np.maximum(chars - space, 1), np.maximum(words, 1)
    return np.column_stack([
        np.log1p(chars), np.log1p(words), length / safe, upper / np.maximum(letters, 1), numbers / visible, other / visible, marks / visible,
        space / np.maximum(chars, 1), words / lines, _sums(same, w.first) / safe, different / safe, chains / safe, most / safe, lone / np.maximum(space, 1),
    ])


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    caches_of("quality")
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).fill_null("").to_pylist()
        x = np.vstack([statistics(texts[a:b]) for a, b in steps(texts)]) if texts else np.zeros((0, len(STATISTICS)))
        kept = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, pa.float64()) for c in x.T)], names=[*batch.schema.names[:-1], *STATISTICS])


@F.arrow_udf(ArrayType(DoubleType()))
def _statistics_of(text: pa.Array) -> pa.Array:
    caches_of("quality")
    texts = text.to_pylist()
    x = np.vstack([statistics(texts[a:b]) for a, b in steps(texts)]) if texts else np.zeros((0, len(STATISTICS)))
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(STATISTICS), pa.array(x.ravel(), pa.float64()))


def with_statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and STATISTICS of every whole text; null counts as empty."""
    small_batches(docs.sparkSession)
    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] + [f"{s} double" for s in STATISTICS])
    return rows.mapInArrow(_run, schema)


@dataclass(frozen=True)
class Rule:
    """All comparisons hold: (statistic, at most?, value)."""

    parts: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, at_most, value in self.parts:
            out = out & (F.col(name) <= value if at_most else F.col(name) > value)
        return out

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([x[n] <= v if le else x[n] > v for n, le, v in self.parts])


def rules_of(description: str) -> list[Rule]:
    """Rules of every path of a tree, from its printed form: indented If and Else lines."""
    path: list[tuple[str, bool, float]] = []
    out, base = [], None
    for line in description.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dE]+)\)", line)
        if m:
            base = len(m[1]) if base is None else base
            path = [*path[: len(m[1]) - base], (STATISTICS[int(m[2])], m[3] == "<=", float(m[4]))]
            out.append(Rule(_tight(path)))
    return out


def _tight(path: list[tuple[str, bool, float]]) -> tuple[tuple[str, bool, float], ...]:
    """One comparison for each statistic and direction."""
    best: dict[tuple[str, bool], float] = {}
    for name, at_most, value in path:
        old = best.get((name, at_most))
        best[name, at_most] = value if old is None else min(old, value) if at_most else max(old, value)
    return tuple((n, le, v) for (n, le), v in sorted(best.items()))


@dataclass
class Model:
    rules: list[tuple[Rule, float]]
    bias: float

    def column(self) -> Column:
        """The score as a column expression over STATISTICS."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(rows: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> Model:
    """Fit on a bounded table of STATISTICS and label (0 or 1), taken to the driver once.

    With rows of one class only, or none, the score is constant: near that class, or one half.
    """
    spark = rows.sparkSession
    data = rows.select("label", *STATISTICS).toPandas()
    y = data.pop("label").to_numpy()
    if len(set(y.tolist())) < 2:
        return Model([], 0.0 if not len(y) else 20.0 if y[0] == 1 else -20.0)
    parts = max(1, len(data) // 5000)
    local = spark.createDataFrame(data.assign(label=y.astype(float))).coalesce(parts)
    grown = local.select("label", array_to_vector(F.array(*STATISTICS)).alias("features"))
    forest = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=11, maxBins=64, cacheNodeIds=True).fit(grown)
    found = list(dict.fromkeys(r for t in forest.trees for r in rules_of(t.toDebugString)))
    if not found:
        return Model([], float(np.log(y.mean() / (1 - y.mean()))))
    x = {s: data[s].to_numpy() for s in STATISTICS}
    held = np.column_stack([r.holds(x) for r in found]).astype(float)
    _, one = np.unique(held, axis=1, return_index=True)  # rules that hold for the same rows are one rule
    found = [found[i] for i in sorted(one)]
    fired = local.select("label", array_to_vector(F.array(*[r.column().cast("double") for r in found])).alias("features"))
    lasso_fit = LogisticRegression(elasticNetParam=1.0, regParam=lasso, standardization=False, maxIter=100, tol=1e-6).fit(fired)
    weights = lasso_fit.coefficients.toArray()
    return Model([(r, float(w)) for r, w in zip(found, weights) if w != 0], float(lasso_fit.intercept))


def fit_on(docs: DataFrame, labels: DataFrame, held_out: Column) -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out (training.TRAIN_ROWS of each class)."""
    chosen = training_rows(docs, labels, "quality", held_out)
    return fit(with_statistics(chosen, ("label",)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text; null counts as empty; rows and null doc_ids stay as they are."""
    return with_statistics(docs).select("doc_id", model.column().alias("score"))


def _packed_scores(docs: DataFrame, model: Model) -> DataFrame:
    """row (packed) and score; only the text goes to Python."""
    small_batches(docs.sparkSession)
    rows = packed(docs, text=F.coalesce(F.col("text").cast("string"), F.lit("")))
    known = rows.select("row", _statistics_of("text").alias("statistics"))
    each = [F.col("statistics")[i].alias(s) for i, s in enumerate(STATISTICS)]
    return known.select("row", *each).select("row", model.column().alias("score"))


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of docs and the score; an input column of that name gives way.

    Null texts count as empty, rows stay as they are, an empty table stays empty.
    """
    return _packed_scores(columns_free(docs, [name]), model).select("row.*", F.col("score").alias(name))


def at_least(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of docs whose score is `least` or more, with all their columns, whatever their names."""
    return _packed_scores(docs, model).where(F.col("score") >= least).select("row.*")
