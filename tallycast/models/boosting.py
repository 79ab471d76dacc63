"""Boosted trees by histograms: all refit months and all models grow together.

A model here is one configuration in one refit month. The months of a span share the cuts of their bins and
grow together. Every (row, model) pair has a margin; a tree level is one small job over all pairs: tasks
add gradients by (model, node, input, bin), other tasks add these sums up by model and pick its best splits, and
the driver gets nothing but the splits. So twelve monthly refits of several
configurations cost as many jobs as one, and a loss is nothing but its gradients: squared, absolute,
Poisson and Tweedie, with a log-level offset or as a ratio to the level.

A job is short, so rounds run on cached blocks of rows as an RDD: planning a DataFrame query would cost
more than the round. A block holds binned inputs and the margins of its pairs. Margins move on every
few trees into a new cached block, and checkpoints in the shared folder cut the lineage, so a lost executor
costs a few rounds of its own blocks.

No model sees what was not known at its month's first cutoff. That holds for bins, too: their cuts, and the
mean count of a group that stands for the group, come from the rows known in the first month of the span.
"""

from __future__ import annotations

import math
import operator
import pickle
from collections.abc import Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallycast.operators.features import CALENDAR_COLUMNS, KEY_COLUMNS, LEVEL_COLUMNS
from tallycast.operators.profile import append_all
from tallycast.session import ensure_checkpoint_dir
from tallycast.sources.sinks import stage
from tallycast.spec import Setting

INPUTS = (*LEVEL_COLUMNS, *CALENDAR_COLUMNS)
#: Bins of an input; bin 0 is for missing values.
BINS = 32
#: Refit months of a span, and spans that the driver has under way at once.
SPAN_MONTHS, SPAN_THREADS = 12, 4
#: Trees after which margins move into new blocks, and such moves after which a checkpoint is written.
MOVE, CHECKPOINT = 4, 10
#: Pairs of a partition of blocks, about.
PARTITION_PAIRS = 1 << 17
# Untuned defaults.
RATE, MIN_ROWS, POWER = 0.05, 50, 1.5
RIDGE = 1.0


@dataclass(frozen=True)
class Model:
    """One boosted configuration. level: none, ratio (label / level, weight = level) or offset (log level added)."""

    name: str
    loss: str
    level: str = "none"
    symmetric: bool = False
    rate: float = RATE
    min_rows: float = MIN_ROWS
    ridge: float = RIDGE
    power: float = POWER

    def __post_init__(self) -> None:
        if self.loss not in ("squared", "absolute", "poisson", "tweedie"):
            raise ValueError(f"{self.name}: unknown loss {self.loss!r}")
        if self.level not in ("none", "ratio", "offset") or (self.level == "offset" and not self.log_link):
            raise ValueError(f"{self.name}: level {self.level!r} does not go with loss {self.loss!r}")

    @property
    def log_link(self) -> bool:
        return self.loss in ("poisson", "tweedie")

    def gradients(self, y: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and second derivative of the loss by the margin (the second of squared and absolute loss counts as one)."""
        if self.loss == "squared":
            return margin - y, np.ones_like(y)
        if self.loss == "absolute":
            return np.sign(margin - y), np.ones_like(y)
        if self.loss == "poisson":
            mu = np.exp(margin)
            return mu - y, mu
        low, high = np.exp((1 - self.power) * margin), np.exp((2 - self.power) * margin)
        return high - y * low, (2 - self.power) * high - (1 - self.power) * y * low


@dataclass
class Tree:
    """One tree of every model: input and last bin to the left of each node, level by level, and values of the leaves."""

    feature: list[np.ndarray]
    cut: list[np.ndarray]
    value: np.ndarray | None = None


def _usable_from(months: Sequence[str], setting: Setting) -> Column:
    """Number of the first refit month that may train on a row; the number of months if none may."""
    known = F.date_add(setting.end_of_issue(F.col("issue_date")), setting.publication_lag_days)
    number = sum((F.lit(m).cast("date") < known).cast("int") for m in months)
    return F.when(F.col("y").isNotNull() & (F.col("mean_28d") > 0), number).otherwise(F.lit(len(months)))


def _asked_in(months: Sequence[str]) -> Column:
    """Number of the refit month that predicts a row, -1 if none does."""
    issue = F.col("issue_date")
    number = sum((F.lit(m).cast("date") <= issue).cast("int") for m in months) - 1
    return F.when(issue < F.add_months(F.lit(months[-1]).cast("date"), 1), number).otherwise(F.lit(-1))


def _prepared(features: DataFrame, months: Sequence[str], setting: Setting) -> tuple[DataFrame, list[np.ndarray]]:
    """Rows that the months of a span train on or predict, with the mean count of their group; and the cuts of each input."""
    rows = features.withColumns({"use": _usable_from(months, setting), "asked": _asked_in(months)})
    rows = rows.where((F.col("use") < len(months)) | (F.col("asked") >= 0))
    means = rows.groupBy(F.col("grp").alias("__grp")).agg(F.avg(F.when(F.col("use") == 0, F.col("y"))).alias("grp_mean"))
    rows = stage(rows.join(means, F.col("grp").eqNullSafe(F.col("__grp")), "left").drop("__grp"), "boost-rows")
    probs = F.array(*(F.lit(k / (BINS - 1)) for k in range(1, BINS - 1)))
    found = rows.where("use = 0").agg(*(F.percentile_approx(F.col(c).cast("double"), probs, F.lit(10000)).alias(c) for c in (*INPUTS, "grp_mean"))).first()
    return rows, [np.array(x if x is not None else np.zeros(BINS - 2), float) for x in found]


def _blocks(rows: DataFrame, cuts: list[np.ndarray], n_months: int, n_configs: int, setting: Setting) -> RDD:
    """Blocks of rows: binned inputs, and the pairs of rows and models with their margins (zero so far)."""
    total = rows.agg(F.sum(F.lit(n_months + 1) - F.col("use"))).first()[0] or 0
    parts = max(1, math.ceil(total / PARTITION_PAIRS))
    keys, days = [*KEY_COLUMNS, "y"], setting.window_days
    used = [*(F.col(k).cast("string") for k in KEY_COLUMNS), F.col("y").cast("double"), "use", "asked", F.col("mean_28d").cast("double").alias("level_28d"), *(F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate((*INPUTS, "grp_mean")))]

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.sort_values("use", kind="stable")
            values = [pdf[f"x{j}"].to_numpy(float) for j in range(len(cuts))]
            bins = [np.where(np.isnan(x), 0, np.searchsorted(cut, x, side="left") + 1) for x, cut in zip(values, cuts)]
            rows_of = np.searchsorted(pdf["use"].to_numpy(np.int64), np.arange(n_months), side="right")  # rows that month m may use come first
            asked = pdf["asked"].to_numpy(np.int64)
            ask = np.flatnonzero(asked >= 0)
            block = {
                "keys": pickle.dumps(pdf[keys].iloc[ask]), "y": pdf["y"].to_numpy(float), "level": pdf["level_28d"].to_numpy(float) * days, "bins": np.array(bins, np.uint8),
                "row": np.concatenate([np.arange(k, dtype=np.int32) for k in rows_of] + [ask.astype(np.int32)]),
                "month": np.concatenate([np.repeat(np.arange(n_months), rows_of), asked[ask]]).astype(np.int16), "rows_of": rows_of,
                "margin": np.zeros((n_configs, rows_of.sum() + len(ask)), np.float32),
            }
            yield pd.DataFrame({"block": [pickle.dumps(block, protocol=5)]})

    made = rows.select(*used).repartition(parts).mapInPandas(build, "block binary")
    return stage(made, "boost-blocks").rdd.map(lambda r: pickle.loads(r["block"]))


def _training(block: dict) -> slice:
    """The training pairs; the pairs of asked rows follow them."""
    return slice(0, int(block["rows_of"].sum()))


def _leaf(block: dict, c: int, tree: Tree, levels: int, pairs: slice = slice(None)) -> np.ndarray:
    """The node that each pair reaches after `levels` levels of a tree of configuration c."""
    month, row = block["month"][pairs].astype(np.int64), block["row"][pairs]
    rows, bins = block["bins"].shape[1], block["bins"].ravel()
    node = np.zeros(len(row), np.int64)
    for k in range(levels):
        at = month * (1 << k) + node
        node = 2 * node + (bins[row + tree.feature[k][c].ravel()[at].astype(np.int64) * rows] > tree.cut[k][c].ravel()[at])
    return node


def _moved(block: dict, start: np.ndarray | None, trees: Sequence[Tree], models: Sequence[Model]) -> dict:
    """The block with its margins after the start values and some trees."""
    if start is None and not trees:
        return block
    margin = block["margin"].copy()
    month = block["month"].astype(np.int64)
    for c, model in enumerate(models):
        if start is not None:
            margin[c] += start[c, month]
            if model.level == "offset":
                with np.errstate(divide="ignore", invalid="ignore"):
                    margin[c] += np.log(block["level"][block["row"]])
        for tree in trees:
            margin[c] += tree.value[c].ravel()[month * tree.value.shape[2] + _leaf(block, c, tree, len(tree.feature))]
    return block | {"margin": margin}


def _label(block: dict, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Label and weight of the training pairs."""
    row = block["row"][_training(block)]
    y, level = block["y"][row], block["level"][row]
    return (y / level, level) if model.level == "ratio" else (y, np.ones_like(y))


def _start_sums(blocks: Iterable[dict], models: Sequence[Model], months: int) -> Iterator[np.ndarray]:
    """(configuration, month): sums of weighted labels and of what they are compared with."""
    out = np.zeros((2, len(models), months))
    for block in blocks:
        month = block["month"][_training(block)]
        for c, model in enumerate(models):
            y, w = _label(block, model)
            base = block["level"][block["row"][_training(block)]] if model.level == "offset" else w
            out[0, c] += np.bincount(month, w * y, months)
            out[1, c] += np.bincount(month, base, months)
    yield out


@dataclass
class Sums:
    """By configuration: gradients, second derivatives and rows by (input, month, node, bin); absolute error and weight by month."""

    cells: np.ndarray
    errors: np.ndarray

    def __add__(self, other: Sums) -> Sums:
        return Sums(self.cells + other.cells, self.errors + other.errors)

    def of_models(self) -> Iterator[tuple[tuple[int, int], Sums]]:
        """The sums of each (configuration, month), which is a model of its own."""
        for c, m in np.ndindex(self.errors.shape[0], self.errors.shape[2]):
            yield (c, m), Sums(self.cells[c : c + 1, :, :, m : m + 1], self.errors[c : c + 1, :, m : m + 1])


def _histograms(blocks: Iterable[dict], models: Sequence[Model], months: int, inputs: int, done: Sequence[Tree], grown: Tree) -> Iterator[Sums]:
    """Sums over the training pairs of a partition, by the nodes that `grown` has so far."""
    nodes = 1 << len(grown.feature)
    shape = (months, nodes, BINS)
    out = Sums(np.zeros((len(models), 3, inputs, *shape)), np.zeros((len(models), 2, months)))
    for block in blocks:
        block = _moved(block, None, done, models)
        pairs = _training(block)
        month = block["month"][pairs].astype(np.int64)
        cells = [(month * nodes + _leaf(block, c, grown, len(grown.feature), pairs)) * BINS for c in range(len(models))]
        labels = [_label(block, model) for model in models]
        margins = [block["margin"][c][pairs].astype(float) for c in range(len(models))]
        steps = [(g * w, h * w) for (g, h), w in ((m.gradients(y, f), w) for m, (y, w), f in zip(models, labels, margins))]
        for j in range(inputs):
            binned = np.concatenate([block["bins"][j, :k] for k in block["rows_of"]])
            for c, model in enumerate(models):
                k = cells[c] + binned
                count = np.bincount(k, minlength=math.prod(shape)).reshape(shape)
                plain = not model.log_link and model.level != "ratio"  # every second derivative is one
                out.cells[c, 0, j] += np.bincount(k, steps[c][0], math.prod(shape)).reshape(shape)
                out.cells[c, 1, j] += count if plain else np.bincount(k, steps[c][1], math.prod(shape)).reshape(shape)
                out.cells[c, 2, j] += count
        for c, (y, w) in enumerate(labels):
            out.errors[c, 0] += np.bincount(month, np.abs(margins[c] - y) * w, months)
            out.errors[c, 1] += np.bincount(month, w, months)
    yield Sums(out.cells.astype(np.float32), out.errors)


def _best(sums: Sums, c: int, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Input and cut of each (month, node) of a configuration, and the values of both sides of the cut."""
    g, h, n = sums.cells[c].astype(float).transpose(0, 2, 3, 1, 4)  # each (month, node, input, bin)
    months, nodes, _, _ = g.shape
    left = [np.cumsum(x, axis=3)[..., :-1] for x in (g, h, n)]
    whole = [x[:, :, :1].sum(3, keepdims=True) for x in (g, h, n)]
    right = [x - a for x, a in zip(whole, left)]
    gain = sum(a * a / (b + model.ridge) for a, b, _ in (left, right)) - whole[0] ** 2 / (whole[1] + model.ridge)
    least = 1 if model.symmetric else model.min_rows
    fits = (left[2] >= least) & (right[2] >= least)
    if model.symmetric:  # all nodes of a level share one split
        gain = np.where(fits.any(1, keepdims=True), np.where(fits, gain, 0.0).sum(1, keepdims=True), -np.inf) + np.zeros((1, nodes, 1, 1))
    else:
        gain = np.where(fits, gain, -np.inf)
    flat = gain.reshape(months, nodes, -1)
    best = flat.argmax(2)
    found = np.take_along_axis(flat, best[..., None], 2)[..., 0] > 1e-9
    feature, cut = np.where(found, best // (BINS - 1), 0), np.where(found, best % (BINS - 1), BINS)  # without a split all go left
    m, k = np.ogrid[:months, :nodes]
    at = (m, k, feature, np.minimum(cut, BINS - 2))
    scale = (sums.errors[c, 0] / np.maximum(sums.errors[c, 1], 1e-300))[:, None] if model.loss == "absolute" else 1.0
    sides = [[np.where(found, x[i][at], whole[i][:, :, 0, 0]) for i in (0, 1)] for x in (left, right)]
    value = np.stack([-model.rate * scale * a / (b + model.ridge) for a, b in sides], axis=2)
    return feature.astype(np.int16), cut.astype(np.int16), value.astype(np.float32)


def _level(blocks: RDD, models: list[Model], months: int, inputs: int, held: list[Tree], tree: Tree) -> Tree:
    """The tree with one level more. A function of its own, so that a job takes along nothing else.

    Sums are added up and decided on where they are, model by model; the driver gets the splits alone, a few bytes a node.
    """
    def sums(it: Iterable[dict]) -> Iterator[tuple[tuple[int, int], Sums]]:
        for part in _histograms(it, models, months, inputs, held, tree):
            yield from part.of_models()

    parts = blocks.mapPartitions(sums)
    if blocks.getNumPartitions() > 1:
        parts = parts.reduceByKey(operator.add, min(blocks.getNumPartitions(), len(models) * months))
    best = dict(parts.map(lambda kv: (kv[0], _best(kv[1], 0, models[kv[0][0]]))).collect())
    feature, cut, value = (np.stack([np.concatenate([best[c, m][i] for m in range(months)]) for c in range(len(models))]) for i in range(3))
    return Tree([*tree.feature, feature], [*tree.cut, cut], value.reshape(len(models), months, -1))


def grow(rows: DataFrame, cuts: list[np.ndarray], months: int, models: Sequence[Model], setting: Setting, trees: int, depth: int) -> DataFrame:
    """Predictions of the asked rows by every model: the keys, y, model and y_pred."""
    sc = rows.sparkSession.sparkContext
    models = list(models)
    blocks = _blocks(rows, cuts, months, len(models), setting).persist(StorageLevel.MEMORY_AND_DISK)
    sums = blocks.mapPartitions(lambda it: _start_sums(it, models, months)).treeReduce(operator.add)
    with np.errstate(divide="ignore", invalid="ignore"):
        start = np.where(sums[1] > 0, sums[0] / np.maximum(sums[1], 1e-300), np.nan)
        start = np.array([np.log(s) if m.log_link else s for s, m in zip(start, models)]).astype(np.float32)
    old, blocks = blocks, blocks.map(lambda b: _moved(b, start, (), models)).persist(StorageLevel.MEMORY_AND_DISK)
    held: list[Tree] = []
    moves = 0
    for _ in range(trees):
        tree = Tree([], [])
        for _ in range(depth):
            tree = _level(blocks, models, months, len(cuts), held, tree)
            if old is not None:  # this level has filled the cache of the new blocks
                old.unpersist()
                old = None
        held = [*held, tree]
        if len(held) == MOVE:
            shared, held, moves = sc.broadcast(held), [], moves + 1  # a few numbers a model
            old, blocks = blocks, blocks.map(lambda b, shared=shared: _moved(b, None, shared.value, models)).persist(StorageLevel.MEMORY_AND_DISK)
            if moves % CHECKPOINT == 0:
                blocks.checkpoint()
    last = held

    def predicted(block: dict) -> list[tuple]:
        block = _moved(block, None, last, models)
        at = slice(_training(block).stop, None)
        keys, level = pickle.loads(block["keys"]), block["level"][block["row"][at]]
        parts = []
        for c, model in enumerate(models):
            margin = block["margin"][c][at].astype(float)
            y_pred = np.exp(margin) if model.log_link else margin * level if model.level == "ratio" else margin
            usable = np.isfinite(y_pred) & ((level > 0) if model.level != "none" else True)
            parts += [(*k, None if math.isnan(t) else float(t), model.name, float(p) if ok else None) for (*k, t), p, ok in zip(keys.itertuples(index=False, name=None), y_pred, usable)]
        return parts

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{c} string" for c in KEY_COLUMNS) + ", y double, model string, y_pred double"  # keys travel as text
    made = rows.sparkSession.createDataFrame(blocks.flatMap(predicted), schema)
    out = stage(made.withColumns({c: F.col(c).cast(kinds[c]) for c in KEY_COLUMNS}), "boost-predictions")
    for used in (blocks, old):
        if used is not None:
            used.unpersist()
    return out


def boosted_backtest(features: DataFrame, models: Sequence[Model], setting: Setting, months: Sequence[str], trees: int, depth: int) -> DataFrame:
    """Prediction rows of all models: refit for every month on everything known at its first cutoff.

    A month without training rows predicts null, as does a row without a positive level where the model needs one.
    """
    if len({m.name for m in models}) < len(models):
        raise ValueError("models need different names")
    ensure_checkpoint_dir(features.sparkSession)
    spans = [list(months)[i : i + SPAN_MONTHS] for i in range(0, len(months), SPAN_MONTHS)]

    def of_span(span: Sequence[str]) -> DataFrame:
        rows, cuts = _prepared(features, span, setting)
        return grow(rows, cuts, len(span), models, setting, trees, depth)

    with ThreadPoolExecutor(SPAN_THREADS) as pool:  # spans are independent; each job is distributed
        got = append_all(list(pool.map(of_span, spans)))
    end = setting.end_of_issue(F.col("issue_date"))
    return got.select(F.lit(setting.key).alias("spec"), "model", "issue_date", "cutoff", "target_start", end.alias("target_end"), "grp", F.col("y").alias("y_true"), "y_pred")

