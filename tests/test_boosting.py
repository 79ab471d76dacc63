"""Boosted trees against a plain one-model booster, and what they may not see."""

import datetime as dt
import pickle

import numpy as np
import pandas as pd
import pytest
from pyspark import RDD
from pyspark.sql import functions as F

from tallycast.models import boosting as B
from tallycast.models import learners as L
from tallycast.operators import features as X
from tallycast.plans.registry import registry_run
from tallycast.spec import DAILY, WEEKLY
from tests.helpers import PANEL, day, rows_of

MONTHS = ["2024-02-01", "2024-03-01", "2024-04-01"]


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i, d in enumerate(pd.date_range("2023-01-01", "2024-04-30").date):
        for g, level in ((1, 30), (2, 60), (None, 90)):
            n = int(rng.poisson(level * (1 + 0.3 * np.sin(2 * np.pi * i / 7))))
            rows.append((d, g, None, None) if d == day("2024-03-05") else (d, g, n, n // 3))
    return spark.createDataFrame(rows, PANEL).cache()


@pytest.fixture(scope="module")
def features(panel):
    return X.feature_table(panel, DAILY).cache()


def plain_booster(bins, y, w, start, model, trees, depth, ask):
    """One model, one month, by loops: margins of the asked rows."""
    f, out = start.copy(), ask[1].copy()
    for _ in range(trees):
        (g, h) = model.gradients(y, f)
        g, h = g * w, h * w
        scale = (np.abs(f - y) * w).sum() / w.sum() if model.loss == "absolute" else 1.0

        def value(rows):
            return -model.rate * scale * g[rows].sum() / (h[rows].sum() + model.ridge)

        level = [(np.arange(len(y)), np.arange(len(out)))]
        for _ in range(depth):
            new = []
            for rows, asked in level:
                best = (1e-9, None)
                for j in range(bins.shape[0]):
                    for cut in range(B.BINS - 1):
                        a, b = rows[bins[j, rows] <= cut], rows[bins[j, rows] > cut]
                        if len(a) < model.min_rows or len(b) < model.min_rows:
                            continue
                        gain = sum(g[r].sum() ** 2 / (h[r].sum() + model.ridge) for r in (a, b)) - g[rows].sum() ** 2 / (h[rows].sum() + model.ridge)
                        if gain > best[0] * (1 + 1e-6):
                            best = (gain, (j, cut))
                if best[1] is None:
                    new += [(rows, asked), (rows[:0], asked[:0])]
                    continue
                j, cut = best[1]
                new += [(rows[bins[j, rows] <= cut], asked[ask[0][j, asked] <= cut]), (rows[bins[j, rows] > cut], asked[ask[0][j, asked] > cut])]
            level = new
        for rows, asked in level:
            if len(rows):
                f[rows] += value(rows)
                out[asked] += value(rows)
    return out


@pytest.mark.parametrize(("loss", "level"), [("squared", "none"), ("absolute", "ratio"), ("poisson", "offset"), ("tweedie", "offset")])
def test_equals_a_plain_booster(spark, features, loss, level):
    model = B.Model("m", loss, level, rate=0.3, min_rows=20)
    got = {(r.issue_date, r.grp): r.y_pred for r in B.boosted_backtest(features, [model], DAILY, MONTHS[1:2], 2, 2).collect()}
    rows, cuts = B._prepared(features, MONTHS[1:2], DAILY)
    pdf = rows.toPandas()
    values = [pdf[c].astype(float).to_numpy() for c in (*B.INPUTS, "grp_mean")]
    bins = np.array([np.where(np.isnan(x), 0, np.searchsorted(c, x) + 1) for x, c in zip(values, cuts)])
    lv, y = pdf["mean_28d"].astype(float).to_numpy(), pdf["y"].astype(float).to_numpy()
    train, ask = np.flatnonzero(pdf["use"] == 0), np.flatnonzero(pdf["asked"] == 0)
    assert pdf["issue_date"][train].max() + dt.timedelta(days=1) <= day("2024-03-01") - dt.timedelta(days=2)
    label, w = (y / lv, lv) if level == "ratio" else (y, np.ones(len(y)))
    start = (label * w)[train].sum() / (lv if level == "offset" else w)[train].sum()
    first = np.full(len(y), np.log(start) if model.log_link else start) + (np.log(lv) if level == "offset" else 0)
    margin = plain_booster(bins[:, train], label[train], w[train], first[train], model, 2, 2, (bins[:, ask], first[ask]))
    want = np.exp(margin) if model.log_link else margin * lv[ask] if level == "ratio" else margin
    assert len(got) == len(ask)
    for i, p in zip(ask, want):
        grp = None if pd.isna(pdf["grp"][i]) else pdf["grp"][i]
        if level != "none" and not lv[i] > 0:
            assert got[pdf["issue_date"][i], grp] is None
        else:
            assert got[pdf["issue_date"][i], grp] == pytest.approx(p, rel=1e-4)


def test_no_model_sees_the_future(panel, monkeypatch):
    monkeypatch.setattr(B, "SPAN_MONTHS", 2)
    models = [B.Model("a", "poisson", "offset", rate=0.3), B.Model("b", "absolute", "ratio", rate=0.3), B.Model("c", "squared", symmetric=True, rate=0.3)]

    def run(p):
        rows = B.boosted_backtest(X.feature_table(p, WEEKLY), models, WEEKLY, MONTHS, 3, 3)
        return rows_of(rows.where("cutoff <= '2024-03-20'").withColumn("grp", F.coalesce("grp", F.lit(0))), "model", "issue_date", "grp", "y_pred")

    a, b = run(panel), run(panel.withColumn("n", F.when(F.col("date") > "2024-03-20", 9999).otherwise(F.col("n"))))
    assert a and a == b


def test_moves_and_checkpoints_change_nothing(features, monkeypatch):
    models = [B.Model("a", "tweedie", "offset", rate=0.3, power=1.2), B.Model("b", "absolute", rate=0.3)]

    def run():
        rows = B.boosted_backtest(features, models, DAILY, MONTHS, 5, 2).where("y_pred is not null").withColumn("grp", F.coalesce("grp", F.lit(0)))
        return {r[:3]: r[3] for r in rows_of(rows, "model", "issue_date", "grp", "y_pred")}

    one = run()
    monkeypatch.setattr(B, "MOVE", 1)
    monkeypatch.setattr(B, "CHECKPOINT", 2)
    monkeypatch.setattr(B, "PARTITION_PAIRS", 500)  # many partitions, summed up as a tree
    two = run()
    assert one.keys() == two.keys() and all(two[k] == pytest.approx(v, rel=1e-4) for k, v in one.items())


def test_learns_the_week(features):
    models = [L.boosted_model(L.select_configs([n])[0], {"rate": 0.2}) for n in ("gbt_l2_raw", "gbt_poisson", "sym_tweedie", "gbt_l1")]
    rows = B.boosted_backtest(features, models, DAILY, MONTHS, 15, 4).where("y_true is not null and y_pred is not null")
    s = {r.model: r.w for r in rows.groupBy("model").agg((F.sum(F.abs(F.col("y_pred") - F.col("y_true"))) / F.sum("y_true")).alias("w")).collect()}
    plain = features.where("issue_date >= '2024-02-01' and y is not null").select((F.sum(F.abs(F.col("y") - F.col("mean_28d"))) / F.sum("y")).alias("w")).first().w
    assert set(s) == {m.name for m in models} and max(s.values()) < 0.75 * plain


def test_edges(spark, features):
    with pytest.raises(ValueError, match="does not go"):
        B.Model("m", "squared", "offset")
    with pytest.raises(ValueError, match="unknown loss"):
        B.Model("m", "huber")
    with pytest.raises(ValueError, match="different names"):
        B.boosted_backtest(features, [B.Model("m", "squared")] * 2, DAILY, MONTHS, 1, 1)
    early = B.boosted_backtest(features, [B.Model("m", "poisson", "offset")], DAILY, ["2023-01-01"], 2, 2)
    assert early.count() > 0 and early.where("y_pred is not null").count() == 0  # nothing to train on
    assert B.boosted_backtest(features.where("false"), [B.Model("m", "squared")], DAILY, MONTHS, 1, 1).count() == 0


def test_topdown_over_boosted_totals(panel):
    rows = registry_run(panel.where("grp is not null"), ["topdown_gbt_poisson_raw", "gbt_poisson"], DAILY, "2024-03-01", "2024-04-30", (1, 2), trees=4, params={"rate": 0.3})
    done = rows.where("y_true is not null and y_pred is not null")
    assert {r.model for r in done.select("model").distinct().collect()} == {"topdown_gbt_poisson_raw", "gbt_poisson"}
    wape = done.groupBy("model").agg((F.sum(F.abs(F.col("y_pred") - F.col("y_true"))) / F.sum("y_true")).alias("w")).collect()
    assert all(r.w < 0.3 for r in wape)


@pytest.mark.parametrize("pairs", [1 << 17, 1 << 9])
def test_driver_gets_splits_alone(features, monkeypatch, pairs):
    """Sums of gradients stay in the tasks, in one partition of blocks or in several."""
    sizes, collect = [], RDD.collect

    def weighed(self):
        got = collect(self)
        sizes.append(len(pickle.dumps(got)))
        return got

    monkeypatch.setattr(B, "PARTITION_PAIRS", pairs)
    monkeypatch.setattr(RDD, "collect", weighed)
    models = [B.Model("a", "squared", rate=0.2), B.Model("b", "absolute", rate=0.2)]
    assert B.boosted_backtest(features, models, DAILY, MONTHS, 1, 3).where("y_pred is not null").count() > 0
    assert len(sizes) >= 3 and max(sizes) < 1 << 14
