import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import PANEL, day, rows_of, uniform_panel
from tallycast.models import learners as L
from tallycast.models import linear, negbin, smoothing, topdown
from tallycast.models.gram import collect_gram
from tallycast.operators import anomalies as A
from tallycast.operators import decompose as D
from tallycast.operators import features as X
from tallycast.operators import series as S
from tallycast.plans import tuning as T
from tallycast.spec import DAILY, WEEKLY


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i, d in enumerate(pd.date_range("2023-01-01", "2024-06-30").date):
        for g, level in ((1, 30), (2, 60)):
            rate = level * (1 + 0.2 * np.sin(2 * np.pi * i / 7)) * (1 + 0.1 * np.cos(2 * np.pi * i / 365))
            n = int(rng.poisson(rate))
            rows.append((d, g, None, None) if d == day("2024-03-31") else (d, g, n, int(rng.binomial(n, 0.3))))
    return spark.createDataFrame(rows, PANEL).cache()


def test_gram(spark):
    x = np.random.default_rng(0).normal(size=(500, 3))
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"])).repartition(5)
    assert np.allclose(collect_gram(df, ["a", "b", "c"]), x.T @ x)


def test_linear_equals_least_squares(panel):
    feats = X.strict_features(panel)
    got = {(r.date, r.grp): r.y_pred for r in linear.monthly_linear(feats, (1, 2), "2024-05-01", "2024-06-30").collect()}
    pdf = feats.toPandas()
    pdf = pdf[pdf.n.notna()]
    for month in ("2024-05-01", "2024-06-01"):
        m = day(month)
        cols = list(X.STRICT_NUMERIC)
        train = pdf[pdf.date <= m - dt.timedelta(days=3)]
        fill = train[cols].astype(float).median()

        def design(p):
            return np.column_stack([p[cols].astype(float).fillna(fill), p.grp == 1, p.grp == 2, np.ones(len(p))]).astype(float)

        beta = np.linalg.lstsq(design(train), train.n.to_numpy(float), rcond=None)[0]
        test = pdf[(pdf.date >= m) & (pdf.date < (pd.Timestamp(m) + pd.offsets.MonthBegin(1)).date())]
        for r, want in zip(test.itertuples(), design(test) @ beta, strict=True):
            assert got[r.date, r.grp] == pytest.approx(want, rel=1e-6)


def test_linear_group_effects(spark):
    """Thousands of groups, one that is new, one that is not listed: equal to least squares with a dummy a group."""
    rng, first = np.random.default_rng(1), day("2024-01-01")
    rows = []
    for g in range(3000):
        for i in range(12):
            x = float(rng.normal())
            rows.append((first + dt.timedelta(days=int(rng.integers(0, 40))), g, int(50 + 10 * x + g % 17 + rng.integers(0, 3)), x, None if i == 5 else float(rng.normal())))
    rows += [(day("2024-02-20"), 9999, 70, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "date date, grp bigint, n bigint, a double, b double")
    got = linear.monthly_linear(df, None, "2024-02-01", "2024-02-29", numeric=("a", "b")).toPandas()
    pdf = df.toPandas()
    train = pdf[pdf.date <= day("2024-01-29")]
    fill = train["b"].median()
    x = train[["a", "b"]].fillna({"b": fill}).to_numpy()
    means = pd.DataFrame(np.column_stack([x, train.n]), index=train.grp).groupby(level=0).mean()
    centred = np.column_stack([x, train.n]) - means.loc[train.grp].to_numpy()
    beta = np.linalg.lstsq(centred[:, :2], centred[:, 2], rcond=None)[0]
    effect = means[2] - means[[0, 1]].to_numpy() @ beta
    overall = (effect * train.groupby("grp").size()).sum() / len(train)
    test = pdf[pdf.date >= day("2024-02-01")].fillna({"b": fill})
    want = effect.reindex(test.grp).fillna(overall).to_numpy() + test[["a", "b"]].to_numpy() @ beta
    key = ["date", "grp", "y_true", "y_pred"]
    test = pd.DataFrame({"date": test.date, "grp": test.grp, "y_true": test.n.astype(float), "y_pred": want})
    a, b = (t[key].sort_values(key).reset_index(drop=True) for t in (got, test))
    assert len(a) == len(b) > 5000 and (a.grp == b.grp).all() and np.allclose(a.y_pred, b.y_pred, rtol=1e-6)


def poison(panel, cutoff):
    return panel.withColumn("n", F.when(F.col("date") > cutoff, F.lit(10000)).otherwise(F.col("n")))


@pytest.mark.parametrize("make", [smoothing.smoothing_forecasts, smoothing.ar_forecasts])
@pytest.mark.parametrize("setting", [DAILY, WEEKLY])
def test_series_models_do_not_leak(panel, make, setting):
    a, b = (make(p, setting, "2024-03-01", "2024-06-30").where("cutoff <= '2024-05-10'") for p in (panel, poison(panel, "2024-05-10")))
    x, y = rows_of(a, "issue_date", "grp", "y_pred"), rows_of(b, "issue_date", "grp", "y_pred")
    assert x and all(u[:2] == v[:2] and u[2] == pytest.approx(v[2]) for u, v in zip(x, y, strict=True))


def test_gap_is_not_filled_from_the_future(spark, panel):
    """While a missing day is still open at the cutoff, later values must not matter."""
    a, b = (smoothing.smoothing_forecasts(p, DAILY, "2024-03-01", "2024-06-30").where("cutoff = '2024-03-31'") for p in (panel, poison(panel, "2024-03-31")))
    x, y = rows_of(a, "grp", "y_pred"), rows_of(b, "grp", "y_pred")
    assert len(x) == 2 and x == y and x[0][1] is not None


def test_smoothing_follows_constant_levels(spark):
    rows = [(day("2023-01-01") + dt.timedelta(days=i), g, lv, 0) for i in range(400) for g, lv in ((1, 20), (2, 50))]
    p = spark.createDataFrame(rows, PANEL)
    got = smoothing.smoothing_forecasts(p, WEEKLY, "2023-06-05", "2023-12-31").collect()
    assert got and all(r.y_pred == pytest.approx({1: 140, 2: 350}[r.grp]) for r in got)
    early = smoothing.smoothing_forecasts(p, DAILY, "2023-01-20", "2023-03-01").where("y_pred is not null").count()
    assert early == 0  # fewer than 91 known days


def test_ar_is_close_on_weekly_pattern(panel):
    f = smoothing.with_truth(smoothing.ar_forecasts(panel, DAILY, "2024-01-01", "2024-06-30"), panel, DAILY, "ar").where("y_true is not null")
    wape = f.select((F.sum(F.abs(F.col("y_pred") - F.col("y_true"))) / F.sum("y_true")).alias("w")).first().w
    assert wape < 0.2


def test_negative_binomial_recovers_effects(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(4000):
        ratio, wd = float(np.exp(rng.normal(0, 0.3))), int(rng.integers(1, 8))
        mu = 40 * ratio**0.6 * (1.3 if wd == 6 else 1.0)
        y = float(rng.poisson(rng.gamma(10, mu / 10)))
        rows.append((y, 40.0, ratio, 1.0, 40.0, 40.0, 40.0, 0.3, 0, 0, wd, 1, 1))
    cols = "y double, mean_28d double, ratio_7_28 double, ratio_28_91 double, same_wd_4w double, same_wd_13w double, lag_0 double, sub_share_28d double, holidays bigint, holiday_adjacent bigint, target_weekday bigint, target_month bigint, grp bigint"
    fit = negbin.fit(spark.createDataFrame(rows, cols), (1,), DAILY)
    b = dict(zip(fit.columns, fit.beta, strict=True))
    assert b["log_ratio_7_28"] == pytest.approx(0.6, abs=0.08) and b["weekday_6"] == pytest.approx(np.log(1.3), abs=0.08)
    assert fit.alpha == pytest.approx(0.1, abs=0.03)


def test_ratio_and_offset_learners(panel):
    feats = X.feature_table(panel, DAILY).cache()
    for name, params in (("gbt_l1", {"trees": 8, "depth": 3}), ("glm_poisson", {})):
        rows = L.monthly_backtest(feats, L.select_configs([name])[0], DAILY, ["2024-05-01"], params).where("y_true is not null")
        s = rows.select(F.count("*").alias("n"), (F.sum(F.abs(F.col("y_pred") - F.col("y_true"))) / F.sum("y_true")).alias("w")).first()
        assert s.n == 62 and s.w < 0.3
    train = L.month_training(feats, "2024-05-01", DAILY)
    assert train.agg(F.max("target_start")).first()[0] == day("2024-04-29")


def test_registry():
    assert [c.name for c in L.select_configs(L.CANDIDATES)] == [c.name for c in L.REGISTRY if c.name in L.CANDIDATES]
    with pytest.raises(ValueError):
        L.select_configs(["nope"])


def test_top_down_sums_to_total(panel):
    td = topdown.top_down_plain(panel, DAILY)
    sums = td.where("y_pred is not null").groupBy("cutoff").agg(F.sum("y_pred").alias("s"), F.max("total").alias("t")).collect()
    assert sums and all(r.s == pytest.approx(r.t) for r in sums)


def test_decomposition_finds_pattern_and_shock(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        n = int(60 + 0.05 * i + 12 * np.sin(2 * np.pi * i / 7) + rng.normal(0, 2)) + (80 if i == 250 else 0)
        d = day("2023-01-01") + dt.timedelta(days=i)
        rows.append((d, 1, None if i == 100 else n, None if i == 100 else 0))
    parts = D.decompose(spark.createDataFrame(rows, PANEL)).cache()
    z = A.robust_z(parts)
    hits = rows_of(z.where("anomaly"), "date")
    assert hits == [(day("2023-01-01") + dt.timedelta(days=250),)]
    assert z.where("n is null and z is not null").count() == 0 and z.count() == 400
    s = D.strengths(parts.where("date <> '2023-09-08'")).first()
    assert s.weekly_strength > 0.9
    r = parts.select(F.max(F.abs(F.col("seasonal") + F.col("trend") + F.col("resid") - F.col("n")))).first()[0]
    assert r < 1e-9


def test_median_polish_on_additive_table(spark):
    months = [day(f"2024-{m:02d}-01") for m in range(1, 8)]
    rows = [(m, g, 3.0 + 0.1 * i - 0.5 * (g == 2) + 0.7 * (g == 3)) for i, m in enumerate(months) for g in (1, 2, 3)]
    out = D.median_polish(spark.createDataFrame(rows, "month date, grp bigint, x double"))
    assert out.agg(F.max(F.abs("resid"))).first()[0] < 1e-9
    r = out.where("grp = 3").first()
    assert r.group_effect == pytest.approx(0.7) and r.overall == pytest.approx(3.3)
    assert out.select(F.max(F.abs(F.col("overall") + F.col("month_effect") + F.col("group_effect") + F.col("resid") - F.col("x")))).first()[0] < 1e-9


def test_pacf_of_autoregression(spark):
    rng, y = np.random.default_rng(8), [0.0]
    for _ in range(3000):
        y.append(0.6 * y[-1] + rng.normal())
    rows = [(day("2015-01-01") + dt.timedelta(days=i), 1, int(100 + 10 * v), 0) for i, v in enumerate(y)]
    p = spark.createDataFrame(rows, PANEL)
    got = {r.lag: r.pacf for r in S.pacf(p, 5).collect()}
    assert got[0] == 1.0 and got[1] == pytest.approx(0.6, abs=0.05) and all(abs(got[k]) < 0.06 for k in (2, 3, 4, 5))
    assert S.adf(p).first().p_value < 0.01 and S.kpss(p).first().p_value > 0.05


def test_unit_root_is_not_rejected(spark):
    walk = np.cumsum(np.random.default_rng(3).normal(size=1500))
    p = spark.createDataFrame([(day("2015-01-01") + dt.timedelta(days=i), 1, int(1000 + 20 * v), 0) for i, v in enumerate(walk)], PANEL)
    assert S.adf(p).first().p_value > 0.05 and S.kpss(p).first().p_value == pytest.approx(0.01)


def test_interpolation(spark):
    p = spark.createDataFrame([(day(f"2024-01-{d:02d}"), 1, n) for d, n in ((1, None), (2, 10), (3, None), (4, None), (5, 40), (6, None))], "date date, grp bigint, n bigint")
    assert [v for _, v in rows_of(S.interpolate(p, "n", "v"), "date", "v")] == [None, 10.0, 20.0, 30.0, 40.0, None]
    assert [v for _, v in rows_of(S.interpolate(p, "n", "v", edges=True), "date", "v")] == [10.0, 10.0, 20.0, 30.0, 40.0, 40.0]


def test_median_pruning(spark):
    rows = [(t, s, float(10 * (t if t < 5 else 9)), 10) for t in range(7) for s in range(5)]
    rows = [(t, s, 5.0 if t == 6 else l, n) for t, s, l, n in rows]
    run = T.running_mae(spark.createDataFrame(rows, "trial bigint, step bigint, loss double, n bigint"))
    got = {r.trial: (r.state, r.n_steps) for r in T.apply_pruning(run).collect()}
    assert got[5] == ("PRUNED", 4) and all(got[t] == ("COMPLETE", 5) for t in (0, 1, 2, 3, 4, 6))
    flags = {(r.trial, r.step) for r in T.median_rule(run).where("would_prune").collect()}
    assert flags == {(5, 3), (5, 4)}
    log = T.trial_log("m", [{"a": t} for t in range(7)], T.apply_pruning(run))
    assert T.best_trial(log).first().number == 0


def test_uniform_fixture_has_known_shape(spark):
    assert uniform_panel(spark, end="2023-12-31").count() == 730
