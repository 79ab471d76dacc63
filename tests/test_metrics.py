import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import day
from tallycast.operators import alerts as A
from tallycast.operators import ensemble as E
from tallycast.operators import metrics as M

SCHEMA = "spec string, model string, issue_date date, cutoff date, target_start date, target_end date, grp bigint, y_true double, y_pred double"


def result(model, d, grp, true, pred):
    d = day(d) if isinstance(d, str) else d
    return ("s", model, d - dt.timedelta(days=1), d - dt.timedelta(days=3), d, d, grp, true, pred)


def frame(spark, rows):
    return spark.createDataFrame([result(*r) for r in rows], SCHEMA)


def test_score_hand_values(spark):
    df = frame(spark, [("a", "2024-01-01", 1, 10.0, 12.0), ("a", "2024-01-02", 1, 20.0, 16.0), ("a", "2024-01-03", 1, None, 5.0)])
    r = M.score(df).first()
    assert (r.n, r.mae, r.bias, r.median_error, r.under_share) == (2, 3.0, -1.0, -1.0, 0.5)
    errors = [3, -1, -2, -6, 0]
    df = frame(spark, [("a", day("2024-01-01") + dt.timedelta(days=i), 1, 10.0, 10.0 + e) for i, e in enumerate(errors)])
    r = M.score(df).first()
    assert (r.median_error, r.under_share) == (-1.0, 0.6) and r.bias == pytest.approx(-1.2)
    s = M.error_spread(df).first()
    mean = sum(errors) / 5
    assert s.error_var == pytest.approx(sum((e - mean) ** 2 for e in errors) / 5)


def weeks(spark, shift):
    rows = []
    for w in range(10):
        for g in (1, 2, 3):
            d = day("2024-01-01") + dt.timedelta(weeks=w)
            rows += [("a", d, g, 50.0, 52.0 + (w % 2)), ("b", d, g, 50.0, 52.0 + (w % 2) + shift)]
    return frame(spark, rows)


def test_bootstrap(spark):
    same = M.paired_bootstrap(weeks(spark, 0.0), "a", "b", 200).first()
    assert (same["diff"], same.ci_low, same.ci_high, same.n_blocks) == (0.0, 0.0, 0.0, 10)
    r = M.paired_bootstrap(weeks(spark, 1.0), "a", "b", 200).first()
    assert r["diff"] == pytest.approx(-1.0) and r.ci_low == pytest.approx(-1.0) and r.ci_high == pytest.approx(-1.0)
    again = M.paired_bootstrap(weeks(spark, 1.0), "a", "b", 200).first()
    assert again == r


def test_wape_is_mae_over_mean_actual(spark):
    df = weeks(spark, 1.0)
    w = {r.model: r.wape for r in M.wape(df).collect()}
    s = {r.model: r.mae for r in M.score(df).collect()}
    assert all(w[m] == pytest.approx(s[m] / 50) for m in w)
    assert M.wape(frame(spark, [("a", "2024-01-01", 1, 0.0, 1.0)])).first().wape is None


def test_ties(spark):
    t = spark.createDataFrame([("same_wd_13w", 1.0), ("same_wd_4w", 1.0)], "model string, mae double")
    assert M.best_model(t, tie=M.window_length(F.col("model"))).first().model == "same_wd_4w"
    assert M.best_model(t).first().model == "same_wd_13w"


def test_combiners_propagate_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 6.0), (1.0, None, 6.0)], "a double, b double, c double")
    m = ["a", "b", "c"]
    got = df.select(E.combine_mean(m).alias("x"), E.combine_median(m).alias("y"), E.combine_weighted(m, {"a": F.lit(1.0), "b": F.lit(0.0), "c": F.lit(0.0)}).alias("z")).collect()
    assert tuple(got[0]) == (3.0, 2.0, 1.0) and tuple(got[1]) == (None, None, None)


def test_scaled_weights():
    assert E.scaled_weights(["a", "b"], {"b": 3, "a": 1}) == {"a": 0.25, "b": 0.75}
    for bad in ({"a": 1}, {"a": 1, "b": -1}, {"a": 0, "b": 0}, {"a": float("nan"), "b": 1}):
        with pytest.raises(ValueError):
            E.scaled_weights(["a", "b"], bad)


def test_lattice():
    v = E.simplex_lattice(5, 10)
    assert v.shape == (1001, 5) and abs(v.sum(axis=1) - 1).max() < 1e-12
    assert [list(x) for x in E.simplex_lattice(2, 2)] == [[0.0, 1.0], [0.5, 0.5], [1.0, 0.0]]


def members(spark):
    rows = []
    for i in range(200):
        d = day("2024-01-01") + dt.timedelta(days=i)
        for g in (1, 2):
            y = 50.0 + (i * 7 + g * 3) % 11
            rows += [("a", d, g, y, y + 2 + i % 3), ("b", d, g, y, y - 2 - (i + 1) % 3), ("c", d, g, y, 80.0)]
    return frame(spark, rows)


def test_learned_weights_beat_members_and_refine(spark):
    wide = E.wide_predictions(members(spark), ["a", "b", "c"])
    fits = E.rolling_weights(wide, ["a", "b", "c"], 2, "2024-03-01", "2024-06-30")
    rows = {r.month.isoformat(): r for r in fits.collect()}
    assert len(rows) == 5  # the first window of March is issued in February
    for m, r in rows.items():
        known = wide.where((F.col("target_end") <= r.cutoff) & F.col("y_true").isNotNull())
        assert r.n_rows == known.count()
        worst = [known.agg(F.avg(F.abs(F.col(c) - F.col("y_true")))).first()[0] for c in "abc"]
        assert r.train_mae <= min(worst) + 1e-9
    fine = {r.month.isoformat(): r.train_mae for r in E.refine_weights(wide, ["a", "b", "c"], fits).collect()}
    assert all(fine[m] <= rows[m].train_mae + 1e-9 for m in rows)


def test_weights_see_only_known_outcomes(spark):
    base = E.wide_predictions(members(spark), ["a", "b", "c"])
    poisoned = base.withColumn("y_true", F.when(F.col("target_end") > "2024-04-20", F.lit(1e6)).otherwise(F.col("y_true")))
    a, b = (E.rolling_weights(w, ["a", "b", "c"], 2, "2024-03-01", "2024-04-22").drop("n_rows").collect() for w in (base, poisoned))
    assert sorted(a) == sorted(b)


def test_alignment(spark):
    df = members(spark)
    E.require_alignment(df, ["a", "b", "c"])
    with pytest.raises(ValueError, match="incomplete_keys"):
        E.require_alignment(df.where("not (model = 'b' and grp = 2)"), ["a", "b", "c"])
    with pytest.raises(ValueError, match="conflicting_truth"):
        E.require_alignment(df.withColumn("y_true", F.when(F.col("model") == "c", F.col("y_true") + 1).otherwise(F.col("y_true"))), ["a", "b", "c"])


def test_alert_classes(spark):
    df = spark.createDataFrame([(5.0, 5.0, 5.0), (9.0, 1.0, 9.0), (1.0, 1.0, 9.0), (3.0, 1.0, 9.0), (None, 1.0, 9.0)], "v double, low double, high double")
    inc = [r[0] for r in df.select(A.demand_class(F.col("v"))).collect()]
    strict = [r[0] for r in df.select(A.demand_class(F.col("v"), True)).collect()]
    assert inc == ["High", "High", "Low", "Normal", None] and strict == ["Normal", "Normal", "Normal", "Normal", None]


def test_warning_precision_null_without_warnings(spark):
    df = spark.createDataFrame([("a", 10.0, 1.0, 5.0), ("b", 10.0, 6.0, 5.0), ("b", 1.0, 6.0, 5.0)], "model string, y_true double, y_pred double, threshold double")
    got = {r.model: (r.recall, r.precision) for r in A.warning_metrics(df).collect()}
    assert got == {"a": (0.0, None), "b": (1.0, 0.5)}
