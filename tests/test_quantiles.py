import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallycast.functions import quantiles as Q


def check(spark, values, probs):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = Q.exact_quantiles(df, [], "v", {f"q{i}": q for i, q in enumerate(probs)}).first()
    for i, q in enumerate(probs):
        assert got[f"q{i}"] == pytest.approx(np.quantile(values, q), rel=1e-12, abs=1e-12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=60))
def test_small_groups(spark, values):
    check(spark, values, [0.0, 0.05, 0.5, 0.95, 1.0])


@pytest.mark.parametrize("shape", ["continuous", "ties", "heavy"])
def test_bracketed_groups(spark, shape):
    rng = np.random.default_rng(3)
    n = 60_000
    values = {"continuous": rng.normal(size=n), "ties": rng.integers(0, 5, n), "heavy": np.where(rng.random(n) < 0.4, 7.0, rng.pareto(1.0, n))}[shape]
    check(spark, values.astype(float), [0.001, 0.1, 0.5, 0.9, 0.99])


def test_hot_key_and_null_key(spark):
    df = spark.range(40_000).select(
        F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 == 0, "cold").alias("k"), (F.col("id") * 7919 % 10007).cast("double").alias("v"))
    pdf = df.toPandas()
    got = {r.k: r.m for r in Q.exact_quantiles(df, ["k"], "v", {"m": 0.5}).collect()}
    want = pdf.groupby("k", dropna=False)["v"].median()
    assert got["hot"] == want["hot"] and got["cold"] == want["cold"] and got[None] == want[[k for k in want.index if k != k or k is None][0]]


def test_nearest_rank(spark):
    values = list(range(1, 152))
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = Q.exact_quantiles(df, [], "v", {"a": 0.99, "b": 0.05}, nearest=True).first()
    assert (got.a, got.b) == (150.0, 9.0)  # indices 148.5 and 7.5 round up


@pytest.mark.parametrize("shape", ["ties", "heavy", "wide"])
def test_wrong_cuts_cost_rounds_only(spark, monkeypatch, shape):
    """Cuts far off, all alike or at one end: counts still decide."""
    rng = np.random.default_rng(6)
    n = 4000
    values = {"ties": rng.integers(0, 4, n), "heavy": np.where(rng.random(n) < 0.9, 7.0, rng.normal(size=n)), "wide": rng.choice([-1, 1], n) * 10.0 ** rng.integers(-200, 200, n)}[shape]
    monkeypatch.setattr(Q, "CUTS", 9)
    right, calls = Q._sketched, []

    def wrong(column, shares):
        calls.append(1)
        return F.array(*[F.lit(-1e9)] * len(shares)) if len(calls) == 1 else right(column, shares)

    monkeypatch.setattr(Q, "_sketched", wrong)
    check(spark, values.astype(float), [0.0, 0.25, 0.5, 0.77, 1.0])
    assert len(calls) > 1


def test_many_keys_one_hot(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, -1).otherwise(F.col("id") % 50).alias("a"), F.when(F.col("id") % 7 > 0, "x").alias("b"),
                                    F.when(F.col("id") % 11 > 0, F.pow(F.col("id") * 7919 % 30011, F.lit(3.0))).alias("v"))
    got = {(r.a, r.b): (r.q1, r.q9, r.n) for r in Q.exact_quantiles(df, ["a", "b"], "v", {"q1": 0.1, "q9": 0.9}, also=[F.count("v").alias("n")]).collect()}
    pdf = df.toPandas()
    for (a, b), part in pdf.groupby(["a", "b"], dropna=False):
        want = part["v"].dropna()
        x = got[a, None if b is None or b != b else b]
        assert x[2] == len(want) and x[:2] == (pytest.approx(want.quantile(0.1), rel=1e-12), pytest.approx(want.quantile(0.9), rel=1e-12))


def test_empty_and_null_only(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0)], "k string, v double")
    assert {r.k: r.m for r in Q.exact_quantiles(df, ["k"], "v", {"m": 0.5}).collect()} == {"a": None, "b": 2.0}
    assert Q.exact_quantiles(df.where("false"), ["k"], "v", {"m": 0.5}).count() == 0
    assert Q.exact_quantiles(df.where("false"), [], "v", {"m": 0.5}).first().m is None
