import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import day, rows_of
from tallycast.operators import joins as J
from tallycast.operators import lag_audit as L


@pytest.mark.parametrize("hot", [False, True])
def test_asof_matches_pandas(spark, hot):
    rng = np.random.default_rng(5)
    n = 4000
    keys = np.where(rng.random(n) < (0.6 if hot else 0.1), 0, rng.integers(1, 20, n))
    t = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.permutation(n * 50)[:n], unit="min")
    pdf = pd.DataFrame({"k": keys, "t": t, "id": np.arange(n), "fact": rng.random(n) < 0.3})
    df = spark.createDataFrame(pdf)
    facts = df.where("fact").select("k", F.col("t").alias("ft"), F.col("id").alias("fid"))
    got = J.asof_join(df.where("not fact").select("k", "t", "id"), facts, ["k"], "t", "ft", ["fid"], F.date_trunc("week", "__t"))
    want = pd.merge_asof(pdf[~pdf.fact].sort_values("t"), pdf[pdf.fact].sort_values("t").rename(columns={"t": "ft", "id": "fid"})[["k", "ft", "fid"]],
                         left_on="t", right_on="ft", by="k")
    w = {int(r.id): None if pd.isna(r.fid) else int(r.fid) for r in want.itertuples()}
    g = {r.id: r.fid for r in got.collect()}
    assert g == w


def test_asof_takes_equal_times_and_skips_later_ones(spark):
    p = spark.createDataFrame([(1, day("2024-01-05")), (1, day("2024-01-01"))], "k int, t date")
    f = spark.createDataFrame([(1, day("2024-01-05"), 7), (1, day("2024-01-06"), 8)], "k int, ft date, v int")
    assert rows_of(J.asof_join(p, f, ["k"], "t", "ft", ["v"]), "t", "v") == [(day("2024-01-01"), None), (day("2024-01-05"), 7)]


def test_nearest_value_brute_force(spark):
    rng = np.random.default_rng(1)
    facts = sorted(rng.choice(10_000, 60, replace=False).tolist())
    probes = rng.integers(-100, 11_000, 200).tolist() + [(facts[0] + facts[1]) // 2]
    p = spark.createDataFrame([(i, float(x)) for i, x in enumerate(probes)], "i int, x double")
    f = spark.createDataFrame([(float(v), k) for k, v in enumerate(facts)], "v double, tag int")
    got = {r.i: r.tag for r in J.nearest_value(p, f, "x", "v", ["tag"], 500.0).collect()}
    want = {i: min(range(60), key=lambda k: (abs(facts[k] - x), facts[k])) for i, x in enumerate(probes)}
    assert got == want


def test_flag_windows(spark):
    r = spark.createDataFrame([("m", 1, day("2024-01-01"), day("2024-01-07")), ("m", 1, day("2024-01-08"), day("2024-01-14")), ("m", 2, day("2024-01-01"), day("2024-01-07"))],
                              "model string, grp bigint, target_start date, target_end date")
    a = spark.createDataFrame([(day("2024-01-07"), 1, True), (day("2024-01-08"), 1, False), (day("2024-01-03"), 2, None)], "date date, grp bigint, anomaly boolean")
    got = rows_of(J.flag_windows(r, a), "grp", "target_start", "anomaly")
    assert [x[2] for x in got] == [True, False, False]


def test_validated_join(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, a string")
    b = spark.createDataFrame([(1, "z")], "k int, b string")
    assert J.validated_join(a, b, ["k"], "many_to_one").count() == 2
    with pytest.raises(ValueError, match="one_to_one"):
        J.validated_join(a, b, ["k"], "one_to_one")


def test_availability_uses_greatest_content(spark):
    import datetime as dt

    rows = [(dt.datetime(2024, 1, 1, 20), day("2024-01-01")), (dt.datetime(2024, 1, 2, 20), day("2023-12-30")), (dt.datetime(2024, 1, 4, 8), day("2024-01-03"))]
    m = spark.createDataFrame(rows, "uploaded_at timestamp_ntz, content_date date")
    got = rows_of(L.availability(m, 9), "prep_day", "content_date", "lag_days")
    assert got == [(day("2024-01-02"), day("2024-01-01"), 2), (day("2024-01-03"), day("2024-01-01"), 3), (day("2024-01-04"), day("2024-01-03"), 2)]
