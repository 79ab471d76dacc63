import pytest
from pyspark.sql import functions as F

from helpers import PANEL, day, rows_of, uniform_panel
from tallycast.operators import panel as P

REC = "date date, grp bigint, sub boolean"
ROWS = [
    (day("2024-12-29"), 1, True), (day("2024-12-29"), 1, None), (day("2024-12-29"), 3, False),
    (day("2024-12-30"), 0, True),
    (day("2025-01-01"), 3, True), (day("2025-01-02"), 1, False),
]


def recs(spark, rows=ROWS):
    return spark.createDataFrame(rows, REC)


def test_single_series_missing_day_is_null(spark):
    got = rows_of(P.single_series(recs(spark)), "date", "n")
    assert [n for _, n in got] == [3, 1, None, 1, 1]


def test_zero_on_days_seen_through_filtered_groups(spark):
    got = {(d.isoformat(), g): (n, s) for d, g, n, s in rows_of(P.daily_panel(recs(spark), [1, 3, 5]), "date", "grp", "n", "n_sub")}
    assert len(got) == 15
    assert got["2024-12-29", 1] == (2, 1)
    assert got["2024-12-30", 1] == (0, 0)  # only group 0 has a record that day
    assert got["2024-12-31", 1] == (None, None)
    assert all(got[d, 5] == ((None, None) if d == "2024-12-31" else (0, 0)) for d, g in got if g == 5)


def test_calendar_comes_from_all_records(spark):
    rows = [(day("2024-01-01"), None, True), (day("2024-01-03"), 1, True), (day("2024-01-05"), 9, True)]
    got = rows_of(P.daily_panel(recs(spark, rows), [1]), "date", "n")
    assert [(d.day, n) for d, n in got] == [(1, 0), (2, None), (3, 1), (4, None), (5, 0)]


def test_all_groups(spark):
    got = P.daily_panel(recs(spark))
    assert got.count() == 3 * 5
    assert got.agg(F.sum("n")).first()[0] == 6


def test_hot_group_is_counted_whole(spark):
    hot = spark.range(30000).select(F.lit(day("2024-01-01")).alias("date"), F.lit(1).cast("bigint").alias("grp"), (F.col("id") % 3 == 0).alias("sub"))
    rest = spark.createDataFrame([(day("2024-01-04"), 2, False)], REC)
    got = {(r.date.day, r.grp): r.n for r in P.daily_panel(hot.unionByName(rest)).collect()}
    assert got[1, 1] == 30000 and got[4, 2] == 1 and got[4, 1] == 0 and got[2, 1] is None


def test_empty_raises(spark):
    with pytest.raises(ValueError):
        P.require_rows(recs(spark, []))


@pytest.mark.parametrize(("rows", "column"), [
    ([(day("2024-01-01"), 1, 5, 1), (day("2024-01-01"), 1, 5, 1)], "duplicate_keys"),
    ([(day("2024-01-01"), 1, 5, 1), (day("2024-01-03"), 1, 5, 1)], "groups_with_gaps"),
    ([(day("2024-01-01"), 1, 5, None)], "misaligned_subset"),
    ([(day("2024-01-01"), 1, 5, 6)], "subset_exceeds_total"),
])
def test_contract(spark, rows, column):
    bad = spark.createDataFrame(rows, PANEL)
    assert P.contract_violations(bad).first()[column] > 0
    with pytest.raises(ValueError, match=column):
        P.check_panel(bad)


def test_good_panel_passes(spark):
    P.check_panel(uniform_panel(spark, end="2023-02-28"))


def test_shares_sum_to_one_on_complete_days(spark):
    p = uniform_panel(spark, end="2023-04-30", groups=(1, 2, 3), missing=("2023-03-10",))
    s = P.group_shares(p, 28, 20)
    sums = [r.s for r in s.groupBy("cutoff").agg(F.sum("share").alias("s")).collect()]
    assert all(x is None or abs(x - 1) < 1e-12 for x in sums) and any(x is not None for x in sums)
    assert s.where("cutoff < '2023-01-20' and share is not null").count() == 0


def test_total_is_null_when_a_group_is(spark):
    p = spark.createDataFrame([(day("2024-01-01"), 1, 5, 1), (day("2024-01-01"), 2, None, None), (day("2024-01-02"), 1, 5, 1), (day("2024-01-02"), 2, 2, 0)], PANEL)
    assert rows_of(P.total_series(p), "date", "n") == [(day("2024-01-01"), None), (day("2024-01-02"), 7)]


def test_rows_of_a_task_do_not_grow_with_groups(spark, monkeypatch):
    """The exchange has few rows a series, the dense panel one a day: tasks are dealt by the latter."""
    monkeypatch.setattr(P, "TASK_ROWS", 500)
    days = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 2 * 99).cast("int"))
    for groups in (20, 200):
        recs = spark.range(2 * groups).select(days.alias("date"), F.floor(F.col("id") / 2).alias("grp"), F.lit(True).alias("sub"))
        sizes = P.daily_panel(recs).rdd.glom().map(len).collect()
        assert sum(sizes) == 100 * groups and max(sizes) <= 3 * P.TASK_ROWS
