"""Joins that survive a hot key."""

import pytest

from tallycast.llm.common import join_on_hot_key, staged


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(6000).selectExpr("id", "if(id < 2000, 0, id) as key", "id % 7 as other")


def joined(rows, key, n, how):
    keyed = staged(rows.groupBy(key).count().withColumnRenamed("count", "n").where("key < 5000"), "test-keys")
    return join_on_hot_key(rows, keyed, key, "n", n, how)


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("key", ["key", ["key", "other"]])
def test_same_rows_with_and_without_hot_keys(rows, key, how):
    hot, cold = joined(rows, key, 6000, how), joined(rows, key, 6_000_000_000, how)
    assert hot.columns == cold.columns
    assert sorted(map(tuple, hot.collect()), key=str) == sorted(map(tuple, cold.collect()), key=str)
    assert cold.count() == (6000 if how == "left" else 5000)


def test_nothing_is_broadcast_or_read_twice_without_hot_keys(rows):
    """The driver builds no tables for keys that are not there."""
    plan = joined(rows, "key", 6_000_000_000, "inner")._jdf.queryExecution().optimizedPlan()
    assert "broadcast" not in plan.toString() and plan.collectLeaves().size() == 2
