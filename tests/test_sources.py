import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from helpers import rows_of
from tallycast.operators import lag_audit as L
from tallycast.operators import profile as R
from tallycast.sources import jsonlogs as J
from tallycast.sources import manifest as M
from tallycast.sources import records as RC
from tallycast.sources import sinks

SCHEMA = RC.event_schema(["id", "grp"], ["created", "label"], ["x"], ["id", "created", "label", "grp", "x"])


@pytest.fixture
def exports(tmp_path):
    (tmp_path / "a.csv").write_text("id,created,label,grp,x\n1,2024-12-29T08:15:00,,1,\n2,2024-12-29,A,3,1.5\n")
    (tmp_path / "b.csv").write_text("id,created,label,grp,x\n1,2025-01-01T00:00:00,B,,2.0\n")
    return tmp_path


def test_typed_scan(spark, exports):
    df = RC.require_times(RC.read_events(spark, str(exports), SCHEMA), "created")
    got = rows_of(df, "source_file", "id", "has_time", "date", "year")
    assert got == [("a.csv", 1, True, dt.date(2024, 12, 29), 2024), ("a.csv", 2, False, dt.date(2024, 12, 29), 2024), ("b.csv", 1, True, dt.date(2025, 1, 1), 2025)]
    assert df.where("label is null").count() == 1 and df.where("x is null").count() == 1 and df.where("grp is null").count() == 1
    assert dict(df.dtypes)["created"] == "timestamp_ntz"


def test_bad_times(spark):
    df = spark.createDataFrame([("2024-01-01",), ("01/02/2024",), (None,), ("2024-02-30T00:00:00",)], "created string")
    assert RC.bad_times(df, "created").first().asDict() == {"rows": 4, "invalid": 3, "date_only": 1}
    with pytest.raises(Exception, match="unparseable time"):
        RC.require_times(df, "created").collect()


def test_bad_number_fails(spark, tmp_path):
    (tmp_path / "c.csv").write_text("id,created,label,grp,x\nx1,2024-12-29,A,3,1.5\n")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        RC.read_events(spark, str(tmp_path), SCHEMA).collect()


def test_append(spark):
    a = spark.createDataFrame([(1, "x")], "k int, a string")
    b = spark.createDataFrame([(2, 1.0)], "k int, b double")
    assert RC.append_exports([a, b], relaxed=True).columns == ["k", "a", "b"]
    with pytest.raises(Exception):
        RC.append_exports([a, b]).collect()


def test_harmonise(spark):
    df = spark.createDataFrame([("Long label",), ("",), (None,), ("other",)], "t string")
    assert sorted(r.t for r in RC.harmonise(df, "t", {"Long label": "L"}).collect()) == ["(blank)", "(blank)", "L", "other"]


def test_fingerprints_and_diff(spark, exports):
    import hashlib

    f = M.fingerprint(spark, str(exports), "*.csv")
    want = {p.name: (hashlib.sha256(p.read_bytes()).hexdigest(), p.stat().st_size) for p in exports.glob("*.csv")}
    assert {r.path: (r.sha256, r.bytes) for r in f.collect()} == want
    expected = spark.createDataFrame([("a.csv", want["a.csv"][0], want["a.csv"][1]), ("b.csv", "0" * 64, want["b.csv"][1]), ("z.csv", "0" * 64, 5)], "path string, sha256 string, bytes bigint")
    assert rows_of(M.diff(expected, f), "path", "problem") == [("b.csv", "content changed"), ("z.csv", "missing")]
    sized = expected.withColumn("bytes", F.col("bytes") + 1)
    assert rows_of(M.diff(sized, f), "path", "problem")[0] == ("a.csv", "size changed")


def test_stage_round_trip(spark):
    df = spark.range(100).withColumn("y", (F.col("id") % 3).cast("int"))
    back = sinks.stage(df, "t", ["y"])
    assert back.exceptAll(df).isEmpty() and back.count() == 100
    assert "PartitionFilters: [isnotnull(y" in back.where("y = 1")._jdf.queryExecution().executedPlan().toString()


def test_activity_log(spark):
    def entry(rid, when, size):
        return {"data": {"package": {"resources": [{"id": rid, "last_modified": when, "size": size}, {"id": "other", "last_modified": when, "size": 1}]}}}

    docs = [json.dumps({"result": [entry("r", "t1", 5), entry("r", "t1", 9), entry("r", None, 3), {"data": {}}]}), json.dumps({"result": [entry("r", "t2", 7)]})]
    got = J.upload_history(spark.createDataFrame([(d,) for d in docs], "value string"), "r")
    assert rows_of(got, "last_modified", "size") == [("t1", 9), ("t2", 7)]


def test_package_prefix(spark):
    doc = json.dumps({"id": "p", "resources": [{"name": "Notes"}, {"name": "Concordance B"}, {"name": "Concordance A"}]})
    r = J.package_resources(spark.createDataFrame([(doc,)], "value string"))
    assert rows_of(J.first_with_prefix(r, "Concordance"), "id", "pos", "name") == [("p", 1, "Concordance B")]


def test_report_guard(spark):
    def doc(label, n2):
        return json.dumps({"label": label, "period": {"start": "a", "end": "b"}, "wape": {"f": 0.1, "m": 0.2}, "overall": [
            {"model": "f", "n": 5, "mae": 1.0, "bias": 0.0}, {"model": "m", "n": n2, "mae": 2.0, "bias": 0.0}]})

    rows = J.report_rows(spark.createDataFrame([(doc("x", 5),), (doc("y", 6),)], "value string"))
    got = J.setting_comparison(rows, "f", ["m"])
    assert rows_of(got, "label", "model", "role", "final_minus", "consistent") == [
        ("x", "f", "final", 0.0, True), ("x", "m", "best_single", -1.0, True), ("y", "f", "final", 0.0, False), ("y", "m", "best_single", -1.0, False)]


def test_bytes_per_day(spark, tmp_path):
    text = "1,2024-01-01T10:00:00,é\n2,2024-01-02,b\n3,2024-01-01,c\n"
    (tmp_path / "x.txt").write_text(text, encoding="utf-8")
    got = L.bytes_per_day(spark.read.text(str(tmp_path)))
    assert sum(b for _, b in rows_of(got, "date", "bytes")) == len(text.encode()) and got.count() == 2


def test_vocabulary_churn(spark):
    rows = [(2020, "a"), (2020, "b"), (2021, "b"), (2021, "c"), (2021, "c"), (2023, "c"), (2023, None)]
    got = R.vocabulary_churn(spark.createDataFrame(rows, "y int, w string"), F.col("y"), "w")
    assert rows_of(got, "period", "types", "new", "dropped") == [(2021, 2, 1, 1), (2022, 0, 0, 2), (2023, 1, 1, 0)]


def test_column_profile_sketch_agrees(spark):
    df = spark.range(1000).select((F.col("id") % 50).alias("a"), F.when(F.col("id") % 4 > 0, F.lit("v")).alias("b"))
    exact = {r.variable: (r.rows, r.nulls, r.distinct, r.min, r.max) for r in R.column_profile(df, ["a", "b"]).collect()}
    assert exact == {"a": (1000, 0, 50, 0.0, 49.0), "b": (1000, 250, 1, None, None)}
    sketch = {r.variable: r.distinct for r in R.column_profile(df, ["a", "b"], approx=True).collect()}
    assert abs(sketch["a"] - 50) <= 3 and sketch["b"] == 1


def test_names_are_relative_to_the_folder_given(spark, tmp_path):
    root = tmp_path / "data"
    for folder in ("a/data", "b/data", "c d"):
        (root / folder).mkdir(parents=True)
        (root / folder / "f.txt").write_text(folder)
    want = [(f"{folder}/f.txt", hashlib.sha256(folder.encode()).hexdigest(), len(folder)) for folder in ("a/data", "b/data", "c d")]
    for given in (str(root), f"{root}/", f"file://{root}"):
        assert rows_of(M.fingerprint(spark, given), "path", "sha256", "bytes") == want
    assert rows_of(M.fingerprint(spark, str(root / "c d" / "f.txt")), "path", "bytes") == [("f.txt", 3)]
    with pytest.raises(Exception, match="(?i)not exist|no such"):
        M.fingerprint(spark, str(tmp_path / "nope"))


def test_file_beyond_two_gigabytes(spark, tmp_path):
    size = 2**31 + 5
    with open(tmp_path / "big.bin", "wb") as f:
        f.truncate(size)  # takes no space on disk
    h = hashlib.sha256()
    for a in range(0, size, 1 << 24):
        h.update(bytes(min(1 << 24, size - a)))
    assert rows_of(M.fingerprint(spark, str(tmp_path)), "path", "sha256", "bytes") == [("big.bin", h.hexdigest(), size)]
