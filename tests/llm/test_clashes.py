"""Columns of the caller named like helper columns, in either case, pass through unharmed."""

import random

import pytest
from pyspark.sql import functions as F

from tallycast.llm import decontamination, neardup, passages, quality

NAMES = ["_place", "_node", "_lost", "_key", "_quality", "_text", "row", "place", "node", "key", "lost", "statistics", "band", "root", "hub", "begin", "end", *quality.STATISTICS]


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(3, 8))) for _ in range(n))


@pytest.mark.parametrize("upper", [False, True])
def test_columns_named_like_helpers(spark, upper):
    rnd = random.Random(5)
    whole = [prose(rnd, 90) for _ in range(6)]
    passage = prose(rnd, 60)
    texts = [*whole, whole[0], f"{whole[1]} more", f"{whole[4]}\n{passage}", f"{whole[5]} {prose(rnd, 70)}\n{passage}", None, ""]
    names = [n.upper() if upper else n for n in NAMES]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = docs.select("*", *[F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")).alias(n) for n in names])
    bench = spark.createDataFrame([(1, " ".join(whole[2].split()[:30]))], "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int")
    model = quality.fit_on(docs, labels, F.lit(False))
    results = {
        "quality": quality.at_least(docs, model, 0.0),
        "near": neardup.without_near_duplicates(docs),
        "passages": passages.deduplicated(docs),
        "benchmark": decontamination.decontaminated(docs, bench),
    }
    left = {"quality": set(range(12)), "near": set(range(12)) - {6, 7, 11}, "benchmark": set(range(12)) - {2}}
    for name, out in results.items():
        assert out.columns == docs.columns
        rows = out.collect()
        if name in left:
            assert {r.doc_id for r in rows} - {10, 11} == left[name] - {10, 11}
        for r in rows:
            assert all(r[n] == f"{n}-{r.doc_id}" for n in names)
            assert name == "passages" or r.text == texts[r.doc_id]
    cut = {r.doc_id: r.text for r in results["passages"].collect()}
    assert sum(passage in (t or "") for t in cut.values()) == 1 and sum(t == whole[0] for t in cut.values()) == 1
    assert quality.scored(docs, model).columns == [*docs.columns, "score"]
