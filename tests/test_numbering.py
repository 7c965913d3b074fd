"""Numbering over ranges, with a skewed prefix and equal rows."""

import pytest
from pyspark.sql import functions as F

from citeweave.operators.numbering import number_rows


@pytest.mark.parametrize("n", [0, 1, 997])
def test_numbers_are_places(spark, n):
    # Nine of ten names begin alike.
    name = F.when(F.col("id") % 10 > 0, F.concat(F.lit("aa"), F.col("id") * 31 % 97)).otherwise(
        F.concat(F.lit("z"), "id")
    )
    frame = spark.range(n).repartition(5).select("id", name.alias("name"))
    order = [F.desc("name"), F.asc("id")]
    got = [(r["number"], r["name"], r["id"]) for r in number_rows(frame, order).collect()]
    names = sorted((r["id"], r["name"]) for r in frame.collect())
    want = sorted(names, key=lambda r: r[1], reverse=True)
    assert sorted(got) == [(i + 1, name, key) for i, (key, name) in enumerate(want)]


def test_no_task_numbers_all_rows(spark):
    frame = number_rows(spark.range(100), [F.asc("id")])
    text = frame._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in text.splitlines() if "Window [" in line]
    assert len(windows) == 1 and "_n" in windows[0]
