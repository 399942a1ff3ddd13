"""The sliced scan equals plain windows for any slice width."""

import random

import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from reelmetrics.operators.ordered import ordered_scan


@pytest.mark.parametrize("width", [1, 3, 10, 1000])
def test_scan_equals_window(spark, width):
    rng = random.Random(3)
    data = [(k, o, rng.randint(-5, 9)) for k in (1, 2) for o in rng.sample(range(-50, 400), 120)] + [(3, 7, 1)]
    df = spark.createDataFrame(data, "k INT, o BIGINT, v BIGINT")
    w = Window.partitionBy("k").orderBy("o")
    plain = df.select(
        "*",
        F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("total"),
        F.lag("v").over(w).alias("before"),
        F.lead("v").over(w).alias("after"),
        F.lead("o").over(w).alias("after_o"),
    )
    sliced = ordered_scan(
        df, ["k"], "o", width, totals={"total": F.col("v")}, previous={"before": "v"}, following={"after": "v", "after_o": "o"}
    )
    assert sliced.columns == plain.columns
    assert rows(sliced, "k", "o") == rows(plain, "k", "o")


def test_null_keys_are_a_key_of_their_own(spark):
    rows_ = [(None, 1, 5), (None, 2, 7), ("a", 1, 1), (None, 900, 9), ("a", 3, 2)]
    got = ordered_scan(
        spark.createDataFrame(rows_, "k STRING, at BIGINT, v BIGINT"), ["k"], "at", 10,
        totals={"sum": F.col("v")}, previous={"before": "v"}, following={"after": "v"},
    )
    found = {(r.k, r.at): (r.sum, r.before, r.after) for r in got.collect()}
    assert found == {(None, 1): (5, None, 7), (None, 2): (12, 5, 9), (None, 900): (21, 7, None), ("a", 1): (1, None, 2), ("a", 3): (3, 1, None)}
