"""Rate texts, tolerance, NTSC families and text form."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from reelmetrics.functions import rates

CASES = {
    "30000/1001": (30000, 1001),
    "24000/1001": (24000, 1001),
    "60000/1001": (60000, 1001),
    "30/1": (30, 1),
    "25/1": (25, 1),
    "60/1": (60, 1),
    "60/2": (30, 1),
    " 50/2 ": (25, 1),
    "29.97": (2997, 100),
    "23.976": (2997, 125),
    "59.94": (2997, 50),
    "1e1": (10, 1),
    "2147483646/4": (1073741823, 2),
    None: None,
    "": None,
    "   ": None,
    "0/0": None,
    "nope": None,
    "30/0": None,
    "0/1": None,
    "-30/1": None,
    "-5.0": None,
    "1/2/3": None,
    "30d": None,
    "NaN": None,
    "99999999999/1": None,
}


def test_rate_texts(spark):
    df = spark.createDataFrame([(t,) for t in CASES], "t STRING").select("t", rates.rate(F.col("t")).alias("r"))
    got = {r["t"]: None if r["r"] is None else (r["r"]["num"], r["r"]["den"]) for r in rows(df)}
    assert got == CASES


@pytest.mark.parametrize(
    "text,family,thirty",
    [
        ("30000/1001", True, True), ("29.97", True, True), ("24000/1001", True, False), ("60000/1001", True, False),
        ("30/1", False, False), ("60/1", False, False), ("25/1", False, False), ("50/1", False, False), ("24/1", False, False),
        ("nope", False, False),
    ],
)
def test_families(spark, text, family, thirty):
    df = spark.createDataFrame([(text, text)], "r_frame_rate STRING, avg_frame_rate STRING")
    (row,) = rows(rates.add_rates(df))
    assert (row["is_ntsc"], row["is_ntsc30"]) == (family, thirty)


@pytest.mark.parametrize(
    "nominal,average,constant,text",
    [
        ("30000/1001", "30000/1001", True, "30000/1001"),
        ("60/1", "30/1", False, "60"),
        ("105/1", "100/1", False, "105"),
        ("104/1", "100/1", True, "104"),
        ("nope", "30/1", True, "30"),
        ("30/1", "0/0", True, "30"),
        ("0/0", "0/0", True, None),
    ],
)
def test_constant_and_text(spark, nominal, average, constant, text):
    df = spark.createDataFrame([(nominal, average)], "r_frame_rate STRING, avg_frame_rate STRING")
    (row,) = rows(rates.add_rates(df))
    assert (row["is_cfr"], row["rate_text"]) == (constant, text)
