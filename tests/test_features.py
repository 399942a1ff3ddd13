"""Tiers, formats, HDR, parity words, keys and time codes."""

from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from reelmetrics.functions import probe, text
from reelmetrics.operators.search import expected_probes
from reelmetrics.settings import Settings

TIERS = [
    (3840, 2160, "UHD"), (3840, 1080, "UHD"), (1920, 2160, "UHD"), (7680, 4320, "UHD"),
    (1920, 1080, "1080p"), (1920, 720, "1080p"), (1280, 1080, "1080p"), (3839, 2159, "1080p"),
    (1280, 720, "720p"), (1280, 480, "720p"), (720, 720, "720p"), (1919, 1079, "720p"),
    (720, 480, "SD"), (720, 576, "SD"), (1279, 719, "SD"), (1, 1, "SD"), (None, None, "SD"), (0, 0, "SD"),
]
BOUNDS = {"UHD": (25, 55, 40), "1080p": (28, 58, 43), "720p": (32, 62, 47), "SD": (38, 63, 51)}


def test_tiers_bounds_and_first_probe(spark):
    df = spark.createDataFrame([(i, w, h) for i, (w, h, _) in enumerate(TIERS)], "i INT, width INT, height INT")
    tier = probe.search_tier(F.col("width"), F.col("height"))
    df = df.select("i", tier.alias("t")).select("i", "t.*").withColumns(
        {
            "first": F.floor((F.col("min_cq") + F.col("max_cq") + 1) / 2),
            "most": expected_probes(F.col("min_cq"), F.col("max_cq")),
        }
    )
    for row, (_, _, name) in zip(rows(df, "i"), TIERS):
        assert row["tier"] == name
        assert (row["min_cq"], row["max_cq"], row["first"]) == BOUNDS[name]
        assert row["most"] <= 5


def test_custom_tier_bounds(spark):
    tier = probe.search_tier(F.lit(1920), F.lit(1080), Settings(fhd_range=(30, 40)))
    (row,) = rows(spark.range(1).select(tier.alias("t")).select("t.*"))
    assert (row["min_cq"], row["max_cq"]) == (30, 40)


@pytest.mark.parametrize(
    "low,high,problem",
    [(0, 63, None), (25, 25, None), (-1, 20, "min_cq outside 0..63"), (1, 64, "max_cq outside 0..63"), (30, 20, "min_cq above max_cq")],
)
def test_range_problems(spark, low, high, problem):
    (row,) = rows(spark.range(1).select(probe.range_problem(F.lit(low), F.lit(high)).alias("p")))
    assert row["p"] == problem


@pytest.mark.parametrize(
    "pix,depth,encode,compare",
    [
        ("yuv420p", 8, "nv12", "yuv420p"), ("yuv420p10le", 10, "p010le", "yuv420p10le"),
        ("yuv420p12le", 12, "p010le", "yuv420p10le"), (None, 8, "nv12", "yuv420p"), ("", 8, "nv12", "yuv420p"),
    ],
)
def test_formats(spark, pix, depth, encode, compare):
    df = spark.createDataFrame([(pix,)], "p STRING").select(probe.bit_depth(F.col("p")).alias("d"))
    (row,) = rows(df.select("d", probe.encode_format(F.col("d")).alias("e"), probe.compare_format(F.col("d")).alias("c")))
    assert (row["d"], row["e"], row["c"]) == (depth, encode, compare)


def test_hdr_and_parity_words(spark):
    words = [("SMPTE2084", True), ("arib-std-b67", True), ("bt709", False), (None, False)]
    df = spark.createDataFrame(words, "t STRING, hdr BOOLEAN").withColumn("got", probe.is_hdr(F.col("t")))
    assert all(r["got"] == r["hdr"] for r in rows(df))
    orders = [
        ("tt", "tff"), (" TFF ", "tff"), ("bb", "bff"), ("bff", "bff"), ("tb", "auto"), ("bt", "auto"),
        ("progressive", "auto"), ("unknown", "auto"), ("", "auto"), (None, "auto"),
    ]
    df = spark.createDataFrame(orders, "t STRING, want STRING").withColumn("got", probe.probe_parity(F.col("t")))
    assert all(r["got"] == r["want"] for r in rows(df))


@pytest.mark.parametrize(
    "cll,mastering,peak,origin",
    [(800, 4000, 800, "max_cll"), (0, 4000, 4000, "max_cll"), (None, 600, 600, "mastering_display"), (None, None, 1000, "default"), (0, None, 1000, "max_cll")],
)
def test_nominal_peak(spark, cll, mastering, peak, origin):
    df = spark.createDataFrame([(cll, mastering)], "c INT, m INT")
    (row,) = rows(df.select(probe.nominal_peak(F.col("c"), F.col("m")).alias("p"), probe.peak_origin(F.col("c"), F.col("m")).alias("o")))
    assert (row["p"], row["o"]) == (peak, origin)


def test_keys(spark):
    paths = [
        ("/a/My Film (2001).mkv", "My_Film__2001_"), ("/a/b/été-1_x.y.mkv", "été-1_x.y"), ("plain", "plain"), ("/a/x:y?.mp4", "x_y_"),
    ]
    df = spark.createDataFrame(paths, "p STRING, want STRING").withColumn("got", text.safe_id(text.file_stem(F.col("p"))))
    assert [(r["got"], r["want"]) for r in rows(df) if r["got"] != r["want"]] == []


@pytest.mark.parametrize(
    "code,seconds,normal",
    [
        ("00:00:00.000000000", "0", "00:00:00"), ("00:01:30.500000000", "90.5", "00:01:30.5"), ("01:02:03", "3723", "01:02:03"),
        ("00:10:00", "600", "00:10:00"), ("1.02:00:00.123456789", "93600.123456789", "1.02:00:00.123456789"), ("02:05", "7500", "02:05"),
        ("24:00:00", None, "24:00:00"), ("00:60:00", None, "00:60:00"), ("soon", None, "soon"), ("", None, ""), (None, None, ""),
    ],
)
def test_timecodes(spark, code, seconds, normal):
    df = spark.createDataFrame([(code,)], "t STRING")
    (row,) = rows(df.select(text.timecode_seconds(F.col("t")).alias("s"), text.normalize_timecode(F.col("t")).alias("n")))
    assert row["s"] == (None if seconds is None else Decimal(seconds).quantize(Decimal("1e-9")))
    assert row["n"] == normal


def test_episode_name(spark):
    (row,) = rows(spark.range(1).select(text.episode_name(F.lit("A Show"), F.lit(1), F.lit(12)).alias("n")))
    assert row["n"] == "A Show - S01E12.mkv"
