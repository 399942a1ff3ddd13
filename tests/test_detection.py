"""Cadence, classes, parity, totals and restoration plans."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from reelmetrics.functions import decide
from reelmetrics.operators import cadence, detection
from reelmetrics.plans.registry import QUERIES
from reelmetrics.settings import Settings

P, T, B, U = "progressive", "tff", "bff", "undetermined"


def frames(spark, videos, gaps=()):
    data = [(v, i * (3 if v in gaps else 1), f) for v, flags in videos.items() for i, f in enumerate(flags)]
    return spark.createDataFrame(data, "video_id BIGINT, frame_idx BIGINT, flag STRING")


def by_hand(flags):
    """The definition, window by window."""
    is_i = [f in (T, B) for f in flags]
    hits = [
        sum(f == P for f in flags[s : s + 5]) == 3 and sum(is_i[s : s + 5]) == 2 for s in range(len(flags) - 4)
    ]
    centred = [hits[i - 2] for i in range(2, len(flags) - 2) if is_i[i]]
    share = lambda x: sum(x) / len(x) if x else 0.0
    return share(hits), share(centred)


VIDEOS = {
    0: [P, P, P, T, T] * 100,
    1: [P] * 500,
    2: [T] * 500,
    3: [P] * 100 + [T] * 400,
    4: [P, P, T],
    5: [P, P, T, T],
    6: [P, P, P, T, T],
    7: [U] * 9,
    8: [P, U, P, T, T, P, P, B, U, T] * 7,
}


@pytest.mark.parametrize("width", [1, 2, 3, 4, 7, 64, 1 << 20])
def test_cadence_equals_definition_for_every_slice_width(spark, width):
    rng = random.Random(width)
    videos = dict(VIDEOS)
    videos[9] = [rng.choice([P, P, P, T, B, U]) for _ in range(300)]
    videos[10] = [rng.choice([P, P, P, T, T]) for _ in range(301)]
    got = rows(cadence.frame_metrics(frames(spark, videos, gaps=(9,)), Settings(frame_slice=width)), "video_id")
    assert [r["video_id"] for r in got] == sorted(videos)
    for r in got:
        rate, ratio = by_hand(videos[r["video_id"]])
        assert r["cadence_rate"] == pytest.approx(rate)
        assert r["i_in_cadence"] == pytest.approx(ratio)
        assert r["total"] == len(videos[r["video_id"]])
        assert r["tff"] == videos[r["video_id"]].count(T)
        assert r["undetermined"] == videos[r["video_id"]].count(U)


def test_counts_and_shares(spark):
    got = {r["video_id"]: r for r in rows(cadence.frame_counts(frames(spark, VIDEOS)))}
    assert got[7]["progressive_fraction"] == 1.0 and got[7]["undetermined_high"]
    assert got[0]["progressive_fraction"] == 0.6 and not got[0]["undetermined_high"]


CLASSES = [
    # interlaced, classified, fraction, cadence, in cadence, mismatch, class, lowest and highest confidence
    (0, 24000, 1.0, 0.0, 0.0, False, "progressive", 0.99, 0.99),
    (5000, 5100, 0.02, 0.0, 0.0, False, "interlaced", 0.94, 0.9401),
    (5000, 5100, 0.02, 0.0, 0.0, True, "interlaced", 0.84, 0.8401),
    (2000, 5000, 0.60, 0.95, 0.95, False, "telecined", 0.99, 0.99),
    (200, 1333, 0.85, 0.50, 0.80, False, "mixed_progressive_telecine", 0.84, 0.8401),
    (1000, 2000, 0.50, 0.10, 0.05, False, "mixed_progressive_interlaced", 0.7749, 0.7751),
    (5, 23690, 23685 / 23690, 0.0, 0.0, False, "progressive", 0.95, 0.95),
    (7, 660, 653 / 660, 0.0, 0.0, False, "progressive", 0.95, 0.95),
    (5, 23690, 23685 / 23690, 0.0, 0.80, False, "mixed_progressive_telecine", 0.83, 0.85),
    (5, 23690, 23685 / 23690, 0.20, 0.0, False, "mixed_progressive_telecine", 0.69, 0.70),
    (50, 24000, 23950 / 24000, 0.02, 0.10, False, "mixed_progressive_telecine", 0.69, 0.70),
    (500, 24000, 23500 / 24000, 0.02, 0.05, False, "mixed_progressive_interlaced", 0.77, 0.78),
    (100, 600, 500 / 600, 0.05, 0.10, False, "mixed_progressive_interlaced", 0.74, 0.76),
    # half-even noise cap: 0.001 * 8500 rounds to 8, 0.001 * 9500 to 10
    (9, 8500, 0.999, 0.0, 0.0, False, "mixed_progressive_telecine", 0.69, 0.70),
    (10, 9500, 0.999, 0.0, 0.0, False, "progressive", 0.95, 0.95),
]


def test_classes(spark):
    data = [(n, *c[:6]) for n, c in enumerate(CLASSES)]
    df = spark.createDataFrame(data, "n INT, i BIGINT, c BIGINT, f DOUBLE, k DOUBLE, r DOUBLE, m BOOLEAN")
    verdict = decide.classify(*[F.col(c) for c in "icfkrm"])
    for row, case in zip(rows(df.select("n", verdict.alias("v")).select("n", "v.*"), "n"), CLASSES):
        assert row["content_type"] == case[6], case
        assert case[7] - 1e-9 <= row["confidence"] <= case[8] + 1e-9, (case, row)
        assert row["reason"] and row["branch"].startswith("7.2.2.")


PARITY = [
    (9500, 500, True, "auto", "tff", False), (500, 9500, True, "auto", "bff", False), (0, 0, True, "auto", "tff", True),
    (0, 0, False, "auto", "auto", False), (0, 0, True, "bff", "bff", False), (600, 400, False, "bff", "bff", False),
    (600, 400, False, "auto", "auto", False), (600, 400, True, "auto", "tff", True), (900, 100, False, "bff", "tff", False),
]


def test_parity(spark):
    df = spark.createDataFrame([(n, *p[:4]) for n, p in enumerate(PARITY)], "n INT, t BIGINT, b BIGINT, s BOOLEAN, p STRING")
    got = rows(df.select("n", decide.parity(*[F.col(c) for c in "tbsp"]).alias("v")).select("n", "v.*"), "n")
    assert [(r["parity"], r["from_ntsc"]) for r in got] == [p[4:] for p in PARITY]


def test_reconcile(spark):
    counts = spark.createDataFrame(
        [(0, 1000, 50, 0, 5), (1, 1001, 50, 0, 4), (2, 500, 50, 0, 5), (3, 1000, 50, 0, 5), (4, 1, 1, 1, 1)],
        "video_id INT, progressive INT, tff INT, bff INT, undetermined INT",
    )
    totals = spark.createDataFrame(
        [(0, 1000, 50, 0, 5), (1, 1000, 50, 0, 5), (2, 1000, 50, 0, 5), (3, None, None, None, None)],
        "video_id INT, progressive INT, tff INT, bff INT, undetermined INT",
    )
    got = rows(detection.reconcile(counts, totals), "video_id")
    assert [r["totals_agree"] for r in got] == [True, True, False, True, True]


RESTORE = [
    # class, rate, constant, fraction, mode
    ("progressive", "30000/1001", True, 0.5, "none"), ("interlaced", "30000/1001", True, 0.5, "deinterlace"),
    ("interlaced", "25", True, 0.5, "deinterlace"), ("telecined", "30000/1001", True, 0.5, "ivtc"),
    ("telecined", "30", True, 0.5, "none"), ("telecined", "30000/1001", False, 0.5, "none"), ("telecined", "25", True, 0.5, "none"),
    ("mixed_progressive_telecine", "30000/1001", True, 0.5, "ivtc"), ("mixed_progressive_telecine", "24", True, 0.5, "none"),
    ("mixed_progressive_interlaced", "30000/1001", True, 0.95, "ivtc"), ("mixed_progressive_interlaced", "30000/1001", True, 0.5, "deinterlace"),
    ("mixed_progressive_interlaced", "30", True, 0.95, "none"), ("mixed_progressive_interlaced", "30", True, 0.5, "deinterlace"),
    ("mixed_progressive_interlaced", "30000/1001", True, 0.9, "ivtc"), ("telecined", None, True, 0.5, "none"), ("other", "30", True, 0.5, "none"),
]


def test_restore_plans(spark):
    data = [(n, t, r == "30000/1001", c, r, f) for n, (t, r, c, f, _) in enumerate(RESTORE)]
    df = spark.createDataFrame(data, "n INT, t STRING, s BOOLEAN, c BOOLEAN, r STRING, f DOUBLE")
    plan = decide.restore_plan(
        F.col("t"), F.col("f"), F.lit(0.9), F.lit(0.9), F.col("s"), F.col("c"), F.col("r"), F.lit("tff")
    )
    for row, case in zip(rows(df.select("n", plan.alias("p")).select("n", "p.*"), "n"), RESTORE):
        assert row["mode"] == case[4], case
        expected = (24000, 1001) if case[4] == "ivtc" else (None, None)
        assert (row["out_num"], row["out_den"]) == expected
        graph = {
            "none": "",
            "ivtc": "fieldmatch=order=tff:combmatch=full,bwdif=mode=send_frame:parity=tff:deint=interlaced,decimate",
            "deinterlace": "bwdif=mode=send_frame:parity=tff",
        }[case[4]]
        assert row["filter_graph"] == graph
        if case[0] == "telecined" and not case[2]:
            assert "variable frame rate" in row["notes"]


GOLDEN = {
    0: (1000, 0, 0, 0.0, 0.0, "7.2.2.1"), 1: (997, 3, 3, 0.0, 0.0, "7.2.2.1"), 2: (600, 400, 400, 1.0, 1.0, "7.2.2.2"),
    3: (0, 1000, 1000, 0.0, 0.0, "7.2.2.3"), 4: (800, 200, 200, 0.4940, 1.0, "7.2.2.4"), 5: (750, 250, 250, 0.0090, 0.0, "7.2.2.5"),
    6: (950, 50, 0, 0.0090, 0.0, "7.2.2.5"), 7: (0, 1000, 600, 0.0, 0.0, "7.2.2.3"), 8: (996, 4, 4, 0.0040, 0.5, "7.2.2.4"),
    9: (582, 198, 198, 0.1054, 0.1970, "7.2.2.5"),
}


def test_golden_classification(spark):
    for r in rows(QUERIES["classify"](spark, "/root/testdata/sf0.01")):
        want = GOLDEN[r["video_id"]]
        assert (r["progressive"], r["interlaced"], r["tff"]) == want[:3]
        assert r["cadence_rate"] == pytest.approx(want[3], abs=6e-5)
        assert r["i_in_cadence"] == pytest.approx(want[4], abs=6e-5)
        assert r["branch"] == want[5]
