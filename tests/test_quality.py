"""Level statistics, gates, selection, bisection and sample windows."""

import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from reelmetrics.operators import quality, sampling, search
from reelmetrics.settings import Settings


def scores(spark, groups):
    data = [(v, c, i % 4, float(s) if s is not None else None) for (v, c), values in groups.items() for i, s in enumerate(values)]
    return spark.createDataFrame(data, "video_id BIGINT, cq INT, sample_idx INT, score DOUBLE")


def test_level_stats_match_numpy(spark):
    rng = random.Random(5)
    groups = {
        (1, 30): [rng.uniform(80, 100) for _ in range(997)],
        (1, 31): [95.0] * 50,
        (1, 32): [rng.choice([0.0, 97.5, 99.0]) for _ in range(40)],
        (2, 30): [42.125],
        (2, 31): [1.0, 2.0],
        (2, 32): [-3.0, 150.0, 120.5, 99.9, -7.25] * 3,
        (3, 30): [0.0, 0.0],
        # a third of everything in one group, packed into a few cells
        (4, 40): [97.0 + rng.random() / 50 for _ in range(3000)],
    }
    got = {(r["video_id"], r["cq"]): r for r in rows(quality.level_stats(scores(spark, {**groups, (9, 9): [None]})))}
    assert set(got) == {*groups, (9, 9)} and got[9, 9]["n"] == 0
    for key, values in groups.items():
        r, a = got[key], np.array(values)
        positive = a[a > 0]
        assert r["n"] == len(a)
        assert r["mean"] == pytest.approx(a.mean())
        assert r["min"] == a.min()
        assert r["p05"] == pytest.approx(np.percentile(a, 5), abs=1e-9)
        assert r["p01"] == pytest.approx(np.percentile(a, 1), abs=1e-9)
        assert r["harmonic"] == pytest.approx(len(positive) / (1 / positive).sum() if len(positive) else 0.0)


def test_approximate_stats_have_the_same_columns(spark):
    df = scores(spark, {(1, 30): [90.0, 91.0, 92.0]})
    exact, approx = quality.level_stats(df), quality.level_stats_approx(df)
    assert exact.columns == approx.columns
    assert rows(approx)[0]["mean"] == pytest.approx(91.0)


def levels(spark, data):
    return spark.createDataFrame(
        [(v, c, m, m, p5, p1, p1, 100) for v, c, m, p5, p1 in data],
        "video_id BIGINT, cq INT, mean DOUBLE, harmonic DOUBLE, p05 DOUBLE, p01 DOUBLE, min DOUBLE, n BIGINT",
    )


def test_gates_are_inclusive_and_explained(spark):
    df = levels(spark, [(1, 30, 97.0, 95.0, 90.0), (1, 31, 96.0, 95.0, 89.0), (1, 32, 98.0, None, 91.0)])
    got = rows(quality.gates(df), "cq")
    assert [r["passed"] for r in got] == [True, False, False]
    assert [r["failure"] for r in got] == ["all gates met", "mean needs 97.0, has 96.00; p01 needs 90.0, has 89.00", "p05 needs 95.0, has none"]
    assert [r["missed"] for r in got] == [[], ["mean", "p01"], ["p05"]]


def test_selection_fallback_and_marginal(spark):
    data = [
        (1, 30, 99.0, 98.0, 95.0), (1, 31, 97.4, 96.0, 92.0), (1, 32, 96.9, 96.0, 92.0),  # 31, near the mean target
        (2, 30, 99.0, 98.0, 95.0), (2, 40, 98.0, 97.0, 93.0),  # 40, clear
        (3, 30, 90.0, 80.0, 70.0), (3, 29, 90.0, 85.0, 70.0), (3, 31, 89.0, 80.0, 70.0),  # none: best mean, lowest level
        (4, 30, 97.5, 95.5, 90.5),  # exactly half a point away is not marginal
    ]
    df = quality.add_neighbours(levels(spark, data))
    got = {r["video_id"]: r for r in rows(quality.add_marginal(quality.select_level(df)))}
    assert {v: r["cq"] for v, r in got.items()} == {1: 31, 2: 40, 3: 29, 4: 30}
    assert {v: r["is_marginal"] for v, r in got.items()} == {1: True, 2: False, 3: True, 4: False}
    assert {v: r["fell_short"] for v, r in got.items()} == {1: False, 2: False, 3: True, 4: False}
    assert got[1]["above"]["cq"] == 32 and got[1]["above"]["failure"].startswith("mean needs 97.0, has 96.90")
    assert got[1]["below"]["cq"] == 30 and got[2]["above"] is None and got[3]["above"] is None
    assert len(got[1]["marginal_reasons"]) == 1 and len(got[3]["marginal_reasons"]) == 1


def test_outliers_keep_three(spark):
    df = scores(spark, {(1, 30): [90, 80, 70, 60] * 2, (1, 31): [50]})
    got = rows(quality.sample_outliers(df), "cq", "rank")
    assert [(r["cq"], r["sample_idx"], r["rank"]) for r in got] == [(30, 3, 1), (30, 2, 2), (30, 1, 3), (31, 0, 1)]


def walk(low, high, passes):
    """The search, one video at a time."""
    best, probes = None, []
    while low <= high:
        mid = (low + high + 1) // 2
        probes.append(mid)
        if passes(mid):
            best, low = mid, mid + 1
        else:
            high = mid - 1
    return best, probes


def threshold_levels(spark, thresholds, low, high):
    ok = F.col("cq") <= F.col("limit")
    value = lambda good: F.when(ok, good).otherwise(50.0)
    return (
        spark.createDataFrame(list(thresholds.items()), "video_id BIGINT, limit INT")
        .withColumn("cq", F.explode(F.sequence(F.lit(low), F.lit(high))))
        .select("video_id", "cq", value(99.0).alias("mean"), value(98.0).alias("p05"), value(97.0).alias("p01"))
    )


def ranges(spark, videos, low, high):
    return spark.createDataFrame([(v, low, high) for v in videos], "video_id BIGINT, min_cq INT, max_cq INT")


@pytest.mark.parametrize("low,high", [(25, 55), (0, 63), (10, 13), (30, 30)])
def test_bisection_for_every_threshold(spark, low, high):
    thresholds = {t + 100: t for t in range(low - 1, high + 2)} | {900: 1000}
    lv, rg = threshold_levels(spark, thresholds, low, high), ranges(spark, thresholds, low, high)
    most = math.ceil(math.log2(high - low + 2))
    for r in rows(search.bisect(lv, rg)):
        best, probes = walk(low, high, lambda cq, t=thresholds[r["video_id"]]: cq <= t)
        assert r["best_cq"] == best
        assert [s["cq"] for s in r["steps"]] == probes
        assert len(set(probes)) == len(probes) == r["probes"] <= most == r["expected_probes"]


def test_bisection_is_not_the_best_of_all(spark):
    data = [(1, c, 99.0 if c in (30, 39) else 50.0, 98.0, 97.0) for c in range(25, 56)]
    lv, rg = levels(spark, data), ranges(spark, [1], 25, 55)
    assert rows(quality.select_level(lv))[0]["cq"] == 39
    seen = search.probed_levels(lv, rg)
    assert rows(search.bisect(lv, rg))[0]["best_cq"] is None
    assert rows(quality.select_level(seen))[0]["fell_short"]
    assert {r["cq"] for r in rows(seen)} == set(walk(25, 55, lambda c: c in (30, 39))[1])


def test_bad_ranges_and_unmeasured_videos(spark):
    lv = threshold_levels(spark, {1: 30}, 25, 55)
    rg = spark.createDataFrame([(1, 50, 10), (2, 25, 55), (3, -1, 5)], "video_id BIGINT, min_cq INT, max_cq INT")
    got = rows(search.bisect(lv, rg))
    assert [(r["video_id"], r["best_cq"]) for r in got] == [(2, None)]
    assert not any(s["measured"] for s in got[0]["steps"])


def test_search_on_demand_measures_only_what_it_needs(spark):
    thresholds = {v: t for v, t in enumerate([24, 25, 33, 40, 55, 99])}
    limits = spark.createDataFrame(list(thresholds.items()), "video_id BIGINT, limit INT")
    calls = []

    def measure(asked):
        calls.append(asked.count())
        noise = F.explode(F.array(F.lit(0.0), F.lit(0.25)))
        score = F.when(F.col("cq") <= F.col("limit"), 99.0).otherwise(50.0)
        return asked.join(limits, "video_id").select("video_id", "cq", score.alias("s"), noise.alias("d")).select(
            "video_id", "cq", (F.col("s") + F.col("d")).alias("score")
        )

    state, trace = search.search_levels(ranges(spark, thresholds, 25, 55), measure)
    expected = {v: walk(25, 55, lambda c, t=t: c <= t) for v, t in thresholds.items()}
    assert {r["video_id"]: r["best_cq"] for r in rows(state)} == {v: b for v, (b, _) in expected.items()}
    seen = {}
    for r in rows(trace, "video_id", "step"):
        seen.setdefault(r["video_id"], []).append(r["cq"])
    assert seen == {v: p for v, (_, p) in expected.items()}
    assert sum(calls) == sum(len(p) for _, p in expected.values()) and len(calls) <= 5


DURATIONS = {7200: 16, 192: 16, 180: 15, 120: 10, 60: 5, 36: 3, 24: 2, 20: 1, 15: 1, 8: 1, 1: 1}


@pytest.mark.parametrize("uniform", [sampling.modular_uniform, sampling.hashed_uniform])
@pytest.mark.parametrize("seed", [1, 12345, 987654321])
def test_windows_fit_and_never_overlap(spark, uniform, seed):
    data = [(i, float(d)) for i, d in enumerate(DURATIONS)] + [(i, 100 + i * 7.3) for i in range(100, 300)]
    videos = spark.createDataFrame([*data, (98, 0.0), (99, -1.0)], "video_id BIGINT, duration_s DOUBLE")
    got = {}
    for r in rows(sampling.sample_windows(videos, Settings(seed=seed), uniform), "video_id", "sample_idx"):
        got.setdefault(r["video_id"], []).append((r["start_s"], r["length_s"]))
    assert set(got) == {v for v, _ in data}
    for v, duration in data:
        windows = got[v]
        assert len(windows) == DURATIONS.get(duration, min(16, int(duration // 12)))
        assert all(s >= 0 and s + n <= duration + 1e-9 for s, n in windows)
        assert all(b[0] >= a[0] + a[1] - 1e-9 for a, b in zip(windows, windows[1:]))
        if duration < 24:
            assert windows == [(0.0, duration)]
        else:
            stratum = duration / len(windows)
            assert all(n == 12 and i * stratum <= s + 1e-9 < (i + 1) * stratum + 1e-9 for i, (s, n) in enumerate(windows))


def test_seeds_repeat_and_differ(spark):
    videos = spark.createDataFrame([("film-a", 7200.0), ("film-b", 7200.0)], "video_id STRING, duration_s DOUBLE")
    draw = lambda seed: [r["start_s"] for r in rows(sampling.sample_windows(videos, Settings(seed=seed)), "video_id", "sample_idx")]
    assert draw(1) == draw(1) != draw(2)
    assert draw(1)[:16] != draw(1)[16:]


@pytest.mark.parametrize("settings", [Settings(sample_count=0), Settings(window_seconds=0)])
def test_bad_sampling_settings(spark, settings):
    with pytest.raises(ValueError):
        sampling.sample_windows(spark.createDataFrame([(1, 9.0)], "video_id INT, duration_s DOUBLE"), settings)


def test_coverage(spark):
    videos = spark.createDataFrame([(1, 20.0), (2, 384.0)], "video_id INT, duration_s DOUBLE")
    got = rows(sampling.sample_coverage(sampling.sample_windows(videos), videos), "video_id")
    assert [(r["windows"], r["covered_s"], r["covered_pct"]) for r in got] == [(1, 20.0, 100.0), (16, 192.0, 50.0)]


def test_empty_levels_and_scores_that_are_no_numbers(spark):
    data = [("v", 30, None), ("v", 31, float("nan")), ("v", 31, 98.0), ("v", 32, 99.0), ("v", 32, None)]
    scores = spark.createDataFrame(data, "video_id STRING, cq INT, score DOUBLE")
    for stats in (quality.level_stats(scores), quality.level_stats_approx(scores)):
        got = {r["cq"]: r for r in rows(quality.gates(stats))}
        assert tuple(got[30][c] for c in ("mean", "harmonic", "p05", "min", "n")) == (0.0, 0.0, None, 0.0, 0)
        assert (got[31]["mean"], got[31]["p01"], got[31]["n"]) == (None, None, 2)
        assert (got[32]["mean"], got[32]["p01"], got[32]["n"]) == (99.0, 99.0, 1)
        assert [got[c]["passed"] for c in (30, 31, 32)] == [False, False, True]
        assert rows(quality.select_level(stats))[0]["cq"] == 32
    loose = spark.createDataFrame([("v", 31, float("nan"), float("nan"), float("nan"))], "video_id STRING, cq INT, mean DOUBLE, p05 DOUBLE, p01 DOUBLE")
    assert not rows(quality.gates(loose))[0]["passed"]


def test_levels_that_cannot_be_searched_come_out(spark):
    levels = spark.createDataFrame([("v", 64), ("v", None), ("v", 0), ("v", -1)], "video_id STRING, cq INT")
    got = {r["cq"]: r["reason"] for r in rows(search.level_rejects(levels))}
    assert set(got) == {64, None, -1} and got[None] != got[64]


def test_full_precision_scores_in_one_cell(spark):
    rng = random.Random(8)
    groups = {(1, 1): [97.0 + rng.random() / 100 for _ in range(5_000)], (1, 2): [1e6 + rng.random() for _ in range(2_000)], (1, 3): [-5.0, 1e300, 2.0, 3.0]}
    got = {(r["video_id"], r["cq"]): r for r in rows(quality.level_stats(scores(spark, groups)))}
    for key, values in groups.items():
        assert got[key]["p05"] == pytest.approx(np.percentile(values, 5), rel=1e-12)
        assert got[key]["p01"] == pytest.approx(np.percentile(values, 1), rel=1e-12)
