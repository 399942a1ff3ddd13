"""Plans keep the shape that scales, whatever the planner picks for small inputs."""

import re
from collections import Counter

import pytest

from reelmetrics.operators import cadence, chapters, quality, ranges, usage
from reelmetrics.plans.registry import CHECKS, QUERIES
from reelmetrics.plans.views import view


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def executed(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def count(plan):
    return Counter(re.findall(r"[-+:*)] *([A-Z][A-Za-z]+)\b", plan))


def test_cadence_scans_once_and_never_windows_whole_videos(spark, small):
    plan = executed(cadence.frame_metrics(view(spark, small, "v_frames")))
    assert count(plan)["FileScan"] == 1
    exchanges = re.findall(r" Exchange hashpartitioning\((.*?), \d+\)", plan)
    # first by slice of a video, then the few edge frames by video
    assert len(exchanges) == 2
    assert sum("__slice" in e for e in exchanges) == 1


def test_level_stats_share_one_shuffle(spark, small, no_broadcast):
    plan = executed(quality.level_stats(view(spark, small, "v_scores")))
    assert "ReusedExchange" in plan and count(plan)["FileScan"] == 1


def test_top_n_is_limited_before_the_shuffle(spark, small):
    plan = executed(usage.top_waits(view(spark, small, "v_ops")))
    below = plan[plan.index("Exchange hashpartitioning") :]
    assert "WindowGroupLimit" in below


def test_episode_ranges_scan_chapters_once(spark, small, tmp_path, no_broadcast):
    path = str(tmp_path / "chapters")
    view(spark, small, "v_chapters").write.parquet(path)
    plan = executed(chapters.episode_ranges(spark.read.parquet(path)))
    assert count(plan)["FileScan"] == 1 and "ReusedExchange" in plan


def test_scan_reads_only_what_is_needed(spark, small):
    plan = QUERIES["frame_counts"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ReadSchema: struct<event_id:bigint,event_type:string>", plan)


def test_window_frames_join_on_buckets(spark, small, no_broadcast):
    frames = view(spark, small, "v_frames")
    spans = spark.createDataFrame([(1, 0, 3, 9)], "video_id BIGINT, sample_idx INT, first_frame BIGINT, last_frame BIGINT")
    plan = executed(ranges.window_frames(frames, spans))
    assert re.search(r"SortMergeJoin.*__b", plan)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_nested_loops_or_single_partition(spark, small, no_broadcast, name):
    df = QUERIES[name](spark, small)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    if name != "run_outcomes":
        assert "Exchange SinglePartition" not in plan


def test_every_query_has_its_check():
    assert set(QUERIES) == set(CHECKS)
