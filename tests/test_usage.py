"""Range joins, op analytics, samples, progress and logs."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from reelmetrics.operators import logs, ranges, stages, ticks, usage
from reelmetrics.settings import Settings

OPS = "video_id BIGINT, op STRING, alt_index INT, cpu INT, nvenc INT, nvdec INT, cuda INT, start_ms BIGINT, wait_ms BIGINT, hold_ms BIGINT, woken INT"


def ops(spark, data):
    return spark.createDataFrame(data, OPS)


def random_ops(n, seed=1):
    rng = random.Random(seed)
    return [
        (rng.randint(0, 4), rng.choice(["detection", "phase1.x", "phase2.vmaf.cq40", "final-encode"]), rng.randint(0, 1),
         rng.randint(1, 4), rng.randint(0, 1), rng.randint(0, 1), rng.randint(0, 1), rng.randint(0, 100_000), rng.choice([0, 0, 5, 90]),
         rng.choice([0, 1, 900, 10_000, 45_000]), rng.randint(0, 1))
        for _ in range(n)
    ]


@pytest.mark.parametrize("bucket,salts", [(700, 1), (10_000, 8), (10_000_000, 3)])
def test_held_ops_equal_brute_force(spark, bucket, salts):
    data = random_ops(200) + [(7, "long", 0, 1, 0, 0, 0, 5, 0, 10**9, 0), (8, "unknown", 0, 1, 0, 0, 0, None, 0, 50, 0)]
    times = sorted(random.Random(2).sample(range(150_000), 60)) + [data[0][7], data[0][7] + data[0][9], 10**9 - 1, None]
    host = lambda v: v % 3 or None
    at = spark.createDataFrame([(k, i, t) for k in (1, 2, None) for i, t in enumerate(times)], "host BIGINT, tick_id BIGINT, tick_ms BIGINT")
    run_by = ops(spark, data).withColumn("host", F.nullif(F.col("video_id") % 3, F.lit(0)))
    found = ranges.held_ops(at, run_by, ["host"], bucket_ms=bucket, salts=salts)
    got = sorted((r["host"] or 0, r["tick_id"], r["video_id"], r["start_ms"]) for r in rows(found))
    want = sorted((host(o[0]) or 0, i, o[0], o[7]) for i, t in enumerate(times) for o in data if None not in (t, o[7]) and o[7] <= t < o[7] + o[9])
    assert got == want and got


def test_a_burst_of_ops_is_shared_by_several_parts(spark):
    burst = spark.range(2_000).selectExpr("1L AS host", "id AS video_id", "100L AS start_ms", "50L AS hold_ms")
    one = spark.createDataFrame([(1, 1, 120)], "host BIGINT, tick_id BIGINT, tick_ms BIGINT")
    plan = ranges.held_ops(one, burst, ["host"]).withColumn("task", F.spark_partition_id())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["n"] for r in rows(plan.groupBy("task").agg(F.count("*").alias("n")))]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    assert sum(sizes) == 2_000 and len(sizes) > 2 and max(sizes) < 1_200


@pytest.mark.parametrize("width", [500, 20_000, 3_600_000])
def test_held_load_equals_brute_force(spark, width):
    data = random_ops(200, 7)
    times = [(k, i, i * 1371 + (k or 0)) for k in (0, None) for i in range(120)] + [(0, 500, None)]
    at = spark.createDataFrame(times, "run_id INT, tick_id BIGINT, tick_ms BIGINT")
    both = ops(spark, data).withColumn("run_id", F.nullif((F.col("video_id") % 2).cast("int"), F.lit(1)))
    got = {(r["run_id"], r["tick_id"]): r for r in rows(ranges.held_load(at, both, ["run_id"], slice_ms=width))}
    assert len(got) == len(times)
    assert got.pop((0, 500))["held_ops"] is None
    for k, i, t in times[:-1]:
        held = [o for o in data if o[0] % 2 == (1 if k is None else k) and o[7] <= t < o[7] + o[9]]
        r = got[k, i]
        assert (r["held_ops"], r["held_cpu"], r["held_cuda"]) == (len(held), sum(o[3] for o in held), sum(o[6] for o in held))


@pytest.mark.parametrize("bucket", [3, 512])
def test_window_frames(spark, bucket):
    streams = spark.createDataFrame([(1, "24000/1001", "24000/1001"), (2, "25/1", "25/1")], "video_id INT, r_frame_rate STRING, avg_frame_rate STRING")
    windows = spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 1, 2.5, 1.0), (2, 0, 0.2, 0.4), (2, 1, 100.0, 5.0)], "video_id INT, sample_idx INT, start_s DOUBLE, length_s DOUBLE")
    frames = spark.range(200).select(F.explode(F.array(F.lit(1), F.lit(2))).alias("video_id"), F.col("id").alias("frame_idx"), F.lit("progressive").alias("flag"))
    got = {}
    for r in rows(ranges.window_frames(frames, ranges.frame_ranges(windows, streams), bucket), "frame_idx"):
        got.setdefault((r["video_id"], r["sample_idx"]), []).append(r["frame_idx"])
    fps = 24000 / 1001
    assert got == {
        (1, 0): [i for i in range(200) if 0 <= i / fps < 1], (1, 1): [i for i in range(200) if 2.5 <= i / fps < 3.5],
        (2, 0): [i for i in range(200) if 0.2 <= i / 25 < 0.2 + 0.4],
    }


def test_time_card_and_op_stats(spark):
    data = [
        (1, "detection", 0, 1, 0, 1, 0, 1000, 200, 4000, 0), (1, "phase2.vmaf.cq40", 1, 3, 0, 1, 1, 6000, 0, 1000, 0),
        (1, "phase2.vmaf.cq40", 0, 3, 0, 1, 1, 6500, 300, 2000, 1), (1, "phase2.sample-encode.cq41", 0, 2, 1, 0, 0, 6000, 10, 100, 0),
        (1, "odd", 0, 1, 0, 0, 0, 9000, 0, 800, 0),
    ]
    card = {r["phase"]: r for r in rows(usage.time_card(ops(spark, data)))}
    assert (card["detection"]["wall_ms"], card["detection"]["queue_ms"], card["detection"]["run_ms"]) == (4200, 200, 4000)
    assert (card["phase2"]["wall_ms"], card["phase2"]["run_ms"], card["phase2"]["ops"]) == (2510, 3100, 3)
    assert card["other"]["total_ms"] == 9000 and card["detection"]["total_pct"] == pytest.approx(4200 / 90)
    stats = {(r["op"], r["cq"]): r for r in rows(usage.op_stats(ops(spark, data)))}
    vmaf = stats["phase2.vmaf", 40]
    assert (vmaf["n"], vmaf["wait_avg"], vmaf["wait_max"], vmaf["hold_sum"], vmaf["fallbacks"]) == (2, 150.0, 300, 3000, 1)
    assert stats["detection", None]["n"] == 1


def test_shares_and_top(spark):
    data = [(v, "x", 0, 1, 0, 0, v % 2, 0, 0, v * 10, 0) for v in range(1, 9)]
    share = usage.resource_share(ops(spark, data))
    totals = [r for r in rows(usage.resource_totals(share)) if r["video_id"] is None]
    assert (totals[0]["cpu_ms"], totals[0]["cuda_ms"], totals[0]["nvenc_ms"]) == (360, 160, 0)
    top = rows(usage.resource_top(share), "resource", "rank")
    cpu = [(r["video"], r["videos"], r["ms"]) for r in top if r["resource"] == "cpu"]
    assert cpu == [("8", 1, 80), ("7", 1, 70), ("6", 1, 60), ("5", 1, 50), ("4", 1, 40), ("others", 3, 60)]
    assert [r["video"] for r in top if r["resource"] == "cuda"] == ["7", "5", "3", "1"]
    assert sum(r["pct"] for r in top if r["resource"] == "cpu") == pytest.approx(100)
    assert not [r for r in top if r["resource"] == "nvenc"]


def test_waits_and_thinning(spark):
    data = [(1, "a", 0, 1, 0, 0, 0, i, w, h, k) for i, (w, h, k) in enumerate([(0, 10, 0), (5, 10, 1), (9, 30000, 0), (7, 29999, 0), (8, 40000, 1)])]
    df = ops(spark, data)
    assert [r["wait_ms"] for r in rows(usage.top_waits(df), "rank")] == [9, 8, 7]
    kept = sorted((r["start_ms"], r["event"]) for r in rows(usage.thin_events(df)))
    assert kept == [(1, "acquire"), (1, "release"), (2, "acquire"), (2, "release"), (3, "acquire"), (4, "acquire"), (4, "release")]


TICKS = "host BIGINT, tick_id BIGINT, tick_ms BIGINT, cpu_total BIGINT, cpu_idle BIGINT, cpu_free BIGINT, gpu_pct BIGINT, vram_mb BIGINT"


@pytest.mark.parametrize("width", [1000, 86_400_000])
def test_cpu_use(spark, width):
    data = [(1, 0, 0, 100, 50, 20, None, None), (1, 1, 5000, 200, 80, 10, 10, 900), (1, 2, 10000, 200, 90, 0, None, None),
            (1, 3, 15000, 190, 90, 5, 30, 1000), (1, 4, 20000, 290, 40, 5, None, None), (2, 5, 0, 7, 7, 20, None, None)]
    got = rows(ticks.cpu_pct(spark.createDataFrame(data, TICKS), settings=Settings(tick_slice_ms=width)), "tick_id")
    assert [r["cpu_pct"] for r in got] == [0.0, 70.0, 0.0, 0.0, 100.0, 0.0]


def test_summary_checkpoints_and_hints(spark):
    data = [(1, i, i * 100_000, 0, 0, f, g, v) for i, (f, g, v) in enumerate([(0, None, None), (4, 20, 15_800), (2, 40, 9000), (20, None, None)])]
    df = spark.createDataFrame(data, TICKS).withColumns({"cpu_pct": F.lit(10.0), "cuda_free": F.lit(0), "mem_pct": F.lit(None).cast("int")})
    (row,) = rows(ticks.tick_summary(df))
    assert row["samples"] == 4 and row["cpu_busy_pct"] == pytest.approx(100 * (20 - 6.5) / 20) and row["cpu_free_min"] == 0
    assert (row["gpu_pct_avg"], row["gpu_pct_max"], row["mem_pct_avg"], row["vram_mb_max"]) == (30.0, 40, None, 15_800)
    marks = rows(ticks.checkpoints(df), "until_ms")
    assert [(r["until_ms"], r["samples"]) for r in marks] == [(300_000, 3), (600_000, 4)]
    assert marks[0]["cpu_busy_pct"] == pytest.approx(90.0) and marks[1]["vram_mb_max"] == 15_800
    hinted = rows(ticks.util_hints(ticks.tick_summary(df.where("tick_id < 3")), vram_total_mb=16_384))[0]["hints"]
    assert hinted == ["cpu_underused", "cuda_underused", "vram_near_limit"]
    zero = rows(ticks.tick_summary(df, settings=Settings(cuda_total=0)))[0]
    assert zero["cuda_busy_pct"] == 0.0


def test_stages(spark):
    data = [(1, 0, "a", "x"), (1, 1, "a", "y"), (1, 2, "b", "z"), (1, 3, "a", "w"), (2, 0, "a", "q")]
    df = spark.createDataFrame(data, "slot INT, seq BIGINT, stage STRING, detail STRING")
    for width in (1, 2, 100):
        got = rows(stages.stage_changes(df, settings=Settings(stage_slice=width)), "slot", "seq")
        assert [(r["slot"], r["seq"]) for r in got] == [(1, 0), (1, 2), (1, 3), (2, 0)]
    assert [(r["slot"], r["stage"], r["detail"]) for r in rows(stages.latest_stage(df), "slot")] == [(1, "a", "w"), (2, "a", "q")]
    done = spark.createDataFrame([(i, i % 3) for i in range(20)], "video_id INT, finished_at INT")
    got = [(r["finished_at"], r["video_id"]) for r in rows(stages.recent(done))]
    assert got == sorted(((i % 3, i) for i in range(20)), reverse=True)[:8]


def test_log_lines(spark):
    text = "ok\n  [FieldMatch @ 1] odd order \r\n\nfieldmatch: x\nnothing"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "video_id INT, log STRING")
    got = rows(logs.log_warnings(df), "line_no")
    assert [(r["line_no"], r["line"]) for r in got] == [(1, "[FieldMatch @ 1] odd order"), (3, "fieldmatch: x")]
    assert rows(logs.log_warning_counts(df)) == [{"video_id": 1, "lines": 2}]
