"""Verification, size guard, resume, totals and the summary row."""

import json
from datetime import datetime

from conftest import rows
from pyspark.sql import functions as F

from reelmetrics.operators import decisions, outcome
from reelmetrics.plans import flows
from reelmetrics.plans.views import view
from reelmetrics.sources import readers, writers


def test_verification_rules(spark):
    plans = spark.createDataFrame(
        [(1, "none", None, None), (2, "ivtc", 24000, 1001), (3, "ivtc", 24000, 1001), (4, "ivtc", 24000, 1001), (5, "deinterlace", None, None),
         (6, "ivtc", 24000, 1001), (7, "ivtc", 24000, 1001), (8, "ivtc", 24000, 1001), (9, "deinterlace", None, None)],
        "video_id INT, mode STRING, out_num INT, out_den INT",
    )
    outputs = spark.createDataFrame(
        [(2, True, 0.99, 0.05, 23.976), (3, True, 0.989, 0.06, 29.97), (4, False, 1.0, 0.0, 23.976), (5, True, 1.0, 0.9, 25.0),
         (7, True, None, None, 23.976), (8, True, 1.0, 0.0, None), (9, True, 0.5, 0.0, 25.0)],
        "video_id INT, has_video BOOLEAN, progressive_fraction DOUBLE, cadence_rate DOUBLE, fps DOUBLE",
    )
    got = {r["video_id"]: r for r in rows(outcome.verify_outputs(plans, outputs))}
    assert {v: r["passed"] for v, r in got.items()} == {1: True, 2: True, 3: False, 4: False, 5: True, 6: False, 7: False, 8: True, 9: False}
    assert got[1]["skipped"] and not got[2]["skipped"]
    assert got[3]["warnings"] == ["residual_interlacing", "residual_cadence", "unexpected_rate"]
    assert [got[v]["notes"] for v in (4, 6, 7)] == ["no video stream", "probe failed", "detection failed"]
    assert got[9]["warnings"] == ["residual_interlacing"] and got[4]["warnings"] == []


def test_size_guard_rules(spark):
    data = [
        (1, "none", 100, 80, None), (2, "ivtc", 100, 120, 90), (3, "none", 100, 120, 101), (4, "none", 100, 100, 100),
        (5, "none", 100, 120, None), (6, "none", 100, 120, 130), (7, "none", 100, 100, 99),
    ]
    df = spark.createDataFrame(data, "video_id INT, mode STRING, input_bytes BIGINT, encoded_bytes BIGINT, passthrough_bytes BIGINT")
    got = {r["video_id"]: r for r in rows(outcome.size_guard(df))}
    assert {v: r["outcome"] for v, r in got.items()} == {
        1: "kept_smaller", 2: "kept_restored", 3: "fell_back", 4: "kept", 5: "kept_copy_failed", 6: "kept", 7: "fell_back",
    }
    assert round(got[1]["saved_pct"], 9) == 20.0 and got[1]["bloat_pct"] is None
    assert round(got[2]["bloat_pct"], 9) == 20.0 and got[2]["passthrough_bytes"] is None
    assert got[4]["bloat_pct"] == 0.0 and got[3]["output"] == "passthrough" and got[6]["passthrough_bytes"] == 130


def test_resume_reads_back_what_was_written(spark, tmp_path):
    path = tmp_path / "prior"
    path.mkdir()
    (path / "a.json").write_text(json.dumps({"video_id": "a", "final_cq": 40, "is_marginal": True}, indent=2))
    (path / "b.json").write_text('{"video_id": "b", "final')
    prior = readers.read_summaries(spark, str(path)).cache()
    videos = spark.createDataFrame([("a",), ("b",), ("c",)], "video_id STRING")
    todo, done = outcome.split_resumed(videos, prior)
    assert [r["video_id"] for r in rows(todo, "video_id")] == ["b", "c"]
    assert [(r["video_id"], r["final_cq"]) for r in rows(done)] == [("a", 40)]
    todo, done = outcome.split_resumed(videos, prior, force_redo=True)
    assert todo.count() == 3 and done.count() == 0
    both = outcome.combine_results(outcome.split_resumed(videos, prior)[1], spark.createDataFrame([("b", 30), ("c", None)], "video_id STRING, final_cq INT"))
    assert [(r["video_id"], r["resumed"], r["final_cq"]) for r in rows(both, "video_id")] == [("a", True, 40), ("b", False, 30), ("c", False, None)]


def test_run_totals(spark):
    data = [
        (None, False, True, False, False), (None, True, True, False, True), (None, False, False, True, True), (None, False, None, True, False),
        ("broken", False, None, None, None), (None, True, None, None, None),
    ]
    df = spark.createDataFrame(data, "error STRING, resumed BOOLEAN, verify_passed BOOLEAN, fell_back BOOLEAN, is_marginal BOOLEAN")
    (r,) = rows(outcome.run_outcomes(df))
    assert (r["videos"], r["completed"], r["errored"], r["skipped"], r["marginal"], r["passthrough"]) == (6, 5, 1, 2, 2, 2)
    assert (r["level_ok"], r["level_marginal"], r["level_passthrough"], r["level_verify_failed"]) == (2, 1, 1, 1)


def test_summary_row_goes_out_and_comes_back(spark, small, tmp_path):
    get = lambda name: view(spark, small, name)
    streams = get("v_video").drop("mode").withColumns({"pix_fmt": F.lit("yuv420p"), "color_transfer": F.lit(None).cast("string")})
    rows_out = flows.compress_summary(
        streams, get("v_frames"), get("v_scores"), get("v_sizes").drop("mode"),
        output_frames=get("v_frames"), output_streams=streams.select("video_id", "r_frame_rate", "avg_frame_rate", "field_order"),
        totals=get("v_totals"), ops=get("v_ops"),
    )
    path = str(tmp_path / "summaries")
    writers.write_summaries(rows_out.withColumn("run_id", F.lit("r1")), path)
    back = spark.read.json(path)
    got = {r["video_id"]: r for r in rows(back)}
    assert len(got) == 10
    assert got[2]["detection"]["content_type"] == "telecined" and got[2]["restore"]["mode"] == "ivtc"
    # the output of the check run is the input itself, so restored videos fail
    assert not got[2]["verification"]["passed"] and got[0]["verification"]["skipped"]
    assert got[2]["level"] == "verify_failed"
    assert len(got[0]["timings"]["phases"]) == 5
    todo, done = outcome.split_resumed(streams.select("video_id"), back.where("video_id < 4"))
    assert todo.count() == 6 and done.count() == 4


def test_warnings_decisions_and_run_row(spark, small, tmp_path):
    get = lambda name: view(spark, small, name)
    streams = get("v_video").drop("mode").withColumns({"pix_fmt": F.lit("yuv420p"), "color_transfer": F.lit(None).cast("string")})
    summary = flows.compress_summary(streams, get("v_frames"), get("v_scores"), get("v_sizes").drop("mode"), totals=get("v_totals")).cache()
    found = {r["video_id"]: r for r in rows(decisions.video_warnings(summary))}
    assert "undetermined_high" in [w["code"] for w in found[9]["warnings"]]
    assert all(r["count"] == len(r["warnings"]) for r in found.values())
    writers.write_events(decisions.decision_events(summary, "r1"), str(tmp_path / "events"))
    back = rows(spark.read.json(str(tmp_path / "events")))
    assert {r["run_id"] for r in back} == {"r1"} and len({r["file"] for r in back}) == 10
    assert len([r for r in back if r["op"] == "detection" and r["level"] == "Information"]) == 10
    assert len([r for r in back if r["level"] == "Warning"]) >= sum(r["count"] for r in found.values())
    results = summary.select(
        F.lit(None).cast("string").alias("error"), F.lit(False).alias("resumed"), "verification.passed", "size_guard.fell_back", "tuning.is_marginal"
    ).withColumnRenamed("passed", "verify_passed")
    (run,) = rows(flows.run_summary(results, "r1", datetime(2024, 1, 1)))
    assert run["outcomes"]["videos"] == 10 and run["config"]["uhd_range"] == [25, 55] and run["finished"] is None


def test_other_sinks(spark, tmp_path):
    events = spark.createDataFrame([("r1", "f1", "x"), ("r1", "f2", None)], "run_id STRING, file STRING, message STRING")
    writers.write_events(events, str(tmp_path / "events"), by_video=True)
    assert spark.read.json(str(tmp_path / "events")).count() == 2
    assert (tmp_path / "events" / "run_id=r1" / "file=f1").is_dir()
    run = spark.createDataFrame([("r1", None)], "run_id STRING, finished TIMESTAMP")
    writers.write_run(run, str(tmp_path / "runs"))
    text = "".join(p.read_text() for p in (tmp_path / "runs").glob("*.json"))
    assert json.loads(text) == {"run_id": "r1"}
    writers.write_manifest(events, str(tmp_path / "manifest"))
    assert spark.read.parquet(str(tmp_path / "manifest")).count() == 2
