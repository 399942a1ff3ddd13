"""Bucketed summaries, search on demand, rules as data, sketches, folder walks and written documents."""

import hashlib
import re
from urllib.parse import quote

import pytest
from conftest import rows
from pyspark.sql import functions as F

from reelmetrics.functions import probe
from reelmetrics.operators import chapters, quality, search, usage
from reelmetrics.plans.registry import QUERIES
from reelmetrics.plans.views import view
from reelmetrics.settings import DEFAULTS
from reelmetrics.sources import documents, folders, readers, writers


def test_bucketed_summary_needs_no_shuffle(spark, small):
    df = QUERIES["fleet_summary_bucketed"](spark, small)
    df.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.findall(r"\bExchange\b", plan) and plan.count("SortMergeJoin") >= 5
    assert len(re.findall(r"Bucketed: true", plan)) + plan.count("SelectedBucketsCount") >= 9
    assert sorted(map(tuple, df.collect()), key=str) == sorted(map(tuple, QUERIES["fleet_summary"](spark, small).collect()), key=str)


def level_scores(spark, videos=6):
    """Video v passes up to level 20 + 7 v."""
    data = [(v, cq, 0, 99.0 if cq <= 20 + 7 * v else 80.0) for v in range(videos) for cq in range(64) for _ in range(3)]
    return spark.createDataFrame(data, "video_id long, cq int, sample_idx int, score double")


def test_search_measures_each_level_once_and_seven_rounds_at_most(spark):
    scores, asked = level_scores(spark), []

    def measure(levels):
        # The last call may be for the columns alone.
        asked.append([tuple(r) for r in levels.collect()])
        return scores.join(levels, ["video_id", "cq"])

    ranges = spark.createDataFrame([(v, 0, 63) for v in range(6)] + [(7, 50, 40)], "video_id long, min_cq int, max_cq int")
    state, trace = search.search_levels(ranges, measure)
    taken = [x for each in asked for x in each]
    assert len(taken) == len(set(taken)) and len([a for a in asked if a]) <= search.MAX_PROBES
    assert {r["video_id"]: r["best_cq"] for r in rows(state)} == {v: min(63, 20 + 7 * v) for v in range(6)}
    whole = search.bisect_trace(quality.level_stats(scores), ranges).drop("measured")
    got = trace.select("video_id", "step", "lo", "hi", "cq", F.coalesce("passed", F.lit(False)).alias("passed"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))


def test_search_without_usable_ranges(spark):
    scores = level_scores(spark, 1)
    none = spark.createDataFrame([(0, 70, 10)], "video_id long, min_cq int, max_cq int")
    state, trace = search.search_levels(none, lambda asked: scores.join(asked, ["video_id", "cq"]))
    assert state.count() == 0 and trace.count() == 0
    assert {"video_id", "step", "lo", "hi", "cq", "passed"} <= set(trace.columns)


def test_rules_equal_the_case_form(spark):
    sizes = [(k, w, h) for k, (w, h) in enumerate([(3840, 100), (10, 2160), (1920, 1), (1, 1080), (1280, 1), (None, 720), (719, None), (None, None), (3840, 2160)])]
    streams = spark.createDataFrame(sizes, "file_id long, width int, height int")
    tiers = [(k, *t) for k, t in enumerate(DEFAULTS.tiers)]
    odd = [(-1, "bad", 0, 0, 70, 10), (-2, "none", None, 0, 1, 2), (99, "hidden", 0, 0, 1, 2), (None, "x", 0, 0, 1, 2)]
    rules = spark.createDataFrame(tiers + odd, "rank int, tier string, min_width int, min_height int, min_cq int, max_cq int")
    want = streams.select("file_id", probe.search_tier(F.col("width"), F.col("height")).alias("t")).select("file_id", "t.*")
    assert rows(probe.tiers_by_rules(streams, rules), "file_id") == rows(want, "file_id")
    assert sorted(r["problem"] for r in rows(probe.split_rules(rules)[1])) == ["min_cq outside 0..63", "rank or tier is missing", "size bound is missing"]


def test_rules_that_nothing_meets_and_too_many(spark, monkeypatch):
    streams = spark.createDataFrame([(1, 10, 10)], "file_id long, width int, height int")
    rules = spark.createDataFrame([(1, "big", 100, 100, 1, 2)] * 2, "rank int, tier string, min_width int, min_height int, min_cq int, max_cq int")
    assert rows(probe.tiers_by_rules(streams, rules)) == [{"file_id": 1, "tier": None, "min_cq": None, "max_cq": None}]
    monkeypatch.setattr(probe, "MOST_RULES", 1)
    with pytest.raises(ValueError, match="more than 1 rules"):
        probe.tiers_by_rules(streams, rules)


def test_rollup_tells_null_keys_from_subtotals(spark):
    ops = spark.createDataFrame([("a", 1, 10), ("a", None, 5), (None, 1, 7), (None, None, 2)], "run_id string, video_id long, hold_ms long").withColumns({r: F.lit(1) for r in usage.RESOURCES})
    got = {(r["grain"], r["run_id"], r["video_id"]): (r["cpu_ms"], r["ops"]) for r in rows(usage.resource_rollup(ops))}
    assert got == {("video", "a", 1): (10, 1), ("video", "a", None): (5, 1), ("video", None, 1): (7, 1), ("video", None, None): (2, 1),
                   ("run", "a", None): (15, 2), ("run", None, None): (9, 2), ("total", None, None): (24, 4)}


def test_merged_sketches_keep_their_bound(spark):
    """Many scores in a level, far more than the sketch holds, in parts of unequal size."""
    scores = spark.range(200_000).select((F.col("id") % 2).alias("video_id"), F.lit(30).alias("cq"), F.pmod(F.xxhash64("id"), F.lit(100_000)).cast("double").alias("score"), F.least(F.col("id") % 7, F.lit(3)).alias("day"))
    k = 256
    got = {r["video_id"]: r for r in rows(quality.merged_sketches(quality.score_sketches(scores, k=k), k))}
    for video, found in got.items():
        own = sorted(r["score"] for r in scores.where(F.col("video_id") == video).select("score").collect())
        assert found["n"] == len(own) and found["min"] == own[0] and found["mean"] == pytest.approx(sum(own) / len(own))
        for name, p in quality.PERCENTILES.items():
            rank = sum(x <= found[name] for x in own) / len(own)
            assert abs(rank - p) <= 2.3 / k**0.9


def test_sketches_of_odd_levels(spark):
    data = [(1, 1, None), (2, 1, float("nan")), (2, 1, 5.0), (3, 1, -1.0), (3, 1, 0.0), (None, None, 4.0)]
    scores = spark.createDataFrame(data, "video_id long, cq int, score double").withColumn("day", F.lit(1))
    got = {r["video_id"]: r for r in rows(quality.merged_sketches(quality.score_sketches(scores)))}
    assert (got[1]["n"], got[1]["mean"], got[1]["p05"]) == (0, 0.0, None)
    assert (got[2]["n"], got[2]["mean"], got[2]["p05"]) == (2, None, None)
    assert (got[3]["p05"], got[3]["harmonic"], got[None]["p01"]) == (-1.0, 0.0, 4.0)


def test_walk_lists_flat_and_deep_trees_by_levels(spark, tmp_path):
    names = [f"flat/{k}.mkv" for k in range(300)] + ["a/b/c/d/e/f.mkv", "a/.g/h.mkv", "_x/i j.mkv", "_x/ü+%~*.mkv", "top.mkv"]
    for name in names:
        path = tmp_path / "tree" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(name)
    (tmp_path / "tree" / "empty").mkdir()
    found = rows(folders.list_files(spark, str(tmp_path / "tree")))
    assert sorted(r["path"] for r in found) == sorted(f"file:{tmp_path}/tree/{quote(n)}" for n in names)
    assert sum(r["length"] for r in found) == sum(len(n.encode()) for n in names)
    assert folders.list_files(spark, str(tmp_path / "tree" / "empty")).count() == 0


def test_duplicate_keys_of_a_walk(spark, tmp_path):
    for name in ("a/x.mkv", "b/x.mkv", "b/y.mkv"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"0" * 20_000)
    assert [r["files"] for r in rows(readers.duplicate_keys(readers.read_catalog(spark, str(tmp_path))))] == [2]


def test_documents_are_written_many_to_a_task(spark, tmp_path):
    lines = spark.createDataFrame([(f"{k % 7}/{k % 60}.txt", k, None if k == 3 else f"line {k}") for k in range(600)], "path string, line int, text string")
    manifest = rows(writers.write_documents(lines.repartition(5), str(tmp_path / "docs")), "path")
    assert [r["path"] for r in manifest] == sorted({f"{k % 7}/{k % 60}.txt" for k in range(600)})
    for r in manifest:
        data = (tmp_path / "docs" / r["path"]).read_bytes()
        assert (len(data), hashlib.sha256(data).hexdigest(), data.count(b"\n")) == (r["bytes"], r["sha256"], r["lines"])
        numbers = [int(x.split()[1]) for x in data.decode().splitlines() if x]
        assert numbers == sorted(numbers)
    assert not list((tmp_path / "docs").rglob("*.part"))
    assert writers.write_documents(lines.where("false"), str(tmp_path / "none")).count() == 0


def test_chapter_documents_round_trip(spark, tmp_path):
    data = [(d, k, k * 100 + d, f"00:0{k}:00", f"00:0{k}:59.5", "", "") for d in (1, 2) for k in range(1, 9)]
    claimed = spark.createDataFrame(data, "disc_id long, number long, uid long, start_text string, end_text string, title string, language string")
    claimed = claimed.select("disc_id", F.when(F.col("number") < 4, 1).otherwise(2).alias("episode"), "number", "uid", "start_text", "end_text", F.lit("Chapter & <1>").alias("label"), F.lit("en").alias("label_language"))
    manifest = writers.write_episode_documents(claimed, str(tmp_path / "docs"))
    assert sorted(r["path"] for r in rows(manifest)) == ["1/1.xml", "1/2.xml", "2/1.xml", "2/2.xml"]
    docs = spark.read.text(f"{tmp_path}/docs/*/*.xml", wholetext=True).select(F.col("value").alias("doc"))
    got = rows(documents.parse_chapters(docs), "uid")
    assert [(r["uid"], r["start_text"], r["end_text"], r["title"]) for r in got] == sorted((d + k * 100, s, e, "Chapter & <1>") for d, k, _, s, e, *_ in data)
    assert chapters.chapter_document_lines(claimed).count() == 16 + 8


def test_written_documents_are_read_by_many_files_to_a_task(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "docs")
    lines = spark.createDataFrame([(f"{k % 3}/{k % 40}.txt", k, f"é {k}") for k in range(200)], "path string, line int, text string")
    manifest = writers.write_documents(lines, folder)
    want = {f"{k % 3}/{k % 40}.txt": "" for k in range(200)}
    for k in range(200):
        want[f"{k % 3}/{k % 40}.txt"] += f"é {k}\n"
    for files, size, batch, tasks in ((5_000, 1 << 20, 1 << 20, 2), (25, 1 << 20, 1, 2 + len(want) // 25), (5_000, 100, 7, 2 + sum(len(t.encode()) for t in want.values()) // 100)):
        monkeypatch.setattr(readers, "TASK_FILES", files)
        monkeypatch.setattr(readers, "TASK_BYTES", size)
        monkeypatch.setattr(readers, "BATCH_BYTES", batch)
        read = readers.read_documents(manifest, folder)
        assert {r["path"]: r["doc"] for r in rows(read)} == want and read.count() == len(want) and read.rdd.getNumPartitions() == tasks
    (tmp_path / "docs/1/1.txt").unlink()
    with pytest.raises(Exception, match="1/1.txt"):
        read.collect()
    assert readers.read_documents(writers.write_documents(lines.where("false"), str(tmp_path / "none")), str(tmp_path / "none")).count() == 0


def test_episode_documents_list_no_file_on_the_driver(spark, tmp_path):
    orders = spark.range(3_000).selectExpr("id as o_orderkey", "id * 7 as o_custkey", "cast(xxhash64(id) & 524287 as double) as o_totalprice")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    df = QUERIES["episode_documents"](spark, str(tmp_path))
    assert not [f for f in df.inputFiles() if f.endswith(".xml")]
    assert df.rdd.getNumPartitions() == 2  # one for each 32 documents where Spark lists them
    claimed = chapters.episode_chapters(view(spark, str(tmp_path), "v_chapters"))
    want = claimed.selectExpr("disc_id", "episode", "number", "chapter_idx + 1", "label", "label_language", "concat('01:02:', lpad(string(chapter_idx % 60), 2, '0'))")
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want.collect()))
    assert want.select("disc_id", "episode").distinct().count() > 300
