"""Episode ranges against a walk, manifest, renumbering and documents."""

import random
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from reelmetrics.operators import chapters as ch
from reelmetrics.plans import flows
from reelmetrics.settings import Settings
from reelmetrics.sources import documents, writers


def walk(durations, threshold, extra):
    main = [d >= threshold for d in durations]
    found, start, n = [], 0, len(main)
    for i in range(n - 1):
        if main[i] and not main[i + 1]:
            end = min(i + extra, n - 1)
            found.append((start, end))
            start = end + 1
    if start < n and any(main[start:]):
        found.append((start, n - 1))
    return found


def table(spark, discs):
    data = []
    for disc, durations in discs.items():
        at = 0
        for i, d in enumerate(durations):
            data.append((disc, i, at, at + d, f"Part {i}" if i % 2 else ""))
            at += d
    return spark.createDataFrame(data, "disc_id BIGINT, chapter_idx BIGINT, start_s BIGINT, end_s BIGINT, title STRING")


def discs(seed):
    rng = random.Random(seed)
    made = {d: [rng.choice([100, 359, 360, 700]) for _ in range(rng.randint(1, 60))] for d in range(25)}
    return made | {100: [400] * 9, 101: [10] * 9, 102: [400], 103: [10], 104: [400, 10], 105: [400, 10, 400, 10, 10]}


@pytest.mark.parametrize("width", [1, 2, 5, 1 << 16])
@pytest.mark.parametrize("extra", [0, 1, 2, 7])
def test_ranges_equal_walk(spark, width, extra):
    made = discs(extra)
    settings = Settings(chapter_slice=width, extra_chapters=extra)
    got = {d: [] for d in made}
    for r in rows(ch.episode_ranges(table(spark, made), settings), "disc_id", "nth"):
        got[r["disc_id"]].append((r["start_idx"], r["end_idx"]))
        assert r["nth"] == len(got[r["disc_id"]])
    assert got == {d: walk(durations, 360, extra) for d, durations in made.items()}


def test_renumbered_chapters_cover_the_ranges(spark):
    made = discs(1)
    df = table(spark, made)
    got = {}
    for r in rows(ch.episode_chapters(df, start_episode=5), "disc_id", "chapter_idx"):
        got.setdefault((r["disc_id"], r["episode"]), []).append((r["chapter_idx"], r["label"]))
    want = {
        (d, n + 5): [(i, f"Chapter {i - s + 1}") for i in range(s, e + 1)]
        for d, durations in made.items()
        for n, (s, e) in enumerate(walk(durations, 360, 2))
        if s <= e
    }
    assert got == want


def test_one_episode_over_many_runs(spark):
    df = table(spark, {1: [10] * 500 + [400]})
    got = rows(ch.episode_chapters(df), "chapter_idx")
    assert len(got) == 501 and {r["episode"] for r in got} == {1} and got[-1]["label"] == "Chapter 501"


def test_split_flow_with_start_offset(spark):
    df = table(spark, {1: [50, 400, 10, 10, 500, 10]})
    manifest, claimed = flows.split(df, "Some Show", season=3, start_episode=7, start_chapter=2)
    got = rows(manifest, "episode")
    assert [r["file_name"] for r in got] == ["Some Show - S03E07.mkv", "Some Show - S03E08.mkv"]
    assert [(r["cut_start"], r["cut_end"]) for r in got] == [(50, 470), (470, 980)]
    assert {r["episode"] for r in rows(claimed)} == {7, 8}
    with pytest.raises(ValueError):
        ch.trim_chapters(df, 0)


def test_report_and_counts(spark):
    report, counts = flows.print_chapters(table(spark, {1: [50, 400]}))
    got = rows(report, "number")
    assert [(r["number"], r["title"], r["is_main"]) for r in got] == [(1, "(untitled)", False), (2, "Part 1", True)]
    assert rows(counts) == [{"disc_id": 1, "main_chapters": 1, "chapters": 2}]


def test_documents_round_trip(spark, tmp_path):
    lengths = [400, 10, 10, 500, 10]
    codes, at = [], 0
    for i, d in enumerate(lengths):
        code = lambda s: f"{s // 3600:02d}:{s % 3600 // 60:02d}:{s % 60:02d}.000000000"
        codes.append((1, i, 1000 + i, code(at), code(at + d), f"A & B {i}"))
        at += d
    raw = spark.createDataFrame(codes, "disc_id BIGINT, chapter_idx BIGINT, uid BIGINT, start_text STRING, end_text STRING, title STRING")
    good, bad = ch.add_times(raw)
    assert bad.count() == 0
    writers.write_chapter_documents(ch.episode_chapters(good), str(tmp_path / "docs"))
    files = sorted((tmp_path / "docs").rglob("*.txt"))
    assert len(files) == 2
    parsed = {}
    for file in files:
        episode = int(re.search(r"episode=(\d+)", str(file)).group(1))
        body = file.read_text()
        assert body.startswith('<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE Chapters SYSTEM "matroskachapters.dtd">')
        # The declaration of the document type is left out for reading back.
        df = spark.createDataFrame([(episode, re.sub(r"<!DOCTYPE[^>]*>", "", body))], "episode INT, doc STRING")
        parsed[episode] = rows(documents.parse_chapters(df), "chapter_idx")
    assert [r["uid"] for r in parsed[1]] == [1000, 1001, 1002]
    assert [r["title"] for r in parsed[2]] == ["Chapter 1", "Chapter 2"]
    assert parsed[2][0]["start_text"] == "00:07:00" and parsed[2][0]["language"] == "en"


def test_bad_time_codes_are_reported(spark):
    raw = spark.createDataFrame([(1, 0, "00:00:00", "soon"), (1, 1, "00:00:00", "00:01:00")],
                                "disc_id INT, chapter_idx INT, start_text STRING, end_text STRING")
    good, bad = ch.add_times(raw)
    assert [r["chapter_idx"] for r in rows(good)] == [1] and [r["chapter_idx"] for r in rows(bad)] == [0]


def test_manifest_with_text_bounds(spark):
    df = table(spark, {1: [400, 10]}).withColumns({"start_text": F.col("start_s").cast("string"), "end_text": F.col("end_s").cast("string")})
    (row,) = rows(ch.episode_manifest(df, F.lit("X"), start="start_text", end="end_text"))
    assert (row["cut_start"], row["cut_end"]) == ("0", "410")
