"""Readers on small files."""

import json

from conftest import rows

from reelmetrics.sources import documents, readers


def test_catalog(spark, tmp_path):
    def put(name, size):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x" * size)

    for name, size in {"b.mkv": 20_000, "A film (1).mkv": 10_240, "tiny.mkv": 10_239, ".hidden.mkv": 20_000, ".dir/deep/c.mkv": 20_000, "_d%20.mkv": 20_000, "sub/_x/b.mp4": 30_000, "sub/.e.mkv": 20_000}.items():
        put(name, size)
    df = readers.read_catalog(spark, str(tmp_path))
    got = {r["path"].split(str(tmp_path))[-1]: (r["video_id"], r["length"]) for r in rows(df)}
    assert sorted(v for v, _ in got.values()) == ["A_film__1_", "_d_20", "b", "b", "c"]
    assert {r["modified"].year for r in rows(df)} != {None}
    listing = spark.createDataFrame([("/x/.dir/c.mkv", 20_000), ("/x/_d.mkv", 10_240), ("/x/.e.mkv", 20_000), ("f", 1)], "path STRING, length BIGINT")
    assert [r["path"] for r in rows(documents.candidates(listing), "path")] == ["/x/.dir/c.mkv", "/x/_d.mkv"]
    assert rows(readers.duplicate_keys(df))[0]["files"] == 2
    ordered = [r["path"].rsplit("/", 1)[-1] for r in documents.catalog_order(df).collect()]
    assert ordered == ["c.mkv", "_d%2520.mkv", "A%20film%20%281%29.mkv", "b.mkv", "b.mp4"]
    (tmp_path / "none").mkdir()
    assert readers.read_catalog(spark, str(tmp_path / "none")).count() == 0
    assert readers.read_catalog(spark, f"file://{tmp_path}").count() == 5


def test_probe_documents(spark, tmp_path):
    good = {
        "format": {"duration": "60.5", "bit_rate": "1000", "size": "77", "other": 1},
        "streams": [
            {"codec_type": "video", "disposition": {"attached_pic": 1}, "width": 1},
            {"codec_type": "audio"},
            {"codec_type": "video", "codec_name": "h264", "width": 1920, "height": 1080, "r_frame_rate": "25/1", "avg_frame_rate": "25/1"},
        ],
    }
    (tmp_path / "good one.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "short.json").write_text(json.dumps({"format": {"duration": "1.0"}, "streams": [{"codec_type": "video"}]}))
    (tmp_path / "bad.json").write_text("{not json")
    (tmp_path / "nodur.json").write_text(json.dumps({"format": {"duration": "N/A", "size": "x"}, "streams": [{"codec_type": "video"}]}))
    probed = readers.read_probes(spark, str(tmp_path))
    got = {r["video_id"]: r for r in rows(probed)}
    assert {k: r["usable"] for k, r in got.items()} == {"good_one": True, "short": False, "bad": False, "nodur": False}
    (row,) = rows(documents.usable_videos(probed))
    assert (row["video_id"], row["codec_name"], row["width"], row["duration_s"]) == ("good_one", "h264", 1920, 60.5)
    stats = {r["video_id"]: r for r in rows(documents.output_stats(probed))}
    assert (stats["good_one"]["rate_text"], stats["good_one"]["size"], stats["nodur"]["size"], stats["nodur"]["duration_s"]) == ("25", 77, 0, 0.0)


def test_frame_log(spark, tmp_path):
    words = ["progressive", "TFF", "bff", "neither", None, "progressive"]
    text = ""
    for i, w in enumerate(words):
        text += f"frame:{i}    pts:{i * 512}  pts_time:0.{i}\n"
        if w:
            text += f"lavfi.idet.single.current_frame=tff\nlavfi.idet.multiple.current_frame={w}\n"
    (tmp_path / "film.log").write_text(text)
    got = rows(readers.read_frame_log(spark, str(tmp_path)), "frame_idx")
    assert [(r["video_id"], r["frame_idx"], r["flag"]) for r in got] == [
        ("film", 0, "progressive"), ("film", 1, "tff"), ("film", 2, "bff"), ("film", 3, "undetermined"), ("film", 5, "progressive"),
    ]


def test_detector_totals(spark, tmp_path):
    line = "[idet] Multi frame detection: TFF: {} BFF: {} Progressive: {} Undetermined: {}\n"
    (tmp_path / "twice.log").write_text("x\n[idet] Single frame detection: TFF: 9 BFF: 9 Progressive: 9 Undetermined: 9\n" + line.format(0, 0, 0, 0) + line.format(1500, 50, "   7", 10))
    (tmp_path / "none.log").write_text("nothing here\n")
    (tmp_path / "empty.log").write_text("")
    got = {r["video_id"]: (r["progressive"], r["tff"], r["bff"], r["undetermined"]) for r in rows(readers.read_totals(spark, str(tmp_path)))}
    assert len(got) in (2, 3)
    assert got.pop("twice") == (7, 1500, 50, 10)
    assert set(got.values()) <= {(None,) * 4} and "none" in got
    nulls = spark.createDataFrame([(1, None), (2, "")], "id INT, log STRING")
    assert all(r["tff"] is None for r in rows(documents.parse_totals(nulls)))


def test_scores(spark, tmp_path):
    folder = tmp_path / "My film"
    folder.mkdir()
    doc = {"frames": [{"frameNum": 0, "metrics": {"vmaf": 90.5}}, {"metrics": {}}, {"metrics": {"vmaf": 99}}], "pooled_metrics": {"vmaf": {"mean": 0, "harmonic_mean": 94.0}}}
    (folder / "cq40_s03.json").write_text(json.dumps(doc))
    (folder / "other.json").write_text(json.dumps(doc))
    got = rows(readers.read_scores(spark, str(tmp_path)), "frame_idx")
    assert [(r["video_id"], r["cq"], r["sample_idx"], r["frame_idx"], r["score"]) for r in got] == [("My_film", 40, 3, 0, 90.5), ("My_film", 40, 3, 2, 99.0)]
    docs = spark.createDataFrame([(1, json.dumps(doc)), (2, "{}"), (3, json.dumps({"pooled_metrics": {"vmaf": {"mean": 95.0, "min": 3.5}}}))], "id INT, doc STRING")
    pooled = [(r["mean"], r["harmonic_mean"], r["min"], r["n"]) for r in rows(documents.parse_pooled(docs), "id")]
    assert pooled == [(94.75, 94.0, 90.5, 2), (0.0, 0.0, 0.0, 0), (95.0, 0.0, 3.5, 0)]


def test_hdr(spark):
    def doc(*entries):
        return json.dumps({"frames": [{"side_data_list": list(entries)}]})

    light = lambda c, a=None: {"side_data_type": "Content light level metadata", "max_content": c, "max_average": a}
    display = lambda x: {"side_data_type": "Mastering display metadata", "max_luminance": x}
    cases = [
        (1, doc(light(1000, "400"), display("10000000/10000")), (1000, 400, 1000)),
        (2, doc(display(4000.5)), (None, None, 4000)),
        (3, doc(display("1/0")), None),
        (4, doc(light("x"), display("600.7")), (None, None, 601)),
        (5, doc({"side_data_type": "other"}), None),
        (6, "broken", None),
        (7, json.dumps({"frames": []}), None),
        (8, doc(light(1), light(2)), (2, None, None)),
        (9, doc(light(1), light("x")), (1, None, None)),
        (10, json.dumps({"frames": [{}, {"side_data_list": [light(5)]}]}), (5, None, None)),
        (11, doc(display("1001/2")), (None, None, 500)),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "id INT, doc STRING")
    got = {r["id"]: (r["max_cll"], r["max_fall"], r["mastering_max_luminance"]) for r in rows(documents.parse_hdr(df))}
    assert got == {c[0]: c[2] for c in cases if c[2]}


def test_chapters(spark, tmp_path):
    body = """<?xml version="1.0"?>
<Chapters><EditionEntry><EditionUID>1</EditionUID>
 <ChapterAtom><ChapterUID>12345678901234</ChapterUID><ChapterTimeStart>00:00:00.000000000</ChapterTimeStart><ChapterTimeEnd>00:10:00.000000000</ChapterTimeEnd>
  <ChapterDisplay><ChapterString>Tom &amp; Co</ChapterString><ChapterLanguage>eng</ChapterLanguage></ChapterDisplay></ChapterAtom>
 <ChapterAtom><ChapterTimeStart>00:10:00</ChapterTimeStart></ChapterAtom>
</EditionEntry></Chapters>"""
    (tmp_path / "disc 1.xml").write_text(body)
    got = rows(readers.read_chapters(spark, str(tmp_path)), "chapter_idx")
    assert [(r["disc_id"], r["chapter_idx"], r["uid"], r["title"], r["end_text"]) for r in got] == [
        ("disc_1", 0, 12345678901234, "Tom & Co", "00:10:00.000000000"), ("disc_1", 1, None, "", ""),
    ]


def test_events(spark, tmp_path):
    lines = [
        {"@t": "2024-05-01T10:00:00.1234567Z", "@mt": "Pool acquired {Op} for {File}: granted {@Granted}", "Op": "detection", "File": "f", "Granted": {"Cpu": 4, "Nvdec": 1}, "AltIndex": 1, "WaitMs": 900},
        {"@t": "2024-05-01T10:00:01Z", "@mt": "Pool released {Op} for {File}: released {@Released}", "Op": "detection", "File": "f", "Released": {"Cpu": 4}, "HoldMs": 31000, "WaitersGrantedInScan": 2},
        {"@t": "2024-05-01T10:00:05Z", "@mt": "System util sample: pool {@Pool}; cpu", "Pool": {"Cpu": 10, "Nvenc": 4, "Nvdec": 3, "Cuda": 2}, "CpuPct": 12.5, "Load1m": 3.25, "Gpu": {"GpuUtilPct": 7}},
        {"@t": "2024-05-01T10:00:06Z", "@mt": "{Message:l}", "@l": "Warning", "Message": "odd"},
    ]
    (tmp_path / "events.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    events = readers.read_events(spark, str(tmp_path))
    assert sorted(r["kind"] for r in rows(events.select("kind"))) == ["acquire", "message", "release", "tick"]
    assert [r["level"] for r in rows(events.where("kind = 'message'").select("level"))] == ["Warning"]
    acquire, release = rows(documents.pool_events(events), "t")
    assert (acquire["cpu"], acquire["nvdec"], acquire["alt_index"], acquire["wait_ms"], acquire["cuda"]) == (4, 1, 1, 900, None)
    assert (release["cpu"], release["hold_ms"], release["woken"]) == (4, 31000, 2)
    (tick,) = rows(documents.tick_events(events))
    assert (tick["cpu_free"], tick["cuda_free"], tick["cpu_pct"], tick["load1m"], tick["gpu_pct"], tick["vram_mb"]) == (10, 2, 12.5, 3.25, 7, None)


def test_telemetry_lines(spark):
    gpu = spark.createDataFrame([(1, "\n 12, [N/A], 900 , 3\n9, 9, 9, 9"), (2, ""), (3, "5"), (4, None), (5, "x, 1, 2, 3")], "id INT, gpu_line STRING")
    got = [(r["gpu_pct"], r["mem_pct"], r["vram_mb"], r["nvenc_sessions"]) for r in rows(documents.parse_gpu_csv(gpu), "id")]
    assert got == [(12, None, 900, 3), (None,) * 4, (5, None, None, None), (None,) * 4, (None, 1, 2, 3)]
    cpu = spark.createDataFrame([(1, "cpu  10 1 2 100 5 3 4 6 0 0"), (2, "cpu 1 2 3 4"), (3, "what")], "id INT, cpu_line STRING")
    got = [(r["cpu_total"], r["cpu_idle"]) for r in rows(documents.parse_cpu_line(cpu), "id")]
    assert got == [(131, 105), (10, 4), (None, None)]
    load = spark.createDataFrame([("0.52 0.58 0.59 1/999 1",), ("oops",)], "t STRING").select(documents.load_average("t").alias("l"))
    assert [r["l"] for r in load.collect()] == [0.52, 0.0]


def test_chapter_documents_lose_nothing(spark):
    atom = lambda uid: f"<ChapterAtom><ChapterUID>{uid}</ChapterUID><ChapterTimeStart>0:0:0</ChapterTimeStart></ChapterAtom>"
    docs = {
        "large": f"<Chapters><EditionEntry>{atom(2**64 - 1)}{atom('none')}</EditionEntry></Chapters>",
        "two": f"<Chapters><EditionEntry>{atom(1)}</EditionEntry><EditionEntry>{atom(2)}{atom(3)}</EditionEntry></Chapters>",
        "broken": "<Chapters><EditionEntry>",
        "none": "<Chapters></Chapters>",
        "empty": "",
        "null": None,
    }
    table = spark.createDataFrame(list(docs.items()), "disc_id STRING, doc STRING")
    good = [(r["disc_id"], r["chapter_idx"], r["uid"]) for r in rows(documents.parse_chapters(table), "disc_id", "chapter_idx")]
    assert good == [("large", 0, 2**64 - 1), ("large", 1, None), ("two", 0, 1)]
    bad = {r["disc_id"]: r["reason"] for r in rows(documents.chapter_rejects(table))}
    assert set(bad) == {"broken", "none", "empty", "null"} and bad["broken"] == "document is not readable" and bad["none"] == "document has no chapters"
