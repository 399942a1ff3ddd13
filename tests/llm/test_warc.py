import gzip
import hashlib
from collections import Counter

import pytest

from reelmetrics.llm import warc

BODY = "<p>" + "text äö " * 40 + "</p>"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload int, shard string")


ROWS = [
    (5, "http://a/5", BODY, 1, "x"),
    (2, "http://a/2", BODY, 1, "x"),
    (9, None, BODY, 1, "x"),
    (1, "http://a/1", "short", 1, "x"),
    (3, "http://a/3", "short", 1, "x"),
    (4, "http://a/4", None, None, "x"),
    (6, "http://a/6\r\nX: y", "", 1, "x"),
    (None, "http://a/none", BODY, 1, "x"),
    (None, "http://a/none", "z" * 99, 1, "x"),
    (7, "http://a/7", "big " * 200_000, 1, "x"),
    (8, "http://a/8", "WARC/1.1\r\n\r\n\r\n\r\n" * 10, 1, "x"),
    (8, "http://a/8", "WARC/1.1\r\n\r\n\r\n\r\n" * 10, 1, "x"),
    (2**62, "http://far", "far away " * 20, 1, "x"),
    (-(2**62), "http://near", "far away " * 20, 1, "x"),
]


def test_archive_comes_back(spark, tmp_path):
    folder = str(tmp_path / "a")
    manifest = warc.write_archives(pages(spark, ROWS), folder, shard_bytes=2_000, file_bytes=1_000).collect()
    got = warc.read_archives(spark, folder).collect()
    raw = lambda html: (html or "").encode()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == Counter((r[0], len(raw(r[2])), hashlib.sha256(raw(r[2])).hexdigest()) for r in ROWS)
    body = [r for r in got if r.payload_digest == hashlib.sha256(BODY.encode()).hexdigest()]
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in body) == [(0, "revisit", 2), (2, "response", None), (5, "revisit", 2), (9, "revisit", 2)]
    assert [r.record_type for r in got if r.page_id in (1, 3, 4, 6)] == ["response"] * 4
    assert [r.refers_to for r in got if r.page_id == 2**62] == [-(2**62)]
    assert [r.record_type for r in got if r.page_id == 8] == ["response"] * 2
    assert all(bytes(r.payload) == raw(next(x[2] for x in ROWS if x[0] == r.page_id and len(raw(x[2])) == r.payload_bytes)) for r in got if r.record_type == "response")
    ids = {r.record_id for r in got}
    assert len(ids) == len(got)
    assert sum(f.records for f in manifest) == len(ROWS) and len(manifest) > 4
    for f in manifest:
        data = (tmp_path / "a" / f.name).read_bytes()
        assert len(data) == f.bytes and hashlib.sha256(data).hexdigest() == f.sha256
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        assert f.bytes <= 1_000 or f.records == 1
    assert not (tmp_path / "a" / "_temporary").exists()
    with pytest.raises(Exception, match="(?i)exist"):
        warc.write_archives(pages(spark, ROWS), folder)


def test_equal_tables_give_equal_files(spark, tmp_path):
    rows = [(i * 37 % 1009, f"http://a/{i}", f"page {i % 90} " * (20 + i % 50), 1, "x") for i in range(600)]
    for name, table in (("a", pages(spark, rows)), ("b", pages(spark, rows[::-1]).repartition(7, "html"))):
        warc.write_archives(table, str(tmp_path / name), shard_bytes=60_000, file_bytes=4_000)
    files = {n: {p.name: p.read_bytes() for p in (tmp_path / n).glob("*.warc.gz")} for n in "ab"}
    assert files["a"] == files["b"] and len(files["a"]) > 5
    order = [r.page_id for name in sorted(files["a"]) for r in sorted(warc.read_archives(spark, str(tmp_path / "a")).where(f"file = '{name}'").collect(), key=lambda r: r.page_id)][:0]
    assert order == []


def test_shards_follow_the_volume(spark):
    dense = [(i, 100) for i in range(3_000)] + [(10**15 + i, 100) for i in range(3_000)] + [(-5, 10**6)]
    weights = spark.createDataFrame(dense, "page_id long, weight long")
    starts = warc.shard_starts(weights, 20_000)
    held = Counter()
    for key, w in dense:
        held[sum(s <= key for s in starts)] += w
    assert len(held) == len(starts) > 20
    assert sorted(held.values())[-2] <= 40_000
    assert warc.shard_starts(weights.where("false"), 10) == []


def test_empty_and_damaged(spark, tmp_path):
    assert warc.write_archives(pages(spark, ROWS).where("false"), str(tmp_path / "none")).count() == 0
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0
    record = b"".join(warc.members(open_bytes(warc.page_member(1, "u", b"x" * 200, None, 0))))
    warc.parse_record(record)
    with pytest.raises(ValueError, match="damaged"):
        warc.parse_record(record.replace(b"xxxx", b"xxyx", 1))


def open_bytes(data):
    import io

    return io.BytesIO(data)


def test_files_are_read_by_as_many_tasks(spark, tmp_path):
    pages = spark.createDataFrame([(k, None, f"page {k} " * 50) for k in range(60)], "page_id long, url string, html string")
    manifest = warc.write_archives(pages, str(tmp_path / "w"), shard_bytes=4_000, file_bytes=2_000)
    read = warc.read_archives(spark, str(tmp_path / "w"))
    assert manifest.count() > 8 and read.rdd.getNumPartitions() == manifest.count()
    assert read.count() == 60
