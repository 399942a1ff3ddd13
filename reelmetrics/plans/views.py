"""Inputs derived from the star-schema tables, and the SQL building blocks of the checks.

`SQL` holds named statements that build on each other; `compose` puts those a statement
needs in front of it.  The `v_` ones run unchanged on Spark and on DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmetrics.operators.ordered import ordered_scan

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {
    "v_frames": """
SELECT video_id, frame_idx,
 CASE video_id
  WHEN 0 THEN 'progressive'
  WHEN 1 THEN CASE WHEN frame_idx % 400 = 7 THEN 'tff' ELSE 'progressive' END
  WHEN 2 THEN CASE WHEN frame_idx % 5 < 3 THEN 'progressive' ELSE 'tff' END
  WHEN 3 THEN 'tff'
  WHEN 4 THEN CASE WHEN frame_idx % 200 < 100 OR frame_idx % 5 < 3 THEN 'progressive' ELSE 'tff' END
  WHEN 5 THEN CASE WHEN frame_idx % 200 < 150 THEN 'progressive' ELSE 'tff' END
  WHEN 6 THEN CASE WHEN frame_idx % 200 < 190 THEN 'progressive' ELSE 'bff' END
  WHEN 7 THEN CASE WHEN event_type IN ('view','click','purchase') THEN 'tff' ELSE 'bff' END
  WHEN 8 THEN CASE WHEN frame_idx IN (100,101,300,500) THEN 'tff' ELSE 'progressive' END
  ELSE CASE event_type WHEN 'signup' THEN 'undetermined' WHEN 'click' THEN 'tff' ELSE 'progressive' END
 END AS flag
FROM (SELECT event_id % 10 AS video_id, CAST(floor(event_id / 10.0) AS BIGINT) AS frame_idx, event_type FROM events) e""",
    "v_video": """
SELECT * FROM (VALUES
 (0,'24000/1001','24000/1001','progressive','none',3840,2160), (1,'24000/1001','24000/1001','unknown','none',1920,1080),
 (2,'30000/1001','30000/1001','tt','ivtc',720,480), (3,'25/1','25/1','tff','deinterlace',720,576),
 (4,'30000/1001','30000/1001','bb','ivtc',720,480), (5,'30000/1001','30000/1001','tb','deinterlace',1280,720),
 (6,'30000/1001','30000/1001','bff','ivtc',1920,1080), (7,'29.97','29.97','unknown','deinterlace',1280,720),
 (8,'30000/1001','30000/1001',NULL,'ivtc',1920,1080), (9,'60/2','15/1','TT','none',1280,720)
) AS t(video_id, r_frame_rate, avg_frame_rate, field_order, mode, width, height)""",
    "v_totals": """
SELECT video_id, CASE WHEN video_id % 4 = 0 THEN NULL ELSE p + video_id % 4 - 1 END AS progressive,
 CASE WHEN video_id % 4 = 0 THEN NULL ELSE t END AS tff, CASE WHEN video_id % 4 = 0 THEN NULL ELSE b END AS bff,
 CASE WHEN video_id % 4 = 0 THEN NULL ELSE u END AS undetermined
FROM (SELECT video_id, count(CASE WHEN flag = 'progressive' THEN 1 END) AS p, count(CASE WHEN flag = 'tff' THEN 1 END) AS t,
 count(CASE WHEN flag = 'bff' THEN 1 END) AS b, count(CASE WHEN flag = 'undetermined' THEN 1 END) AS u
 FROM v_frames GROUP BY video_id) c""",
    "v_scores": """
SELECT l_suppkey % 10 AS video_id, 25 + l_orderkey % 31 AS cq, l_partkey % 16 AS sample_idx,
 CASE WHEN l_suppkey % 10 = 3 AND l_orderkey % 31 = 30 THEN NULL WHEN l_suppkey % 10 = 4 AND l_orderkey % 31 = 1 AND l_partkey % 16 = 5 THEN CAST('NaN' AS DOUBLE) ELSE 99.5e0 - l_discount * 10e0 - (l_orderkey % 31) * 0.1e0 * (1e0 + (l_suppkey % 10) / 10e0) - l_quantity / 50e0
 - CASE WHEN l_suppkey % 10 = 7 THEN 4e0 ELSE 0e0 END END AS score
FROM lineitem""",
    "v_durations": "SELECT o_orderkey AS video_id, o_totalprice / 70e0 AS duration_s FROM orders",
    "v_chapter_rows": """
SELECT o_custkey % 50 AS disc_id, o_orderkey, CAST(floor(o_totalprice / 700) AS BIGINT) AS dur FROM orders""",
    "v_chapters": """
SELECT disc_id, row_number() OVER (PARTITION BY disc_id ORDER BY o_orderkey) - 1 AS chapter_idx,
 CAST(sum(dur) OVER (PARTITION BY disc_id ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) - dur AS BIGINT) AS start_s,
 CAST(sum(dur) OVER (PARTITION BY disc_id ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS end_s
FROM v_chapter_rows""",
    "v_ops": """
SELECT l_suppkey AS video_id,
 CASE l_linenumber WHEN 1 THEN 'detection' WHEN 2 THEN 'phase1.ref-extract' WHEN 3 THEN 'phase2.sample-encode'
  WHEN 4 THEN 'phase2.vmaf' WHEN 5 THEN 'final-encode' WHEN 6 THEN 'verification' ELSE 'phase2.vmaf' END AS op,
 CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS alt_index,
 1 + l_linenumber % 4 AS cpu, CASE WHEN l_linenumber IN (3,5) THEN 1 ELSE 0 END AS nvenc,
 CASE WHEN l_linenumber IN (4,5,7) THEN 1 ELSE 0 END AS nvdec, CASE WHEN l_linenumber IN (4,7) THEN 1 ELSE 0 END AS cuda,
 CAST(floor(l_tax * 100000e0) AS BIGINT) AS wait_ms, CAST(l_quantity AS BIGINT) * 1000 AS hold_ms,
 l_orderkey * 1000 AS start_ms, CASE WHEN l_linestatus = 'O' AND l_returnflag = 'A' THEN 1 ELSE 0 END AS woken
FROM lineitem""",
    # Op names that end in the level they were run for.
    "v_level_ops": """
SELECT video_id, CASE WHEN op LIKE 'phase2.%' THEN concat(op, '.cq', CAST(25 + start_ms / 1000 % 31 AS INT)) ELSE op END AS op,
 alt_index, wait_ms, hold_ms FROM v_ops""",
    "v_tick_rows": """
SELECT nullif(event_id % 4, 3) AS host, event_id AS tick_id, event_id * 1500 AS tick_ms,
 CAST(floor(CASE WHEN value < 100 THEN value ELSE 100e0 END) AS BIGINT) AS idle,
 CASE WHEN event_type = 'error' THEN NULL ELSE CAST(floor(value) AS BIGINT) % 101 END AS gpu_pct,
 20 - event_id % 21 AS cpu_free, 4 - event_id % 5 AS nvenc_free
FROM events""",
    "v_ticks": """
SELECT host, tick_id, tick_ms,
 CAST(sum(100) OVER (PARTITION BY host ORDER BY tick_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cpu_total,
 CAST(sum(idle) OVER (PARTITION BY host ORDER BY tick_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cpu_idle,
 gpu_pct, cpu_free, nvenc_free
FROM v_tick_rows""",
    # Counters that can be told from one row, for the stream.
    "v_counters": """
SELECT event_id % 4 AS host, event_id AS tick_id, event_id * 1500 AS tick_ms, event_id * 100 AS cpu_total, event_id * 40 + event_id % 97 AS cpu_idle
FROM events""",
    "v_probe": """
SELECT p_partkey AS file_id, CASE p_size % 10 WHEN 0 THEN '30000/1001' WHEN 1 THEN '24000/1001' WHEN 2 THEN '60000/1001' WHEN 3 THEN '25/1'
  WHEN 4 THEN '60/2' WHEN 5 THEN '29.97' WHEN 6 THEN '0/0' WHEN 7 THEN 'nope' WHEN 8 THEN '30/1' ELSE NULL END AS r_frame_rate,
 CASE p_partkey % 4 WHEN 0 THEN '30000/1001' WHEN 1 THEN '24000/1001' WHEN 2 THEN '15/1' ELSE '0/0' END AS avg_frame_rate,
 CASE p_partkey % 5 WHEN 0 THEN 3840 WHEN 1 THEN 1920 WHEN 2 THEN 1280 WHEN 3 THEN 720 ELSE NULL END AS width,
 CASE p_partkey % 7 WHEN 0 THEN 2160 WHEN 1 THEN 1080 WHEN 2 THEN 720 WHEN 3 THEN 480 ELSE NULL END AS height,
 CASE p_partkey % 3 WHEN 0 THEN 'yuv420p' WHEN 1 THEN 'yuv420p10le' ELSE 'yuv420p12le' END AS pix_fmt,
 CASE p_partkey % 6 WHEN 0 THEN 'smpte2084' WHEN 1 THEN 'ARIB-STD-B67' WHEN 2 THEN 'bt709' ELSE NULL END AS color_transfer
FROM part""",
    "v_probe_json": """
SELECT p_partkey AS file_id, concat('{"format":{"duration":"', CAST(p_size % 4 AS STRING), '.0","bit_rate":"',
 CASE WHEN p_size % 5 = 0 THEN 'N/A' ELSE CAST(p_size * 1000 AS STRING) END, '"},"streams":[{"codec_type":"',
 CASE WHEN p_partkey % 3 = 0 THEN 'audio' ELSE 'video' END, '","width":', CAST(p_size * 16 AS STRING),
 ',"disposition":{"attached_pic":', CAST(p_partkey % 2 AS STRING), '}}]}') AS doc
FROM part""",
    "v_score_json": """
SELECT p_partkey AS doc_id, concat('{"frames":[{"metrics":{"vmaf":', CAST(90 + p_size % 10 AS STRING), '.5}},{"metrics":{"vmaf":97.25}},{"metrics":{}}],"pooled_metrics":{"vmaf":{"mean":',
 CASE WHEN p_partkey % 2 = 0 THEN '0' ELSE '96.5' END, '}}}') AS doc
FROM part""",
    "v_hdr_json": """
SELECT p_partkey AS file_id, concat('{"frames":[{"side_data_list":[{"side_data_type":"Content light level metadata","max_content":',
 CASE p_partkey % 4 WHEN 0 THEN CAST(p_size * 20 AS STRING) WHEN 1 THEN concat('"', CAST(p_size * 20 AS STRING), '"') WHEN 2 THEN '"none"' ELSE '0' END,
 '},{"side_data_type":"Mastering display metadata","max_luminance":"',
 CASE p_partkey % 3 WHEN 0 THEN concat(CAST(p_size * 10000 AS STRING), '/10000') WHEN 1 THEN concat(CAST(p_size AS STRING), '.5') ELSE '1/0' END,
 '"}]}]}') AS doc
FROM part""",
    "v_chapter_xml": """
SELECT o_orderkey AS disc_id, CASE o_orderkey % 13 WHEN 0 THEN '<Chapters><EditionEntry><ChapterAtom>' WHEN 1 THEN '<Chapters><EditionEntry></EditionEntry></Chapters>' ELSE concat('<Chapters><EditionEntry>',
 '<ChapterAtom><ChapterUID>', CAST(18446744073709551615 - o_orderkey AS STRING), '</ChapterUID><ChapterTimeStart>00:00:00.000000000</ChapterTimeStart><ChapterTimeEnd>00:0',
 CAST(o_custkey % 10 AS STRING), ':30.500000000</ChapterTimeEnd><ChapterDisplay><ChapterString>Opening</ChapterString><ChapterLanguage>eng</ChapterLanguage></ChapterDisplay></ChapterAtom>',
 '<ChapterAtom><ChapterUID>', CAST(o_orderkey + 1 AS STRING), '</ChapterUID><ChapterTimeStart>00:0', CAST(o_custkey % 10 AS STRING),
 ':30.500000000</ChapterTimeStart><ChapterTimeEnd>01:1', CAST(o_orderkey % 10 AS STRING), ':10</ChapterTimeEnd><ChapterDisplay><ChapterString></ChapterString><ChapterLanguage>eng</ChapterLanguage></ChapterDisplay></ChapterAtom>',
 '</EditionEntry><EditionEntry><ChapterAtom><ChapterUID>7</ChapterUID></ChapterAtom></EditionEntry></Chapters>') END AS doc
FROM orders""",
    # One detector record: frame number, then its tag line; some frames carry none.
    "v_frame_records": """
SELECT event_id % 10 AS video_id, concat(CAST(CAST(floor(event_id / 10.0) AS BIGINT) AS STRING), '    pts:', CAST(event_id * 512 AS STRING), ' pts_time:1.0', chr(10),
 CASE WHEN event_type = 'signup' THEN '' ELSE concat('lavfi.idet.multiple.current_frame=',
  CASE event_type WHEN 'view' THEN 'Progressive' WHEN 'click' THEN 'tff' WHEN 'purchase' THEN 'BFF' ELSE 'neither' END) END, chr(10)) AS value
FROM events""",
    "v_total_logs": """
SELECT o_orderkey AS video_id, concat('Input #0', chr(10), CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat(
 '[idet @ 0x1] Multi frame detection: TFF:     0 BFF:     0 Progressive:     0 Undetermined:     0', chr(10),
 '[idet @ 0x1] Multi frame detection: TFF: ', CAST(o_custkey AS STRING), ' BFF: 7 Progressive:  ', CAST(o_orderkey AS STRING), ' Undetermined: 1') END) AS log
FROM orders""",
    "v_event_lines": """
SELECT event_id, concat('{"@t":"2024-01-01T00:00:0', CAST(event_id % 10 AS STRING), '.5000000Z",',
 CASE WHEN event_type = 'error' THEN '"@l":"Warning",' ELSE '' END, '"@mt":"',
 CASE event_type WHEN 'view' THEN 'Pool released {Op} for {File}' WHEN 'click' THEN 'Pool acquired {Op} for {File}' ELSE 'free text' END,
 '","Op":"', event_type, '","File":"f', CAST(user_id AS STRING), '","WaitMs":', CAST(event_id % 1000 AS STRING), ',"Granted":{"Cpu":', CAST(event_id % 4 AS STRING), '}}') AS value
FROM events""",
    "v_gpu_lines": """
SELECT event_id AS tick_id, concat(CASE WHEN event_id % 2 = 0 THEN chr(10) ELSE '' END, CAST(event_id % 101 AS STRING), ', ',
 CASE WHEN event_type = 'error' THEN '[N/A]' ELSE CAST(event_id % 77 AS STRING) END, ', ', CAST(event_id * 3 AS STRING),
 CASE WHEN event_type = 'view' THEN '' ELSE concat(', ', CAST(event_id % 5 AS STRING)) END, chr(10)) AS gpu_line
FROM events""",
    "v_cpu_lines": """
SELECT event_id AS tick_id, concat('cpu  ', CAST(event_id AS STRING), ' 1 2 ', CAST(event_id * 2 AS STRING), ' ', CAST(event_id % 7 AS STRING),
 CASE WHEN event_type = 'view' THEN '' ELSE ' 3 4 5 0 0' END) AS cpu_line
FROM events""",
    "v_sizes": """
SELECT o_orderkey AS video_id, CAST(floor(o_totalprice * 1000e0) AS BIGINT) AS input_bytes,
 CAST(floor(o_totalprice * (500e0 + (o_orderkey * 7919) % 1001)) AS BIGINT) AS encoded_bytes,
 CAST(floor(o_totalprice * (990e0 + o_orderkey % 300)) AS BIGINT) AS passthrough_bytes,
 CASE o_orderkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'ivtc' ELSE 'deinterlace' END AS mode
FROM orders""",
    "v_stages": """
SELECT conv_id AS slot, turn AS seq, CASE length(text) % 3 WHEN 0 THEN 'Detect' WHEN 1 THEN 'Phase 1' ELSE 'Phase 2' END AS stage, role AS detail
FROM conversations""",
    "v_catalog": "SELECT page_id, url AS path, CAST(length(html) AS BIGINT) AS length FROM pages",
    "v_events": "SELECT event_id, event_type, value FROM events",
    "v_prior": "SELECT o_orderkey AS video_id FROM orders WHERE o_orderkey % 5 = 0",
    "v_logs": "SELECT doc_id AS video_id, text AS log FROM documents",
    "v_completions": """
SELECT o_orderkey AS video_id, o_orderdate AS finished_at, o_orderstatus AS status FROM orders""",
    "v_results": """
SELECT o_orderkey AS video_id, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN 'tool failed' END AS error,
 o_orderkey % 7 <> 0 AS verify_passed, o_orderkey % 11 = 0 AS fell_back, o_orderstatus = 'P' AS is_marginal
FROM orders""",
    # A fleet: one video per supplier, its facts, frames, scores, sizes and outputs all from tables.
    "f_video": """
SELECT video_id, rate AS r_frame_rate, CASE WHEN video_id % 7 = 0 THEN '15/1' ELSE rate END AS avg_frame_rate, field_order, width, height, pix_fmt, color_transfer
FROM (SELECT s_suppkey AS video_id, CASE s_suppkey % 5 WHEN 0 THEN '24000/1001' WHEN 1 THEN '30000/1001' WHEN 2 THEN '25/1' WHEN 3 THEN '60/2' ELSE '29.97' END AS rate,
  CASE s_nationkey % 5 WHEN 0 THEN 'progressive' WHEN 1 THEN 'tt' WHEN 2 THEN 'bb' WHEN 3 THEN 'unknown' ELSE NULL END AS field_order,
  CASE s_suppkey % 4 WHEN 0 THEN 3840 WHEN 1 THEN 1920 WHEN 2 THEN 1280 ELSE 720 END AS width, CASE s_suppkey % 4 WHEN 0 THEN 2160 WHEN 1 THEN 1080 WHEN 2 THEN 720 ELSE 480 END AS height,
  CASE s_nationkey % 3 WHEN 0 THEN 'yuv420p' WHEN 1 THEN 'yuv420p10le' ELSE 'yuv420p12le' END AS pix_fmt,
  CASE s_nationkey % 4 WHEN 0 THEN 'smpte2084' WHEN 1 THEN 'arib-std-b67' WHEN 2 THEN 'bt709' ELSE NULL END AS color_transfer FROM supplier) s""",
    "f_frames": """
SELECT video_id, frame_idx,
 CASE video_id % 6 WHEN 0 THEN 'progressive' WHEN 1 THEN CASE WHEN frame_idx % 5 < 3 THEN 'progressive' ELSE 'tff' END WHEN 2 THEN 'tff'
  WHEN 3 THEN CASE WHEN event_type IN ('view', 'click') THEN 'progressive' ELSE 'bff' END WHEN 4 THEN CASE WHEN frame_idx % 50 = 7 THEN 'tff' ELSE 'progressive' END
  ELSE CASE event_type WHEN 'signup' THEN 'undetermined' WHEN 'click' THEN 'tff' ELSE 'progressive' END END AS flag
FROM (SELECT event_id % 250 AS video_id, CAST(floor(event_id / 250.0) AS BIGINT) AS frame_idx, event_type FROM events) e""",
    "f_totals": """
SELECT video_id, CASE WHEN video_id % 4 = 0 THEN NULL ELSE p + video_id % 4 - 1 END AS progressive, t AS tff, b AS bff, u AS undetermined
FROM (SELECT video_id, count(CASE WHEN flag = 'progressive' THEN 1 END) AS p, count(CASE WHEN flag = 'tff' THEN 1 END) AS t,
 count(CASE WHEN flag = 'bff' THEN 1 END) AS b, count(CASE WHEN flag = 'undetermined' THEN 1 END) AS u FROM f_frames GROUP BY video_id) c""",
    "f_scores": """
SELECT l_suppkey AS video_id, 25 + l_orderkey % 39 AS cq, l_partkey % 16 AS sample_idx,
 CASE WHEN l_suppkey % 7 = 5 THEN CASE WHEN l_orderkey % 39 < 25 THEN 99e0 ELSE 80e0 END ELSE 99.9e0 - l_discount * 5e0 - (l_orderkey % 39) * 0.06e0 * (1e0 + (l_suppkey % 10) / 10e0) - l_quantity / 50e0 - CASE WHEN l_suppkey % 7 = 3 THEN 4e0 ELSE 0e0 END END AS score
FROM lineitem""",
    "f_sizes": """
SELECT video_id, input_bytes, CAST(floor(input_bytes * (500 + (video_id * 7919) % 1001) / 1000e0) AS BIGINT) AS encoded_bytes,
 CAST(floor(input_bytes * (990 + video_id % 300) / 1000e0) AS BIGINT) AS passthrough_bytes
FROM (SELECT s_suppkey AS video_id, 1000000 + (s_suppkey * 1000003) % 10000000 AS input_bytes FROM supplier) s""",
    "f_hdr": """
SELECT s_suppkey AS video_id, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 100 * (s_suppkey % 30) END AS max_cll FROM supplier WHERE s_nationkey % 4 < 2""",
    # Outputs: some cannot be probed, some give no frames, some still have interlaced frames or another rate.
    "f_out_video": """
SELECT video_id, rate AS r_frame_rate, rate AS avg_frame_rate, 'progressive' AS field_order
FROM (SELECT s_suppkey AS video_id, CASE WHEN s_suppkey % 8 = 0 THEN '25/1' ELSE '24000/1001' END AS rate FROM supplier WHERE s_suppkey % 11 <> 5) s""",
    "f_out_frames": """
SELECT video_id, frame_idx, CASE WHEN video_id % 9 = 0 AND frame_idx % 4 = 0 THEN 'tff' WHEN video_id % 13 = 1 AND frame_idx % 5 > 2 THEN 'bff' ELSE 'progressive' END AS flag
FROM f_frames WHERE video_id % 10 <> 7""",
    # Tier rules as data: some overlap, some are hidden by an earlier one, some are unusable.
    "v_rules": """
SELECT CAST(p_partkey AS INT) AS rank, concat('rule ', CAST(p_partkey AS STRING)) AS tier, CAST(3900 - p_partkey * 37 AS INT) AS min_width, CAST(2200 - p_partkey * 23 AS INT) AS min_height,
 CAST(CASE WHEN p_partkey % 9 = 4 THEN 70 ELSE 20 + p_partkey % 11 END AS INT) AS min_cq, CAST(CASE WHEN p_partkey % 9 = 7 THEN 5 ELSE 50 + p_partkey % 13 END AS INT) AS max_cq
FROM part WHERE p_partkey BETWEEN 1 AND 90
UNION ALL SELECT 91, 'rest', 0, 0, 38, 63""",
    # Files as they may lie in a folder tree: hidden folders, names with blanks, underscores and other letters, flat and deep places.
    "v_tree": """
SELECT page_id, concat('disc ', CAST(page_id % 7 AS STRING), '/', CASE page_id % 5 WHEN 0 THEN '_under/' WHEN 1 THEN '.hidden/' WHEN 2 THEN '' ELSE concat('sub', CAST(page_id % 11 AS STRING), '/') END,
 CASE WHEN page_id % 3 = 0 THEN 'deep/er/still/' ELSE '' END, CASE page_id % 4 WHEN 0 THEN '_' WHEN 1 THEN '.' WHEN 2 THEN 'é ' ELSE 'f+' END, CAST(page_id AS STRING), '.mkv') AS path, html
FROM pages""",
    # Search ranges, some of them unusable.
    "v_ranges": """
SELECT p_partkey AS video_id, p_size - 3 AS min_cq, 66 - p_size AS max_cq FROM part""",
}


def _names(text: str, pool) -> list[str]:
    return [n for n in pool if re.search(rf"\b{n}\b", text)]


def ordered_parts(text: str, parts: dict[str, str]) -> list[str]:
    """Names of `parts` that `text` needs, each after the ones it builds on."""
    found: list[str] = []

    def visit(body: str) -> None:
        for name in _names(body, parts):
            if name not in found and body is not parts[name]:
                visit(parts[name])
                found.append(name) if name not in found else None

    visit(text)
    return found


def compose(body: str, parts: dict[str, str] = VIEWS) -> str:
    """`body` with a WITH clause that defines every part it uses."""
    names = ordered_parts(body, parts)
    if not names:
        return body.strip()
    clauses = ",\n".join(f"{n} AS ({parts[n].strip()})" for n in names)
    recursive = "RECURSIVE " if any("UNION ALL" in parts[n] for n in names) else ""
    return f"WITH {recursive}{clauses}\n{body.strip()}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input as a DataFrame; running sums are built the way that scales."""
    if name == "v_chapters":
        rows = ordered_scan(
            view(spark, sf_dir, "v_chapter_rows"), ["disc_id"], "o_orderkey", 1 << 16,
            totals={"n": F.lit(1), "end_s": F.col("dur")},
        )
        return rows.select("disc_id", (F.col("n") - 1).alias("chapter_idx"), (F.col("end_s") - F.col("dur")).alias("start_s"), "end_s")
    if name == "v_ticks":
        return ordered_scan(
            view(spark, sf_dir, "v_tick_rows"), ["host"], "tick_id", 1 << 16,
            totals={"cpu_total": F.lit(100), "cpu_idle": F.col("idle")},
        ).drop("idle")
    text = compose(f"SELECT * FROM {name}")
    for t in TABLES:
        text = re.sub(rf"\bFROM {t}\b", f"FROM parquet.`{sf_dir}/{t}.parquet`", text)
    return spark.sql(text)


def view_over(rows: DataFrame, table_name: str, name: str) -> DataFrame:
    """A derived input over given rows (also a stream) in place of the stored table."""
    text = re.sub(rf"\bFROM {table_name}\b", "FROM {rows}", compose(f"SELECT * FROM {name}"))
    return rows.sparkSession.sql(text, rows=rows)
