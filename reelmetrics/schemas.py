"""Schemas of the documents that are read and of the tables handed around."""

from __future__ import annotations

PROBE_DOCUMENT = """
  format STRUCT<duration: STRING, bit_rate: STRING, size: STRING>,
  streams ARRAY<STRUCT<
    codec_type: STRING, codec_name: STRING, width: INT, height: INT, pix_fmt: STRING,
    color_transfer: STRING, color_primaries: STRING, color_space: STRING, field_order: STRING,
    disposition: STRUCT<attached_pic: INT>, r_frame_rate: STRING, avg_frame_rate: STRING>>
"""

SCORE_DOCUMENT = """
  frames ARRAY<STRUCT<frameNum: BIGINT, metrics: STRUCT<vmaf: DOUBLE>>>,
  pooled_metrics STRUCT<vmaf: STRUCT<mean: DOUBLE, harmonic_mean: DOUBLE, min: DOUBLE>>
"""

# Numbers arrive as JSON numbers or as text; text fields take both.
SIDE_DATA_DOCUMENT = """
  frames ARRAY<STRUCT<side_data_list: ARRAY<STRUCT<
    side_data_type: STRING, max_content: STRING, max_average: STRING, max_luminance: STRING>>>>
"""

CHAPTER_ATOM = """
  ChapterUID BIGINT, ChapterTimeStart STRING, ChapterTimeEnd STRING,
  ChapterDisplay STRUCT<ChapterString: STRING, ChapterLanguage: STRING>
"""

CHAPTER_DOCUMENT = """
  EditionEntry ARRAY<STRUCT<ChapterAtom: ARRAY<STRUCT<
    ChapterUID: STRING, ChapterTimeStart: STRING, ChapterTimeEnd: STRING,
    ChapterDisplay: STRUCT<ChapterString: STRING, ChapterLanguage: STRING>>>>>,
  _corrupt_record STRING
"""

FRAMES = "video_id BIGINT, frame_idx BIGINT, flag STRING"

TICKS = """
  host BIGINT, tick_id BIGINT, tick_ms BIGINT, cpu_total BIGINT, cpu_idle BIGINT,
  gpu_pct BIGINT, cpu_free BIGINT, nvenc_free BIGINT
"""

STAGES = """
  run_id STRING, slot BIGINT, seq BIGINT, kind STRING, file STRING, stage STRING, detail STRING, level STRING
"""

EVENTS = "`@t` TIMESTAMP, `@l` STRING, `@mt` STRING, File STRING, Op STRING"

OPS = """
  video_id BIGINT, op STRING, alt_index INT, cpu INT, nvenc INT, nvdec INT, cuda INT,
  wait_ms BIGINT, hold_ms BIGINT, woken INT
"""

# Prior summaries: only what resume needs has to be present; the rest is carried along.
SUMMARY = """
  video_id STRING, input_path STRING, final_output_path STRING, final_cq INT, generated_utc TIMESTAMP,
  is_hdr BOOLEAN, is_marginal BOOLEAN, verify_passed BOOLEAN, fell_back BOOLEAN, _corrupt_record STRING
"""
