"""Every operator as a named query over the star-schema tables, with its SQL check.

Floating-point results are rounded to six digits on both sides, because engines add
up in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmetrics.functions import probe, rates, text
from reelmetrics.operators import (
    cadence, chapters, decisions, detection, logs, outcome, quality, ranges, sampling, search, stages, ticks, usage,
)
from reelmetrics.plans import flows
from reelmetrics.plans.checks import check
from reelmetrics.plans.views import view, view_over
from reelmetrics.settings import DEFAULTS
from reelmetrics.sources import documents, readers, writers
from reelmetrics.sources.folders import list_files, remove, scratch_folder
from reelmetrics.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


class Inputs:
    """The derived inputs of one data folder, as attributes (`inputs.v_frames`)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)


def query(sql: str, name: str | None = None):
    def register(build: Callable[[Inputs], DataFrame]):
        key = name or build.__name__
        QUERIES[key] = lambda spark, sf_dir: build(Inputs(spark, sf_dir))
        CHECKS[key] = check(sql)
        return build

    return register


def r(name: str) -> Column:
    return F.round(F.col(name).cast("double"), 6).alias(name)


def default_ranges(levels: DataFrame) -> DataFrame:
    low, high = DEFAULTS.uhd_range
    return levels.select("video_id").distinct().select("video_id", F.lit(low).alias("min_cq"), F.lit(high).alias("max_cq"))


# --- sources -----------------------------------------------------------------


@query("SELECT page_id, path, length FROM v_catalog WHERE length >= 10240 AND NOT starts_with(regexp_extract(path, '([^/]*)$', 1), '.')")
def catalog_scan(d: Inputs) -> DataFrame:
    return documents.catalog_order(documents.candidates(d.v_catalog))


@query("""
SELECT file_id, CAST(json_extract_string(doc, '$.format.duration') AS DOUBLE) AS duration_s,
 coalesce(TRY_CAST(json_extract_string(doc, '$.format.bit_rate') AS BIGINT), 0) AS bit_rate,
 CASE WHEN file_id % 3 <> 0 AND file_id % 2 = 0 THEN CAST(json_extract_string(doc, '$.streams[0].width') AS INTEGER) ELSE 0 END AS width,
 '?' AS codec, '?' AS rate_text FROM v_probe_json""")
def probe_parse(d: Inputs) -> DataFrame:
    stats = documents.output_stats(documents.parse_probe(d.v_probe_json))
    return stats.select("file_id", "duration_s", "bit_rate", "width", "codec", "rate_text")


@query("""
SELECT file_id, CAST(json_extract_string(doc, '$.format.duration') AS DOUBLE) AS duration_s, 'video' AS codec_type
FROM v_probe_json WHERE CAST(json_extract_string(doc, '$.format.duration') AS DOUBLE) > 1
 AND json_extract_string(doc, '$.streams[0].codec_type') = 'video' AND json_extract_string(doc, '$.streams[0].disposition.attached_pic') <> '1'""")
def usable_video(d: Inputs) -> DataFrame:
    return documents.usable_videos(documents.parse_probe(d.v_probe_json)).select("file_id", "duration_s", "codec_type")


@query("""
SELECT event_id % 10 AS video_id, CAST(floor(event_id / 10.0) AS BIGINT) AS frame_idx,
 CASE event_type WHEN 'view' THEN 'progressive' WHEN 'click' THEN 'tff' WHEN 'purchase' THEN 'bff' ELSE 'undetermined' END AS flag
FROM events WHERE event_type <> 'signup'""")
def frame_log_parse(d: Inputs) -> DataFrame:
    return documents.parse_frame_records(d.v_frame_records)


@query("""
SELECT o_orderkey AS video_id, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END AS progressive, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS tff,
 CASE WHEN o_orderkey % 3 <> 0 THEN CAST(7 AS BIGINT) END AS bff, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(1 AS BIGINT) END AS undetermined FROM orders""")
def totals_parse(d: Inputs) -> DataFrame:
    return documents.parse_totals(d.v_total_logs)


@query("""
SELECT doc_id, frame_idx, score FROM (
 SELECT p_partkey AS doc_id, 0 AS frame_idx, 90 + p_size % 10 + 0.5e0 AS score FROM part
 UNION ALL SELECT p_partkey, 1, 97.25e0 FROM part) s""")
def score_parse(d: Inputs) -> DataFrame:
    return documents.parse_scores(d.v_score_json)


@query("""
SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN (90 + p_size % 10 + 0.5e0 + 97.25e0) / 2 ELSE 96.5e0 END AS mean,
 0e0 AS harmonic_mean, least(90 + p_size % 10 + 0.5e0, 97.25e0) AS min, CAST(2 AS BIGINT) AS n FROM part""")
def pooled_parse(d: Inputs) -> DataFrame:
    return documents.parse_pooled(d.v_score_json)


@query("""
SELECT *, CASE WHEN max_cll > 0 THEN max_cll WHEN mastering_max_luminance > 0 THEN mastering_max_luminance ELSE 1000 END AS nominal_peak,
 CASE WHEN max_cll IS NOT NULL THEN 'max_cll' WHEN mastering_max_luminance IS NOT NULL THEN 'mastering_display' ELSE 'default' END AS peak_origin
FROM (SELECT p_partkey AS file_id, CASE p_partkey % 4 WHEN 2 THEN NULL WHEN 3 THEN 0 ELSE p_size * 20 END AS max_cll, CAST(NULL AS INTEGER) AS max_fall,
 CASE p_partkey % 3 WHEN 0 THEN p_size WHEN 1 THEN CAST(round_even(p_size + 0.5e0, 0) AS INTEGER) END AS mastering_max_luminance FROM part) h
WHERE max_cll IS NOT NULL OR mastering_max_luminance IS NOT NULL""")
def hdr_parse(d: Inputs) -> DataFrame:
    return documents.parse_hdr(d.v_hdr_json)


@query("""
SELECT disc_id, CAST(chapter_idx AS BIGINT) AS chapter_idx, uid, start_text, end_text, title, CAST(start_s AS DOUBLE) AS start_s, CAST(end_s AS DOUBLE) AS end_s FROM (
 SELECT o_orderkey AS disc_id, 0 AS chapter_idx, CAST(18446744073709551615 - CAST(o_orderkey AS HUGEINT) AS DECIMAL(20,0)) AS uid, '00:00:00' AS start_text, concat('00:0', o_custkey % 10, ':30.5') AS end_text, 'Opening' AS title,
  0e0 AS start_s, o_custkey % 10 * 60 + 30.5e0 AS end_s FROM orders
 UNION ALL SELECT o_orderkey, 1, CAST(o_orderkey + 1 AS DECIMAL(20,0)), concat('00:0', o_custkey % 10, ':30.5'), concat('01:1', o_orderkey % 10, ':10'), '',
  o_custkey % 10 * 60 + 30.5e0, 3600 + (10 + o_orderkey % 10) * 60 + 10e0 FROM orders) c WHERE disc_id % 13 > 1""")
def chapter_parse(d: Inputs) -> DataFrame:
    good, _ = chapters.add_times(documents.parse_chapters(d.v_chapter_xml))
    columns = ["disc_id", "chapter_idx", "uid", "start_text", "end_text", "title"]
    return good.select(*columns, F.col("start_s").cast("double"), F.col("end_s").cast("double"))


@query("""
SELECT o_orderkey AS disc_id, CASE o_orderkey % 13 WHEN 0 THEN 'document is not readable' ELSE 'document has no chapters' END AS reason
FROM orders WHERE o_orderkey % 13 < 2""")
def chapter_rejects(d: Inputs) -> DataFrame:
    return documents.chapter_rejects(d.v_chapter_xml).select("disc_id", "reason")


@query("""
SELECT event_id, CASE WHEN event_type = 'error' THEN 'Warning' ELSE 'Information' END AS level,
 CASE event_type WHEN 'view' THEN 'release' WHEN 'click' THEN 'acquire' ELSE 'message' END AS kind,
 concat('f', user_id) AS file, event_type AS op, CAST(event_id % 10 AS INTEGER) AS second, event_id % 1000 AS wait_ms, CAST(event_id % 4 AS INTEGER) AS cpu FROM events""")
def event_parse(d: Inputs) -> DataFrame:
    parsed = documents.parse_events(d.v_event_lines)
    return parsed.select(
        "event_id", "level", "kind", "file", "op", F.second("t").alias("second"),
        F.variant_get("props", "$.WaitMs", "bigint").alias("wait_ms"),
        F.variant_get("props", "$.Granted.Cpu", "int").alias("cpu"),
    )


@query("""
SELECT event_id AS tick_id, CAST(event_id % 101 AS INTEGER) AS gpu_pct, CASE WHEN event_type <> 'error' THEN CAST(event_id % 77 AS INTEGER) END AS mem_pct,
 CAST(event_id * 3 AS INTEGER) AS vram_mb, CASE WHEN event_type <> 'view' THEN CAST(event_id % 5 AS INTEGER) END AS nvenc_sessions FROM events""")
def gpu_csv_parse(d: Inputs) -> DataFrame:
    return documents.parse_gpu_csv(d.v_gpu_lines)


@query("""
SELECT event_id AS tick_id, event_id * 3 + event_id % 7 + 3 + CASE WHEN event_type = 'view' THEN 0 ELSE 12 END AS cpu_total,
 event_id * 2 + event_id % 7 AS cpu_idle FROM events""")
def cpu_line_parse(d: Inputs) -> DataFrame:
    return documents.parse_cpu_line(d.v_cpu_lines)


# --- scalars and features ------------------------------------------------------


@query("""
SELECT page_id, regexp_replace(regexp_replace(regexp_extract(path, '([^/\\\\]*)$', 1), '\\.[^.]*$', ''), '[^\\p{L}\\p{Nd}._-]', '_', 'g') AS video_id FROM v_catalog""")
def safe_id(d: Inputs) -> DataFrame:
    return d.v_catalog.select("page_id", text.safe_id(text.file_stem(F.col("path"))).alias("video_id"))


@query("SELECT file_id, CAST(num AS INTEGER) AS num, CAST(den AS INTEGER) AS den, round(fps, 6) AS fps, rate_text, is_ntsc, is_ntsc30, is_cfr FROM probe_rates", name="rates")
def rate_features(d: Inputs) -> DataFrame:
    rows = rates.add_rates(d.v_probe)
    return rows.select(
        "file_id", "rate.num", "rate.den", r("fps"), "rate_text", "is_ntsc", "is_ntsc30", "is_cfr"
    )


@query("""
SELECT file_id, coalesce(lower(color_transfer) IN ('smpte2084', 'arib-std-b67'), false) AS is_hdr,
 CASE WHEN pix_fmt LIKE '%12%' THEN 12 WHEN pix_fmt LIKE '%10%' THEN 10 ELSE 8 END AS bit_depth,
 CASE WHEN pix_fmt LIKE '%12%' OR pix_fmt LIKE '%10%' THEN 'p010le' ELSE 'nv12' END AS encode_format,
 CASE WHEN pix_fmt LIKE '%12%' OR pix_fmt LIKE '%10%' THEN 'yuv420p10le' ELSE 'yuv420p' END AS compare_format,
 CASE WHEN coalesce(width, 0) >= 3840 OR coalesce(height, 0) >= 2160 THEN 'vmaf_4k_v0.6.1' ELSE 'vmaf_v0.6.1' END AS score_model FROM v_probe""")
def probe_features(d: Inputs) -> DataFrame:
    rows = probe.add_features(d.v_probe)
    return rows.select("file_id", "is_hdr", "bit_depth", "encode_format", "compare_format", "score_model")


@query("""
SELECT file_id, tier, CASE tier WHEN 'UHD' THEN 25 WHEN '1080p' THEN 28 WHEN '720p' THEN 32 ELSE 38 END AS min_cq,
 CASE tier WHEN 'UHD' THEN 55 WHEN '1080p' THEN 58 WHEN '720p' THEN 62 ELSE 63 END AS max_cq FROM (
 SELECT file_id, CASE WHEN coalesce(width, 0) >= 3840 OR coalesce(height, 0) >= 2160 THEN 'UHD' WHEN coalesce(width, 0) >= 1920 OR coalesce(height, 0) >= 1080 THEN '1080p'
  WHEN coalesce(width, 0) >= 1280 OR coalesce(height, 0) >= 720 THEN '720p' ELSE 'SD' END AS tier FROM v_probe) t""")
def cq_tier(d: Inputs) -> DataFrame:
    return probe.add_features(d.v_probe).select("file_id", "search.tier", "search.min_cq", "search.max_cq")


@query("""
SELECT file_id, r.tier, r.min_cq, r.max_cq FROM v_probe LEFT JOIN LATERAL (
 SELECT * FROM v_rules WHERE (coalesce(width, 0) >= min_width OR coalesce(height, 0) >= min_height) AND min_cq BETWEEN 0 AND 63 AND min_cq <= max_cq ORDER BY rank LIMIT 1) r ON true""")
def tier_rules(d: Inputs) -> DataFrame:
    """Tiers from a table of overlapping rules."""
    return probe.tiers_by_rules(d.v_probe, d.v_rules)


@query("SELECT rank, tier, CASE WHEN min_cq > 63 THEN 'min_cq outside 0..63' ELSE 'min_cq above max_cq' END AS problem FROM v_rules WHERE min_cq > 63 OR min_cq > max_cq")
def tier_rule_rejects(d: Inputs) -> DataFrame:
    return probe.split_rules(d.v_rules)[1].select("rank", "tier", "problem")


@query("""
SELECT video_id, min_cq, max_cq, CASE WHEN min_cq NOT BETWEEN 0 AND 63 THEN 'min_cq outside 0..63' WHEN max_cq NOT BETWEEN 0 AND 63 THEN 'max_cq outside 0..63'
 ELSE 'min_cq above max_cq' END AS problem FROM v_ranges WHERE min_cq NOT BETWEEN 0 AND 63 OR max_cq NOT BETWEEN 0 AND 63 OR min_cq > max_cq""")
def range_rejects(d: Inputs) -> DataFrame:
    rows = d.v_ranges.withColumn("problem", probe.range_problem(F.col("min_cq"), F.col("max_cq")))
    return rows.where(F.col("problem").isNotNull())


# --- detection -----------------------------------------------------------------


@query("""
SELECT video_id, progressive, tff, bff, interlaced, undetermined, total, round(progressive_fraction, 6) AS progressive_fraction,
 round(undetermined_share, 6) AS undetermined_share, undetermined_share > 0.02e0 AS undetermined_high FROM metrics""")
def frame_counts(d: Inputs) -> DataFrame:
    return cadence.frame_counts(d.v_frames).select(
        "video_id", "progressive", "tff", "bff", "interlaced", "undetermined", "total",
        r("progressive_fraction"), r("undetermined_share"), "undetermined_high",
    )


@query("SELECT video_id, total, round(cadence_rate, 6) AS cadence_rate, round(i_in_cadence, 6) AS i_in_cadence FROM metrics", name="cadence")
def frame_cadence(d: Inputs) -> DataFrame:
    return cadence.frame_metrics(d.v_frames).select("video_id", "total", r("cadence_rate"), r("i_in_cadence"))


@query("""
SELECT CAST(video_id AS INTEGER) AS video_id, probe_parity, parity, from_ntsc, probe_parity <> 'auto' AND parity <> 'auto' AND probe_parity <> parity AS parity_mismatch FROM paritied""")
def parity(d: Inputs) -> DataFrame:
    counts = cadence.frame_counts(d.v_frames)
    rows = detection.add_parity(rates.add_rates(d.v_video).join(counts, "video_id"))
    return rows.select("video_id", "probe_parity", "parity", "from_ntsc", "parity_mismatch")


@query("""
SELECT m.video_id, coalesce(abs(m.progressive - t.progressive) <= 1 AND abs(m.tff - t.tff) <= 1 AND abs(m.bff - t.bff) <= 1
 AND abs(m.undetermined - t.undetermined) <= 1, true) AS totals_agree FROM metrics m LEFT JOIN v_totals t USING (video_id)""")
def reconcile(d: Inputs) -> DataFrame:
    return detection.reconcile(cadence.frame_counts(d.v_frames), d.v_totals).select("video_id", "totals_agree")


@query("""
SELECT CAST(video_id AS INTEGER) AS video_id, progressive, interlaced, tff, round(cadence_rate, 6) AS cadence_rate, round(i_in_cadence, 6) AS i_in_cadence,
 parity_mismatch, content_type, round(confidence, 6) AS confidence, branch FROM classed""")
def classify(d: Inputs) -> DataFrame:
    return detection.detect(d.v_frames, d.v_video).select(
        "video_id", "progressive", "interlaced", "tff", r("cadence_rate"), r("i_in_cadence"),
        "parity_mismatch", "content_type", r("confidence"), "branch",
    )


@query("SELECT CAST(video_id AS INTEGER) AS video_id, content_type, plan_mode AS mode, filter_graph, out_num, out_den FROM restored")
def restore_plan(d: Inputs) -> DataFrame:
    planned = detection.add_restore(detection.detect(d.v_frames, d.v_video.drop("mode")))
    return planned.select("video_id", "content_type", "mode", "filter_graph", "out_num", "out_den")


# --- quality, selection, search --------------------------------------------------


@query("""
SELECT video_id, cq, round(mean, 6) AS mean, round(harmonic, 6) AS harmonic, round(p05, 6) AS p05, round(p01, 6) AS p01, round(min, 6) AS min, n FROM levels""")
def level_stats(d: Inputs) -> DataFrame:
    stats = quality.level_stats(d.v_scores)
    return stats.select("video_id", "cq", r("mean"), r("harmonic"), r("p05"), r("p01"), r("min"), "n")


@query("""
SELECT video_id, cq, mean_ok, p05_ok, p01_ok, passed, concat_ws(',', CASE WHEN NOT mean_ok THEN 'mean' END, CASE WHEN NOT p05_ok THEN 'p05' END,
 CASE WHEN NOT p01_ok THEN 'p01' END) AS missed FROM gated""")
def gates(d: Inputs) -> DataFrame:
    judged = quality.gates(quality.level_stats(d.v_scores))
    return judged.select(
        "video_id", "cq", "mean_ok", "p05_ok", "p01_ok", "passed", F.concat_ws(",", "missed").alias("missed")
    )


@query("""
SELECT video_id, cq, sample_idx, mean, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY video_id, cq ORDER BY mean, sample_idx) AS rank
 FROM (SELECT video_id, cq, sample_idx, round(avg(score), 9) AS mean, count(*) AS n FROM v_scores WHERE score IS NOT NULL GROUP BY video_id, cq, sample_idx) s) t WHERE rank <= 3""")
def sample_outliers(d: Inputs) -> DataFrame:
    worst = quality.sample_outliers(d.v_scores)
    return worst.select("video_id", "cq", "sample_idx", F.round("mean", 9).alias("mean"), "n", "rank")


@query("SELECT video_id, cq, fell_short, round(mean, 6) AS mean, round(p05, 6) AS p05, round(p01, 6) AS p01, n FROM picked")
def select_level(d: Inputs) -> DataFrame:
    chosen = quality.select_level(quality.level_stats(d.v_scores))
    return chosen.select("video_id", "cq", "fell_short", r("mean"), r("p05"), r("p01"), "n")


@query("""
SELECT p.video_id, p.cq, is_marginal, near, CASE WHEN is_marginal AND NOT fell_short THEN a.cq END AS above_cq, CASE WHEN is_marginal AND NOT fell_short THEN round(a.mean, 6) END AS above_mean,
 CASE WHEN is_marginal AND NOT fell_short THEN b.cq END AS below_cq
FROM (SELECT *, fell_short OR near > 0 AS is_marginal FROM (SELECT *, CASE WHEN fell_short THEN 1 ELSE
  CASE WHEN abs(mean - 97) < 0.5e0 THEN 1 ELSE 0 END + CASE WHEN abs(p05 - 95) < 0.5e0 THEN 1 ELSE 0 END + CASE WHEN abs(p01 - 90) < 0.5e0 THEN 1 ELSE 0 END END AS near FROM picked) q) p
LEFT JOIN gated a ON a.video_id = p.video_id AND a.cq = p.cq + 1 LEFT JOIN gated b ON b.video_id = p.video_id AND b.cq = p.cq - 1""")
def marginal(d: Inputs) -> DataFrame:
    levels = quality.add_neighbours(quality.level_stats(d.v_scores))
    rows = quality.add_marginal(quality.select_level(levels))
    return rows.select(
        "video_id", "cq", "is_marginal", F.size("marginal_reasons").alias("near"),
        F.col("above.cq").alias("above_cq"), F.round("above.mean", 6).alias("above_mean"),
        F.col("below.cq").alias("below_cq"),
    )


@query("""
SELECT video_id, cq, CASE WHEN NOT odd THEN round(coalesce(avg, 0), 9) END AS mean, CASE WHEN NOT odd THEN round(p05, 6) END AS p05, CASE WHEN NOT odd THEN round(p01, 6) END AS p01,
 CASE WHEN NOT odd THEN round(coalesce(low, 0), 6) END AS min, n FROM (
 SELECT video_id, cq, avg(score) AS avg, quantile_disc(score, 0.05) AS p05, quantile_disc(score, 0.01) AS p01, min(score) AS low, count(score) AS n, coalesce(bool_or(isnan(score)), false) AS odd FROM v_scores GROUP BY video_id, cq) s""")
def level_sketches(d: Inputs) -> DataFrame:
    """Statistics from sketches made part by part, here by sample."""
    parts = quality.score_sketches(d.v_scores, ["sample_idx"])
    # Sums of quarters and the like often end in a 5 at the seventh digit.
    return quality.merged_sketches(parts).select("video_id", "cq", F.round("mean", 9).alias("mean"), *[r(c) for c in ("p05", "p01", "min")], "n")


@query("""
SELECT video_id, best AS best_cq, step AS probes, CAST(ceil(log2(55 - 25 + 2)) AS INTEGER) AS expected_probes FROM search WHERE lo > hi""")
def bisect_level(d: Inputs) -> DataFrame:
    levels = quality.level_stats(d.v_scores)
    return search.bisect(levels, default_ranges(levels)).select("video_id", "best_cq", "probes", "expected_probes")


@query("""
SELECT video_id, cq, n, CASE WHEN cq IS NULL THEN 'level is missing' ELSE 'level is outside 0..63' END AS reason FROM (
 SELECT video_id, nullif(cq * 2, 60) AS cq, n FROM levels) l WHERE cq IS NULL OR cq > 63""")
def level_rejects(d: Inputs) -> DataFrame:
    doubled = quality.level_stats(d.v_scores).withColumn("cq", F.nullif(F.col("cq") * 2, F.lit(60)))
    return search.level_rejects(doubled).select("video_id", "cq", "n", "reason")


@query("SELECT video_id, step, from_lo AS lo, from_hi AS hi, cq, passed FROM search WHERE step > 0")
def bisect_trace(d: Inputs) -> DataFrame:
    levels = quality.level_stats(d.v_scores)
    return search.bisect_trace(levels, default_ranges(levels)).drop("measured")


@query("SELECT video_id, step, from_lo AS lo, from_hi AS hi, cq, passed FROM search WHERE step > 0")
def search_on_demand(d: Inputs) -> DataFrame:
    """The same search with levels measured when they are asked for, all videos one step a round."""
    scores = d.v_scores
    low, high = DEFAULTS.uhd_range
    ranges = scores.select("video_id").distinct().select("video_id", F.lit(low).alias("min_cq"), F.lit(high).alias("max_cq"))
    _, trace = search.search_levels(ranges, lambda asked: scores.join(asked, ["video_id", "cq"]))
    return trace.select("video_id", "step", "lo", "hi", "cq", F.coalesce("passed", F.lit(False)).alias("passed"))


@query("SELECT video_id, CAST(i AS INTEGER) AS sample_idx, round(start_s, 6) AS start_s, round(length_s, 6) AS length_s FROM drawn")
def sample_windows(d: Inputs) -> DataFrame:
    drawn = sampling.sample_windows(d.v_durations, uniform=sampling.modular_uniform)
    return drawn.select("video_id", "sample_idx", r("start_s"), r("length_s"))


@query("SELECT video_id, count(*) AS windows, true AS inside, true AS apart, true AS one_a_stratum FROM drawn GROUP BY video_id")
def sample_rules(d: Inputs) -> DataFrame:
    """What the default generator must keep, whatever it draws: windows inside the video, apart, one beginning in each stratum."""
    drawn = sampling.sample_windows(d.v_durations)
    spans = F.array_sort(F.collect_list(F.struct("sample_idx", "start_s", "length_s")))  # at most 16 windows a video
    videos = drawn.join(d.v_durations, "video_id").groupBy("video_id").agg(spans.alias("w"), F.max("duration_s").alias("duration_s"))
    stratum = F.col("duration_s") / F.size("w")
    slack = 1e-6
    return videos.select(
        "video_id", F.size("w").cast("bigint").alias("windows"),
        F.forall("w", lambda x: (x["start_s"] >= 0) & (x["start_s"] + x["length_s"] <= F.col("duration_s") + slack)).alias("inside"),
        F.forall(F.sequence(F.lit(1), F.size("w")), lambda i: F.coalesce(F.get("w", i)["start_s"] + slack >= F.get("w", i - 1)["start_s"] + F.get("w", i - 1)["length_s"], F.lit(True))).alias("apart"),
        F.forall("w", lambda x: (x["start_s"] + slack >= x["sample_idx"] * stratum) & (x["start_s"] <= (x["sample_idx"] + 1) * stratum + slack)).alias("one_a_stratum"),
    )


@query("""
SELECT video_id, count(*) AS windows, round(sum(length_s), 6) AS covered_s, round(sum(length_s) / any_value(duration_s) * 100, 6) AS covered_pct
FROM drawn GROUP BY video_id""")
def sample_coverage(d: Inputs) -> DataFrame:
    windows = sampling.sample_windows(d.v_durations, uniform=sampling.modular_uniform)
    covered = sampling.sample_coverage(windows, d.v_durations)
    return covered.select("video_id", "windows", r("covered_s"), r("covered_pct"))


_SPANS = """
SELECT w.video_id, i AS sample_idx, ceil(start_s * fps) AS first_frame, ceil((start_s + length_s) * fps) - 1 AS last_frame FROM (
 SELECT video_id, i, i * (total / r.fps / 3) AS start_s, CASE WHEN video_id % 2 = 0 THEN 1e0 ELSE 0.5e0 END AS length_s, r.fps AS fps
 FROM (SELECT m.video_id, m.total, unnest(range(3)) AS i FROM metrics m) v JOIN video_rates r USING (video_id)) w"""


@query(f"""
SELECT f.video_id, CAST(s.sample_idx AS INTEGER) AS sample_idx, f.frame_idx, f.flag FROM v_frames f JOIN ({_SPANS}) s
 ON f.video_id = s.video_id AND f.frame_idx BETWEEN s.first_frame AND s.last_frame""")
def window_frames(d: Inputs) -> DataFrame:
    streams = d.v_video.select("video_id", "r_frame_rate", "avg_frame_rate")
    totals = rates.add_rates(streams).select("video_id", "fps").join(cadence.frame_counts(d.v_frames), "video_id")
    windows = totals.select("video_id", "total", "fps", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("sample_idx")).select(
        "video_id", "sample_idx",
        (F.col("sample_idx") * (F.col("total") / F.col("fps") / 3)).alias("start_s"),
        F.when(F.col("video_id") % 2 == 0, 1.0).otherwise(0.5).alias("length_s"),
    )
    return ranges.window_frames(d.v_frames, ranges.frame_ranges(windows, streams)).select(
        "video_id", "sample_idx", "frame_idx", "flag"
    )


# --- chapters ------------------------------------------------------------------


@query("""
SELECT disc_id, chapter_idx + 1 AS number, '(untitled)' AS title, start_s, end_s, duration_s, is_main FROM flagged""")
def chapter_report(d: Inputs) -> DataFrame:
    return chapters.chapter_report(d.v_chapters)


@query("SELECT disc_id, count(*) FILTER (is_main) AS main_chapters, count(*) AS chapters FROM flagged GROUP BY disc_id")
def chapter_counts(d: Inputs) -> DataFrame:
    return chapters.chapter_counts(d.v_chapters)


@query("SELECT disc_id, nth, start_idx, end_idx, is_tail FROM good_ranges")
def episodes(d: Inputs) -> DataFrame:
    return chapters.episodes(d.v_chapters)


@query("""
SELECT g.disc_id, g.nth AS episode, start_idx, end_idx, a.start_s AS cut_start, b.end_s AS cut_end, printf('Show - S02E%02d.mkv', g.nth) AS file_name
FROM good_ranges g JOIN v_chapters a ON a.disc_id = g.disc_id AND a.chapter_idx = start_idx JOIN v_chapters b ON b.disc_id = g.disc_id AND b.chapter_idx = end_idx""")
def episode_manifest(d: Inputs) -> DataFrame:
    return chapters.episode_manifest(d.v_chapters, "Show", season=2)


@query("""
SELECT c.disc_id, c.chapter_idx, g.nth AS episode, c.chapter_idx - start_idx + 1 AS number, concat('Chapter ', c.chapter_idx - start_idx + 1) AS label, 'en' AS label_language
FROM v_chapters c JOIN good_ranges g ON g.disc_id = c.disc_id AND c.chapter_idx BETWEEN start_idx AND end_idx""")
def episode_chapters(d: Inputs) -> DataFrame:
    rows = chapters.episode_chapters(d.v_chapters)
    return rows.select("disc_id", "chapter_idx", "episode", "number", "label", "label_language")


# --- usage, samples, progress ----------------------------------------------------


@query("""
SELECT *, round(100e0 * wall_ms / total_ms, 6) AS total_pct FROM (SELECT video_id, phase, e - b AS wall_ms, queue_ms, run_ms, ops,
 max(e) OVER (PARTITION BY video_id) - min(b) OVER (PARTITION BY video_id) AS total_ms
 FROM (SELECT video_id, phase, min(start_ms - wait_ms) AS b, max(start_ms + hold_ms) AS e, CAST(sum(wait_ms) AS BIGINT) AS queue_ms, CAST(sum(hold_ms) AS BIGINT) AS run_ms, count(*) AS ops
  FROM phased GROUP BY video_id, phase) p) q""")
def time_card(d: Inputs) -> DataFrame:
    card = usage.time_card(d.v_ops)
    return card.select("video_id", "phase", "wall_ms", "queue_ms", "run_ms", "ops", "total_ms", r("total_pct"))


@query("""
SELECT video_id, regexp_replace(op, '\\.cq[0-9]+$', '') AS op, TRY_CAST(regexp_extract(op, '\\.cq([0-9]+)$', 1) AS INTEGER) AS cq, count(*) AS n,
 round(avg(wait_ms), 6) AS wait_avg, max(wait_ms) AS wait_max, CAST(sum(wait_ms) AS BIGINT) AS wait_sum, round(avg(hold_ms), 6) AS hold_avg, max(hold_ms) AS hold_max,
 CAST(sum(hold_ms) AS BIGINT) AS hold_sum, count(*) FILTER (alt_index > 0) AS fallbacks FROM v_level_ops GROUP BY ALL""")
def op_stats(d: Inputs) -> DataFrame:
    s = usage.op_stats(d.v_level_ops)
    return s.select(*[r(c) if c.endswith("_avg") else c for c in s.columns])


@query("""
SELECT video_id, CAST(sum(cpu_ms) AS BIGINT) AS cpu_ms, CAST(sum(nvenc_ms) AS BIGINT) AS nvenc_ms, CAST(sum(nvdec_ms) AS BIGINT) AS nvdec_ms,
 CAST(sum(cuda_ms) AS BIGINT) AS cuda_ms FROM shares GROUP BY ROLLUP (video_id)""")
def resource_share(d: Inputs) -> DataFrame:
    return usage.resource_totals(usage.resource_share(d.v_ops))


@query("""
SELECT run_id, video_id, CASE GROUPING_ID(run_id, video_id) WHEN 0 THEN 'video' WHEN 1 THEN 'run' ELSE 'total' END AS grain, CAST(sum(cpu * hold_ms) AS BIGINT) AS cpu_ms, CAST(sum(nvenc * hold_ms) AS BIGINT) AS nvenc_ms,
 CAST(sum(nvdec * hold_ms) AS BIGINT) AS nvdec_ms, CAST(sum(cuda * hold_ms) AS BIGINT) AS cuda_ms, count(*) AS ops
FROM (SELECT nullif(start_ms / 1000 % 4, 3) AS run_id, nullif(video_id % 50, 49) AS video_id, cpu, nvenc, nvdec, cuda, hold_ms FROM (SELECT * REPLACE (start_ms // 1000 * 1000 AS start_ms) FROM v_ops) o) k GROUP BY ROLLUP (run_id, video_id)""")
def resource_rollup(d: Inputs) -> DataFrame:
    """Videos, runs and all in one pass; some runs and videos have no name."""
    run, video = F.expr("nullif(start_ms / 1000 % 4, 3)"), F.expr("nullif(video_id % 50, 49)")
    return usage.resource_rollup(d.v_ops.withColumns({"run_id": run, "video_id": video}))


@query("""
SELECT resource, CAST(least(rank, 6) AS INTEGER) AS rank, CASE WHEN rank <= 5 THEN CAST(min(video_id) AS VARCHAR) ELSE 'others' END AS video, count(*) AS videos, CAST(sum(ms) AS BIGINT) AS ms,
 round(100e0 * sum(ms) / any_value(total), 6) AS pct FROM share_rows GROUP BY resource, least(rank, 6), rank <= 5""")
def resource_top(d: Inputs) -> DataFrame:
    top = usage.resource_top(usage.resource_share(d.v_ops))
    return top.select("resource", "rank", "video", "videos", "ms", r("pct"))


@query("""
SELECT video_id, CAST(rank AS INTEGER) AS rank, wait_ms FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY wait_ms DESC, start_ms, op, hold_ms, cpu) AS rank
 FROM v_ops WHERE wait_ms > 0) w WHERE rank <= 3""")
def top_waits(d: Inputs) -> DataFrame:
    return usage.top_waits(d.v_ops).select("video_id", "rank", "wait_ms")


@query("""
SELECT video_id, op, start_ms, wait_ms, hold_ms, 'acquire' AS event FROM v_ops WHERE wait_ms > 0
UNION ALL SELECT video_id, op, start_ms, wait_ms, hold_ms, 'release' FROM v_ops WHERE woken > 0 OR hold_ms >= 30000""")
def event_thinning(d: Inputs) -> DataFrame:
    return usage.thin_events(d.v_ops).select("video_id", "op", "start_ms", "wait_ms", "hold_ms", "event")


def _host_ops(d: Inputs) -> DataFrame:
    """Ops with the host that ran them; some hosts are unknown, as among the ticks."""
    return d.v_ops.withColumn("host", F.nullif(F.col("video_id") % 4, F.lit(3)))


@query("""
SELECT t.tick_id, o.video_id, o.op, o.start_ms FROM v_ticks t JOIN v_ops o ON t.host IS NOT DISTINCT FROM nullif(o.video_id % 4, 3) AND t.tick_ms >= o.start_ms AND t.tick_ms < o.start_ms + o.hold_ms""")
def held_ops(d: Inputs) -> DataFrame:
    found = ranges.held_ops(d.v_ticks.select("host", "tick_id", "tick_ms"), _host_ops(d), ["host"])
    return found.select("tick_id", "video_id", "op", "start_ms")


@query("""
SELECT t.tick_id, count(o.op) AS held_ops, CAST(coalesce(sum(o.cpu), 0) AS BIGINT) AS held_cpu, CAST(coalesce(sum(o.nvenc), 0) AS BIGINT) AS held_nvenc, CAST(coalesce(sum(o.nvdec), 0) AS BIGINT) AS held_nvdec,
 CAST(coalesce(sum(o.cuda), 0) AS BIGINT) AS held_cuda FROM v_ticks t LEFT JOIN v_ops o ON t.host IS NOT DISTINCT FROM nullif(o.video_id % 4, 3) AND t.tick_ms >= o.start_ms AND t.tick_ms < o.start_ms + o.hold_ms GROUP BY t.tick_id""")
def held_load(d: Inputs) -> DataFrame:
    load = ranges.held_load(d.v_ticks.select("host", "tick_id", "tick_ms"), _host_ops(d), ["host"])
    return load.drop("host", "tick_ms")


@query("SELECT host, tick_id, round(cpu_pct, 6) AS cpu_pct FROM cpu_ticks")
def cpu_pct(d: Inputs) -> DataFrame:
    return ticks.cpu_pct(d.v_ticks).select("host", "tick_id", r("cpu_pct"))


_SUMMARY = """
 samples, round(100e0 * (20 - cpu_free_sum / samples) / 20, 6) AS cpu_busy_pct, cpu_free_min, round(100e0 * (4 - nvenc_free_sum / samples) / 4, 6) AS nvenc_busy_pct,
 nvenc_free_min, round(cpu_pct_sum / samples, 6) AS cpu_pct_avg, round(cpu_pct_max, 6) AS cpu_pct_max, round(gpu_pct_sum / nullif(gpu_pct_n, 0), 6) AS gpu_pct_avg, gpu_pct_max"""
_PARTIAL = """
 count(*) AS samples, sum(cpu_free) AS cpu_free_sum, min(cpu_free) AS cpu_free_min, sum(nvenc_free) AS nvenc_free_sum, min(nvenc_free) AS nvenc_free_min,
 sum(cpu_pct) AS cpu_pct_sum, max(cpu_pct) AS cpu_pct_max, sum(gpu_pct) AS gpu_pct_sum, count(gpu_pct) AS gpu_pct_n, max(gpu_pct) AS gpu_pct_max"""


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select(*[r(c) if c.endswith(("_avg", "_busy_pct")) or c == "cpu_pct_max" else c for c in rows.columns])


@query(f"SELECT host, {_SUMMARY} FROM (SELECT host, {_PARTIAL} FROM cpu_ticks GROUP BY host) p")
def pool_busy(d: Inputs) -> DataFrame:
    return _rounded(ticks.tick_summary(ticks.cpu_pct(d.v_ticks)))


@query(f"""
SELECT host, (bucket + 1) * 300000 AS until_ms, {_SUMMARY} FROM (
 SELECT host, bucket, CAST(sum(samples) OVER w AS BIGINT) AS samples, sum(cpu_free_sum) OVER w AS cpu_free_sum, min(cpu_free_min) OVER w AS cpu_free_min, sum(nvenc_free_sum) OVER w AS nvenc_free_sum,
  min(nvenc_free_min) OVER w AS nvenc_free_min, sum(cpu_pct_sum) OVER w AS cpu_pct_sum, max(cpu_pct_max) OVER w AS cpu_pct_max, sum(gpu_pct_sum) OVER w AS gpu_pct_sum,
  sum(gpu_pct_n) OVER w AS gpu_pct_n, max(gpu_pct_max) OVER w AS gpu_pct_max
 FROM (SELECT host, tick_ms // 300000 AS bucket, {_PARTIAL} FROM cpu_ticks GROUP BY host, tick_ms // 300000) p
 WINDOW w AS (PARTITION BY host ORDER BY bucket ROWS UNBOUNDED PRECEDING)) q""")
def checkpoints(d: Inputs) -> DataFrame:
    return _rounded(ticks.checkpoints(ticks.cpu_pct(d.v_ticks)))


@query(f"""
SELECT minute, concat_ws(',', CASE WHEN cpu_busy_pct >= 75 AND cpu_pct_avg <= 30 THEN 'cpu_underused' END) AS hints
FROM (SELECT minute, {_SUMMARY} FROM (SELECT tick_ms // 6000 AS minute, {_PARTIAL} FROM cpu_ticks GROUP BY tick_ms // 6000) p) q""")
def util_hints(d: Inputs) -> DataFrame:
    rows = ticks.cpu_pct(d.v_ticks).withColumn("minute", F.floor(F.col("tick_ms") / 6000))
    hinted = ticks.util_hints(ticks.tick_summary(rows, ["minute"]))
    return hinted.select("minute", F.concat_ws(",", "hints").alias("hints"))


_ALL_POOLS = """
SELECT minute, concat_ws(',', CASE WHEN cpu_busy >= 75 AND cpu_pct <= 30 THEN 'cpu_underused' END, CASE WHEN nvenc_busy >= 75 AND sessions * 100e0 / 4 <= 30 THEN 'nvenc_underused' END,
 CASE WHEN nvdec_busy >= 75 AND gpu_pct <= 30 THEN 'nvdec_underused' END, CASE WHEN cuda_busy >= 75 AND gpu_pct <= 30 THEN 'cuda_underused' END, CASE WHEN 16000 - vram < 1024 THEN 'vram_near_limit' END) AS hints
FROM (SELECT event_id // 7 AS minute, (20 - avg(event_id % 7)) * 100e0 / 20 AS cpu_busy, (4 - avg(event_id % 3)) * 100e0 / 4 AS nvenc_busy, (4 - avg(event_id % 2)) * 100e0 / 4 AS nvdec_busy,
  (4 - avg(event_id % 4 // 2)) * 100e0 / 4 AS cuda_busy, avg(floor(value) % 60) AS cpu_pct, avg(event_id % 5 % 3) AS sessions, avg(CASE WHEN event_type <> 'error' THEN floor(value) % 45 END) AS gpu_pct,
  max(14000 + event_id * 31 % 1500) AS vram FROM events GROUP BY event_id // 7) p"""


@query(_ALL_POOLS)
def util_hints_all(d: Inputs) -> DataFrame:
    """Every hint there is, from samples that report every pool and gauge."""
    rows = d.v_events.select(
        F.expr("event_id div 7").alias("minute"), (F.col("event_id") % 7).alias("cpu_free"), (F.col("event_id") % 3).alias("nvenc_free"),
        (F.col("event_id") % 2).alias("nvdec_free"), F.expr("event_id % 4 div 2").alias("cuda_free"), (F.floor("value") % 60).alias("cpu_pct"),
        (F.col("event_id") % 5 % 3).alias("nvenc_sessions"), F.when(F.col("event_type") != "error", F.floor("value") % 45).alias("gpu_pct"),
        (14000 + F.col("event_id") * 31 % 1500).alias("vram_mb"),
    )
    hinted = ticks.util_hints(ticks.tick_summary(rows, ["minute"]), vram_total_mb=16000)
    return hinted.select("minute", F.concat_ws(",", "hints").alias("hints"))


@query("""
SELECT slot, seq, stage, detail FROM (SELECT *, lag(stage) OVER (PARTITION BY slot ORDER BY seq) AS before FROM v_stages) s WHERE stage IS DISTINCT FROM before""")
def stage_changes(d: Inputs) -> DataFrame:
    return stages.stage_changes(d.v_stages)


@query("SELECT slot, max(seq) AS seq, arg_max(stage, seq) AS stage, arg_max(detail, seq) AS detail FROM v_stages GROUP BY slot")
def latest_stage(d: Inputs) -> DataFrame:
    return stages.latest_stage(d.v_stages)


@query("SELECT video_id, finished_at, status FROM v_completions ORDER BY finished_at DESC, video_id DESC LIMIT 8")
def recent(d: Inputs) -> DataFrame:
    return stages.recent(d.v_completions)


@query("""
SELECT video_id, CAST(idx - 1 AS INTEGER) AS line_no, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line FROM (
 SELECT video_id, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS idx FROM (SELECT video_id, string_split(log, chr(10)) AS parts FROM v_logs) p) l
WHERE contains(lower(line), 'license')""")
def log_warnings(d: Inputs) -> DataFrame:
    return logs.log_warnings(d.v_logs, "license")


@query("SELECT video_id, count(*) AS lines FROM (SELECT video_id, unnest(string_split(log, chr(10))) AS line FROM v_logs) l WHERE contains(lower(line), 'license') GROUP BY video_id")
def log_warning_counts(d: Inputs) -> DataFrame:
    return logs.log_warning_counts(d.v_logs, "license")


# --- outcomes ------------------------------------------------------------------


@query("""
SELECT video_id, mode, skipped, warnings = '' AS passed, warnings FROM verified""")
def verify_output(d: Inputs) -> DataFrame:
    ivtc = F.col("mode") == "ivtc"
    plans = d.v_video.select(
        "video_id", "mode", F.when(ivtc, rates.NTSC24[0]).alias("out_num"), F.when(ivtc, rates.NTSC24[1]).alias("out_den")
    )
    found = rates.add_rates(d.v_video).join(cadence.frame_metrics(d.v_frames), "video_id", "left")
    outputs = found.select("video_id", F.lit(True).alias("has_video"), "progressive_fraction", "cadence_rate", "fps")
    checked = outcome.verify_outputs(plans, outputs)
    return checked.select("video_id", "mode", "skipped", "passed", F.concat_ws(",", "warnings").alias("warnings"))


@query("""
SELECT video_id, outcome, outcome = 'fell_back' AS fell_back, CASE WHEN outcome = 'fell_back' THEN 'passthrough' ELSE 'encode' END AS output,
 CASE WHEN outcome IN ('kept', 'fell_back') THEN passthrough_bytes END AS passthrough_bytes,
 CASE WHEN encoded_bytes < input_bytes THEN round(100e0 * (1 - encoded_bytes / input_bytes), 6) END AS saved_pct,
 CASE WHEN encoded_bytes >= input_bytes THEN round(100e0 * (encoded_bytes / input_bytes - 1), 6) END AS bloat_pct FROM guarded""")
def size_guard(d: Inputs) -> DataFrame:
    g = outcome.size_guard(d.v_sizes)
    return g.select("video_id", "outcome", "fell_back", "output", "passthrough_bytes", r("saved_pct"), r("bloat_pct"))


@query("SELECT video_id, duration_s FROM v_durations WHERE video_id NOT IN (SELECT video_id FROM v_prior)")
def resume_filter(d: Inputs) -> DataFrame:
    return outcome.split_resumed(d.v_durations, d.v_prior)[0]


@query("""
SELECT count(*) AS videos, count(*) FILTER (error IS NULL) AS completed, count(*) FILTER (error IS NOT NULL) AS errored,
 count(*) FILTER (error IS NULL AND resumed) AS skipped, count(*) FILTER (error IS NULL AND is_marginal) AS marginal, count(*) FILTER (error IS NULL AND fell_back) AS passthrough,
 count(*) FILTER (level = 'ok') AS level_ok, count(*) FILTER (level = 'marginal') AS level_marginal, count(*) FILTER (level = 'passthrough') AS level_passthrough,
 count(*) FILTER (level = 'verify_failed') AS level_verify_failed
FROM (SELECT *, video_id % 5 = 0 AS resumed, CASE WHEN error IS NULL THEN CASE WHEN NOT verify_passed THEN 'verify_failed' WHEN fell_back THEN 'passthrough'
 WHEN is_marginal THEN 'marginal' ELSE 'ok' END END AS level FROM v_results) x""")
def run_outcomes(d: Inputs) -> DataFrame:
    results = d.v_results
    todo, done = outcome.split_resumed(results, results.join(d.v_prior, "video_id", "left_semi"))
    return outcome.run_outcomes(outcome.combine_results(done, todo))


def _summaries(d: Inputs) -> DataFrame:
    # Every video gets the UHD range here, as in the search queries.
    streams_ = d.v_video.drop("mode").withColumns(
        {
            "width": F.lit(3840), "height": F.lit(2160),
            "pix_fmt": F.lit("yuv420p10le"), "color_transfer": F.lit("bt709"),
        }
    )
    return flows.compress_summary(
        streams_, d.v_frames, d.v_scores, d.v_sizes.drop("mode"), totals=d.v_totals, ops=d.v_ops
    )


@query("SELECT CAST(video_id AS INTEGER) AS video_id, content_type, mode, final_cq, fell_short, outcome, level, cpu_ms, totals_agree FROM summarised")
def video_summary(d: Inputs) -> DataFrame:
    return _summaries(d).select(
        "video_id", "detection.content_type", "restore.mode", "final_cq", "tuning.fell_short", "size_guard.outcome",
        "level", "resource_share.cpu_ms", "detection.totals_agree",
    )


@query("""
SELECT CAST(video_id AS INTEGER) AS video_id, concat_ws(',', CASE WHEN undetermined_share > 0.02e0 THEN 'undetermined_high' END, CASE WHEN parity_mismatch THEN 'parity_mismatch' END,
 CASE WHEN NOT totals_agree THEN 'totals_disagree' END, CASE WHEN is_marginal THEN 'marginal' END, CASE WHEN outcome <> 'kept_smaller' THEN outcome END) AS warnings FROM summarised""")
def video_warnings(d: Inputs) -> DataFrame:
    found = decisions.video_warnings(_summaries(d))
    return found.select("video_id", F.concat_ws(",", F.transform("warnings", lambda w: w["code"])).alias("warnings"))


def _fleet(d: Inputs) -> DataFrame:
    """Summaries of one video per supplier, with everything in them from tables."""
    return flows.compress_summary(
        d.f_video, d.f_frames, d.f_scores, d.f_sizes, output_frames=d.f_out_frames, output_streams=d.f_out_video,
        totals=d.f_totals, hdr=d.f_hdr, ops=d.v_ops,
    )


FLEET_SUMMARY = """
SELECT video_id, tier, is_hdr, CAST(bit_depth AS INTEGER) AS bit_depth, max_cll, content_type, mode, final_cq, fell_short, outcome, verify_passed, level, cpu_ms, totals_agree FROM f_summarised"""


def _shown(summary: DataFrame) -> DataFrame:
    return summary.select(
        "video_id", "search.tier", "is_hdr", "bit_depth", "hdr.max_cll", "detection.content_type", "restore.mode", "final_cq", "tuning.fell_short",
        "size_guard.outcome", F.col("verification.passed").alias("verify_passed"), "level", "resource_share.cpu_ms", "detection.totals_agree",
    )


@query(FLEET_SUMMARY)
def fleet_summary(d: Inputs) -> DataFrame:
    return _shown(_fleet(d))


@query(FLEET_SUMMARY)
def fleet_summary_bucketed(d: Inputs) -> DataFrame:
    """The same from tables that are bucketed by video_id, without a shuffle above them."""
    names = {"streams": "f_video", "frames": "f_frames", "scores": "f_scores", "sizes": "f_sizes", "output_frames": "f_out_frames",
             "output_streams": "f_out_video", "totals": "f_totals", "hdr": "f_hdr", "ops": "v_ops"}
    buckets = int(d.spark.conf.get("spark.sql.shuffle.partitions"))
    tables = flows.bucket(d.spark, {k: getattr(d, v) for k, v in names.items()}, scratch_folder(d.spark, "fleet"), buckets)
    return _shown(flows.compress_summary(**tables))


@query("""
SELECT video_id, concat_ws(',', CASE WHEN undetermined_share > 0.02e0 THEN 'undetermined_high' END, CASE WHEN parity_mismatch THEN 'parity_mismatch' END,
 CASE WHEN NOT totals_agree THEN 'totals_disagree' END, CASE WHEN is_marginal THEN 'marginal' END, CASE WHEN outcome <> 'kept_smaller' THEN outcome END, nullif(found, '')) AS warnings FROM f_summarised""")
def fleet_warnings(d: Inputs) -> DataFrame:
    found = decisions.video_warnings(_fleet(d))
    return found.select("video_id", F.concat_ws(",", F.transform("warnings", lambda w: w["code"])).alias("warnings"))


# --- sinks: written, then read back ---


@query("SELECT path, CAST(octet_length(encode(html)) + 1 AS BIGINT) AS length FROM v_tree")
def catalog_walk(d: Inputs) -> DataFrame:
    """A folder tree is written and walked; every file of it comes out, whatever it is called."""
    folder = scratch_folder(d.spark, "tree")
    writers.write_documents(d.v_tree.select("path", F.lit(0).alias("line"), F.col("html").alias("text")), folder)
    found = list_files(d.spark, folder).withColumn("path", F.url_decode(F.regexp_replace("path", r"\\+", "%2B")))
    named = found.select(F.regexp_extract("path", r"/tree-[^/]*/(.*)$", 1).alias("path"), "length")
    return named.where("not startswith(path, '_manifest/')")


@query("""
SELECT c.disc_id, g.nth AS episode, c.chapter_idx - start_idx + 1 AS number, CAST(c.chapter_idx + 1 AS DECIMAL(20, 0)) AS uid, concat('Chapter ', c.chapter_idx - start_idx + 1) AS title, 'en' AS language,
 concat('01:02:', lpad(CAST(c.chapter_idx % 60 AS VARCHAR), 2, '0')) AS start_text
FROM v_chapters c JOIN good_ranges g ON g.disc_id = c.disc_id AND c.chapter_idx BETWEEN start_idx AND end_idx""")
def episode_documents(d: Inputs) -> DataFrame:
    """Every episode's chapter document, written and read back."""
    folder = scratch_folder(d.spark, "episodes")
    start = F.concat(F.lit("01:02:"), F.lpad((F.col("chapter_idx") % 60).cast("string"), 2, "0"))
    claimed = chapters.episode_chapters(d.v_chapters).withColumns({"uid": F.col("chapter_idx") + 1, "start_text": start, "end_text": F.lit("")})
    manifest = writers.write_episode_documents(claimed, folder)
    docs = readers.read_documents(manifest, folder).select(
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).cast("long").alias("disc_id"),
        F.regexp_extract("path", r"([^/]+)\.xml$", 1).cast("long").alias("episode"), "doc",
    )
    read = documents.parse_chapters(docs)
    return read.select("disc_id", "episode", (F.col("chapter_idx") + 1).alias("number"), "uid", "title", "language", "start_text")


@query("SELECT disc_id, chapter_idx - 2 AS chapter_idx, start_s, end_s FROM v_chapters WHERE chapter_idx >= 2")
def trim_chapters(d: Inputs) -> DataFrame:
    return chapters.trim_chapters(d.v_chapters, 3)


@query("""
SELECT CAST(video_id AS VARCHAR) AS video_id, CAST(25 + video_id % 31 AS INTEGER) AS final_cq, verify_passed, fell_back, is_marginal, CASE WHEN video_id % 2 = 0 THEN 'a' ELSE 'b' END AS run_id FROM v_results WHERE error IS NULL""")
def summary_roundtrip(d: Inputs) -> DataFrame:
    folder = scratch_folder(d.spark, "summaries")
    done = d.v_results.where("error is null").select(
        F.when(F.col("video_id") % 2 == 0, "a").otherwise("b").alias("run_id"), F.col("video_id").cast("string").alias("video_id"),
        (25 + F.col("video_id") % 31).cast("int").alias("final_cq"), "verify_passed", "fell_back", "is_marginal",
    )
    writers.write_summaries(done, folder)
    found = readers.read_summaries(d.spark, folder, multi_line=False)
    return found.select("video_id", "final_cq", "verify_passed", "fell_back", "is_marginal", F.regexp_extract(F.input_file_name(), r"run_id=(\w+)/", 1).alias("run_id"))


@query("""
SELECT CASE WHEN video_id % 2 = 0 THEN 'a' ELSE 'b' END AS run_id, concat('f', video_id % 50) AS file, event, count(*) AS n, CAST(sum(wait_ms) AS BIGINT) AS wait_ms FROM (
 SELECT video_id, wait_ms, 'acquire' AS event FROM v_ops WHERE wait_ms > 0 UNION ALL SELECT video_id, wait_ms, 'release' FROM v_ops WHERE woken > 0 OR hold_ms >= 30000) e GROUP BY ALL""")
def event_roundtrip(d: Inputs) -> DataFrame:
    folder = scratch_folder(d.spark, "events")
    run, file = F.when(F.col("video_id") % 2 == 0, "a").otherwise("b"), F.concat(F.lit("f"), F.col("video_id") % 50)
    events = usage.thin_events(d.v_ops).select(run.alias("run_id"), file.alias("file"), "event", "wait_ms")
    writers.write_events(events, folder, by_video=True)
    found = d.spark.read.schema("event string, wait_ms long, run_id string, file string").json(folder)
    return found.groupBy("run_id", "file", "event").agg(F.count("*").alias("n"), F.sum("wait_ms").alias("wait_ms"))


# --- streams: the table is read as a stream, run to its end, and the result is checked like a batch ---


def _stream(d: Inputs, table: str, name: str) -> DataFrame:
    """A derived input over a table that is read as a stream."""
    source = d.spark.read.parquet(f"{d.sf_dir}/{table}.parquet").schema
    # The file source takes folders or patterns, so the one file is named by a pattern.
    rows = d.spark.readStream.schema(source).parquet(f"{d.sf_dir}/{table[:-1]}[{table[-1]}].parquet")
    return view_over(rows, table, name)


@query("""
SELECT video_id, progressive, tff, bff, interlaced, undetermined, total, round(progressive_fraction, 6) AS progressive_fraction,
 round(undetermined_share, 6) AS undetermined_share, undetermined_share > 0.02e0 AS undetermined_high FROM metrics""")
def stream_frame_counts(d: Inputs) -> DataFrame:
    counts = streams.drain(streams.live_frame_counts(_stream(d, "events", "v_frames")), "complete")
    return counts.withColumns({c: r(c) for c in ("progressive_fraction", "undetermined_share")})


@query("""
SELECT host, count(*) AS samples, round(100e0 * (20 - avg(cpu_free)) / 20, 6) AS cpu_busy_pct, min(cpu_free) AS cpu_free_min,
 round(100e0 * (4 - avg(nvenc_free)) / 4, 6) AS nvenc_busy_pct, min(nvenc_free) AS nvenc_free_min, round(avg(gpu_pct), 6) AS gpu_pct_avg,
 max(gpu_pct) AS gpu_pct_max FROM v_tick_rows GROUP BY host""")
def stream_pool_busy(d: Inputs) -> DataFrame:
    return _rounded(streams.drain(streams.live_tick_summary(_stream(d, "events", "v_tick_rows")), "complete"))


@query("""
SELECT host, tick_id, tick_ms, round(CASE WHEN cpu_total > pt THEN 100e0 * ((cpu_total - pt) - greatest(cpu_idle - pi, 0)) / (cpu_total - pt) ELSE 0e0 END, 6) AS cpu_pct
FROM (SELECT *, lag(cpu_total) OVER (PARTITION BY host ORDER BY tick_ms) AS pt, lag(cpu_idle) OVER (PARTITION BY host ORDER BY tick_ms) AS pi FROM v_counters)""")
def stream_cpu_pct(d: Inputs) -> DataFrame:
    return streams.drain(streams.live_cpu_pct(_stream(d, "events", "v_counters"))).withColumn("cpu_pct", r("cpu_pct")).drop("late")


@query("""
SELECT slot, seq, stage, detail FROM (SELECT *, lag(stage) OVER (PARTITION BY slot ORDER BY seq) AS before FROM v_stages) s WHERE stage IS DISTINCT FROM before""")
def stream_stages(d: Inputs) -> DataFrame:
    raw = _stream(d, "conversations", "v_stages")
    # Every slot is opened by its first row.
    opening = F.struct(F.lit(-1).cast("bigint").alias("seq"), F.lit("begin").alias("kind"), F.lit(None).cast("string").alias("stage"))
    change = F.struct(F.col("seq"), F.lit("set").alias("kind"), F.col("stage"))
    updates = raw.select(
        F.lit("run").alias("run_id"), "slot", "detail", F.lit("file").alias("file"), F.lit(None).cast("string").alias("level"),
        F.inline(F.when(F.col("seq") == 0, F.array(opening, change)).otherwise(F.array(change))),
    )
    changes = streams.drain(streams.live_stages(updates))
    return changes.where(F.col("change") == "stage").select("slot", "seq", "stage", "detail")


@query("""
SELECT video_id, op, start_ms, wait_ms, hold_ms, 'acquire' AS event FROM v_ops WHERE wait_ms > 0
UNION ALL SELECT video_id, op, start_ms, wait_ms, hold_ms, 'release' FROM v_ops WHERE woken > 0 OR hold_ms >= 30000""")
def stream_thinning(d: Inputs) -> DataFrame:
    kept = streams.live_thin_events(_stream(d, "lineitem", "v_ops"))
    return streams.drain(kept.select("video_id", "op", "start_ms", "wait_ms", "hold_ms", "event"))


#: Runs that the samples come in, and the rows that come with the last of them, whatever their time.
DROPS, LATE_EVERY, LATE_AT = 3, 89, 3


@query("""
SELECT * FROM (WITH dealt AS (SELECT host, tick_ms, cpu_free, (tick_ms // 300000 + 1) * 300000 AS until_ms, CASE WHEN tick_id % 89 = 3 THEN 2 ELSE tick_id * 3 // (SELECT max(tick_id) + 1 FROM v_tick_rows) END AS dropped FROM v_tick_rows),
marked AS (SELECT *, coalesce(until_ms <= (SELECT max(b.tick_ms) FROM dealt b WHERE b.dropped < a.dropped) - 600000, false) AS late FROM dealt a)
SELECT CASE WHEN late THEN 'rejected' ELSE 'closed' END AS state, host, CAST(until_ms AS BIGINT) AS until_ms, count(*) AS samples, CAST(min(cpu_free) AS BIGINT) AS cpu_free_min
FROM marked WHERE late OR until_ms <= (SELECT max(tick_ms) FROM dealt) - 600000 GROUP BY ALL) q""")
def stream_intervals(d: Inputs) -> DataFrame:
    """Five-minute intervals of samples that come in several runs, some of them after their interval was closed."""
    landing, folder = scratch_folder(d.spark, "samples"), scratch_folder(d.spark, "intervals")
    rows = d.v_tick_rows.withColumn("t", F.timestamp_millis("tick_ms"))
    number = (rows.agg(F.max("tick_id")).first()[0] or 0) + 1
    part = F.when(F.col("tick_id") % LATE_EVERY == LATE_AT, DROPS - 1).otherwise(F.floor(F.col("tick_id") * DROPS / number))
    for k in range(DROPS):
        rows.where(part == k).write.mode("append").parquet(landing)
        streams.run_intervals(d.spark.readStream.schema(rows.schema).parquet(landing), folder)
    intervals = d.spark.read.parquet(f"{folder}/closed").select(
        F.lit("closed").alias("state"), "host", F.unix_millis("interval.end").alias("until_ms"), "samples", F.col("cpu_free_min").cast("long")
    )
    rejects = d.spark.read.schema(rows.schema).parquet(f"{folder}/rejects")
    until = F.unix_millis(F.window("t", "5 minutes")["end"])
    late = rejects.groupBy(F.lit("rejected").alias("state"), "host", until.alias("until_ms")).agg(F.count("*").alias("samples"), F.min("cpu_free").cast("long").alias("cpu_free_min"))
    return intervals.unionByName(late)


@query("""
SELECT * FROM (WITH opened AS (SELECT slot FROM v_stages WHERE seq = 0),
ended AS (SELECT slot, min(seq) * 4 + 2 AS seq, 'complete' AS change FROM v_stages JOIN opened USING (slot) WHERE seq > 0 AND stage = 'Phase 2' GROUP BY slot),
done AS (SELECT * FROM ended UNION ALL SELECT slot, seq * 4 + 3, 'skip' FROM v_stages WHERE stage = 'Detect' AND seq % 2 = 1)
SELECT slot, seq, change, (SELECT count(*) FROM done) AS done, (SELECT count(*) FROM done WHERE change = 'skip') AS skipped FROM done ORDER BY seq DESC, slot DESC LIMIT 8) q""")
def stream_recent(d: Inputs) -> DataFrame:
    """Newest completions and counts after several runs, the last of which is done again."""
    landing, folder = scratch_folder(d.spark, "updates"), scratch_folder(d.spark, "progress")
    made = lambda kind, nth: F.struct((F.col("seq") * 4 + nth).alias("seq"), F.lit(kind).alias("kind"))
    kinds = F.array_compact(F.array(
        F.when(F.col("seq") == 0, made("begin", 0)), made("set", 1), F.when((F.col("seq") > 0) & (F.col("stage") == "Phase 2"), made("complete", 2)),
        F.when((F.col("stage") == "Detect") & (F.col("seq") % 2 == 1), made("skip", 3)),
    ))
    updates = d.v_stages.select(F.lit("run").alias("run_id"), "slot", "stage", "detail", F.lit("file").alias("file"), F.lit("ok").alias("level"), F.col("seq").alias("turn"), F.inline(kinds))
    for low, high in ((0, 1), (2, 3), (4, None)):
        part = F.col("turn") >= low if high is None else F.col("turn").between(low, high)
        updates.where(part).write.mode("append").parquet(landing)
        source = d.spark.readStream.schema(updates.schema).parquet(landing)
        last = streams.run_progress(source, folder)
    # The commit of the last batch is lost, so that the stream does it again.
    remove(d.spark, f"{folder}/checkpoint/commits/{last}")
    if streams.run_progress(source, folder) != last:
        raise RuntimeError("the batch was not done again")
    counts, newest = streams.progress_now(d.spark, folder)
    return newest.join(counts, "run_id").select("slot", "seq", "change", "done", "skipped")


@query("""
SELECT CAST(video_id % 3 AS VARCHAR) AS run_id, video_id, op, start_ms, event, count(*) AS n FROM (
 SELECT video_id, op, start_ms, 'acquire' AS event FROM v_ops WHERE wait_ms > 0 UNION ALL SELECT video_id, op, start_ms, 'release' FROM v_ops WHERE woken > 0 OR hold_ms >= 30000) e GROUP BY ALL""")
def stream_event_sink(d: Inputs) -> DataFrame:
    """Thinned events, written by a stream that is stopped after the first half of its input and started again."""
    landing, folder = scratch_folder(d.spark, "ops"), scratch_folder(d.spark, "sink")
    ops = d.v_ops
    for half in (0, 1):
        ops.where(F.coalesce(F.abs(F.xxhash64("start_ms", "op")) % 2, F.lit(0)) == half).write.mode("append").parquet(landing)
        live = streams.live_thin_events(d.spark.readStream.schema(ops.schema).parquet(landing))
        streams.run_event_sink(live.select((F.col("video_id") % 3).cast("string").alias("run_id"), "video_id", "op", "start_ms", "event"), folder)
    found = d.spark.read.schema("video_id long, op string, start_ms long, event string, run_id string").json(f"{folder}/events")
    return found.groupBy("run_id", "video_id", "op", "start_ms", "event").agg(F.count("*").alias("n"))
