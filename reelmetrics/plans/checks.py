"""SQL that DuckDB runs to check the registered queries; parts build on the views."""

from __future__ import annotations

import re

from reelmetrics.plans.views import VIEWS, compose


def _rate(text: str) -> tuple[str, str]:
    whole = f"TRY_CAST(split_part({text}, '/', {{}}) AS INTEGER)"
    value = f"TRY_CAST({text} AS DOUBLE)"
    n = f"CASE WHEN {text} LIKE '%/%' THEN {whole.format(1)} WHEN {value} > 0 THEN CAST(round_even({value} * 100000, 0) AS INTEGER) END"
    d = f"CASE WHEN {text} LIKE '%/%' THEN {whole.format(2)} WHEN {value} > 0 THEN 100000 END"
    return n, d


def _rates(source: str) -> str:
    """SELECT adding num, den, fps, is_ntsc, is_ntsc30, is_cfr and rate_text to `source`."""
    rn, rd = _rate("r_frame_rate")
    an, ad = _rate("avg_frame_rate")
    return f"""
SELECT *, CASE WHEN den = 1 THEN CAST(num AS VARCHAR) WHEN num IS NOT NULL THEN concat(num, '/', den) END AS rate_text,
 coalesce(abs(fps - 30000/1001.0) < 0.01 OR abs(fps - 24000/1001.0) < 0.01 OR abs(fps - 60000/1001.0) < 0.01, false) AS is_ntsc,
 coalesce(abs(fps - 30000/1001.0) < 0.01, false) AS is_ntsc30,
 coalesce((rn / rd) / (an / ad) < 1.05e0, true) AS is_cfr
FROM (SELECT *, coalesce(rn, an) // gcd(coalesce(rn, an), coalesce(rd, ad)) AS num,
  coalesce(rd, ad) // gcd(coalesce(rn, an), coalesce(rd, ad)) AS den, coalesce(rn, an) / coalesce(rd, ad) AS fps
 FROM (SELECT * EXCLUDE (rn, rd, an, ad), CASE WHEN rn > 0 AND rd > 0 THEN rn END AS rn, CASE WHEN rn > 0 AND rd > 0 THEN rd END AS rd,
   CASE WHEN an > 0 AND ad > 0 THEN an END AS an, CASE WHEN an > 0 AND ad > 0 THEN ad END AS ad
  FROM (SELECT *, {rn} AS rn, {rd} AS rd, {an} AS an, {ad} AS ad FROM {source}) a) b) c"""


PARTS: dict[str, str] = {
    **VIEWS,
    "frame_windows": """
SELECT *, count(*) OVER ahead AS seen, sum(p) OVER ahead AS np, sum(i) OVER ahead AS ni,
 lead(i, 2) OVER (PARTITION BY video_id ORDER BY frame_idx) AS centre
FROM (SELECT *, CASE WHEN flag = 'progressive' THEN 1 ELSE 0 END AS p, CASE WHEN flag IN ('tff', 'bff') THEN 1 ELSE 0 END AS i FROM v_frames)
WINDOW ahead AS (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)""",
    "metrics": """
SELECT video_id, count(*) FILTER (flag = 'progressive') AS progressive, count(*) FILTER (flag = 'tff') AS tff,
 count(*) FILTER (flag = 'bff') AS bff, count(*) FILTER (flag = 'undetermined') AS undetermined,
 count(*) FILTER (i = 1) AS interlaced, count(*) AS total,
 coalesce(count(*) FILTER (p = 1) / nullif(count(*) FILTER (p = 1 OR i = 1), 0), 1e0) AS progressive_fraction,
 count(*) FILTER (flag = 'undetermined') / count(*) AS undetermined_share,
 coalesce(count(*) FILTER (seen = 5 AND np = 3 AND ni = 2) / nullif(count(*) FILTER (seen = 5), 0), 0e0) AS cadence_rate,
 coalesce(count(*) FILTER (seen = 5 AND np = 3 AND ni = 2 AND centre = 1) / nullif(count(*) FILTER (seen = 5 AND centre = 1), 0), 0e0) AS i_in_cadence
FROM frame_windows GROUP BY video_id""",
    "video_rates": _rates("v_video"),
    "probe_rates": _rates("v_probe"),
    "paritied": """
SELECT *, CASE WHEN tff + bff > 0 AND tff / (tff + bff) >= 0.90e0 THEN 'tff' WHEN tff + bff > 0 AND tff / (tff + bff) <= 1e0 - 0.90e0 THEN 'bff'
  WHEN probe_parity <> 'auto' THEN probe_parity WHEN is_ntsc THEN 'tff' ELSE 'auto' END AS parity,
 NOT (tff + bff > 0 AND (tff / (tff + bff) >= 0.90e0 OR tff / (tff + bff) <= 1e0 - 0.90e0)) AND probe_parity = 'auto' AND is_ntsc AS from_ntsc
FROM (SELECT m.*, r.* EXCLUDE (video_id), CASE WHEN lower(trim(field_order)) LIKE '%tt%' OR lower(trim(field_order)) LIKE '%tff%' THEN 'tff'
  WHEN lower(trim(field_order)) LIKE '%bb%' OR lower(trim(field_order)) LIKE '%bff%' THEN 'bff' ELSE 'auto' END AS probe_parity
 FROM metrics m JOIN video_rates r USING (video_id))""",
    "classed": """
SELECT *, CASE WHEN interlaced = 0 THEN 'progressive' WHEN noise THEN 'progressive' WHEN progressive_fraction <= 0.05e0 THEN 'interlaced'
  WHEN cadence_rate >= 0.8e0 THEN 'telecined' WHEN i_in_cadence >= 0.6e0 THEN 'mixed_progressive_telecine'
  WHEN evidence THEN 'mixed_progressive_interlaced' ELSE 'mixed_progressive_telecine' END AS content_type,
 CASE WHEN interlaced = 0 OR noise THEN '7.2.2.1' WHEN progressive_fraction <= 0.05e0 THEN '7.2.2.3' WHEN cadence_rate >= 0.8e0 THEN '7.2.2.2'
  WHEN i_in_cadence >= 0.6e0 THEN '7.2.2.4' WHEN evidence THEN '7.2.2.5' ELSE '7.2.2.4' END AS branch,
 CASE WHEN parity_mismatch THEN greatest(0.2e0, base - 0.1e0) ELSE base END AS confidence
FROM (SELECT *, CASE WHEN interlaced = 0 THEN 0.99e0 WHEN noise THEN 0.95e0
   WHEN progressive_fraction <= 0.05e0 THEN least(greatest(0.85e0 + (0.05e0 - progressive_fraction) * 3e0, 0.85e0), 0.99e0)
   WHEN cadence_rate >= 0.8e0 THEN least(greatest(0.8e0 + (cadence_rate - 0.8e0) * 2e0, 0.8e0), 0.99e0)
   WHEN i_in_cadence >= 0.6e0 THEN least(greatest(0.6e0 + i_in_cadence * 0.3e0, 0.55e0), 0.9e0)
   WHEN evidence THEN least(greatest(0.5e0 + (0.6e0 - i_in_cadence) * 0.5e0, 0.45e0), 0.85e0)
   ELSE least(greatest(0.55e0 + progressive_fraction * 0.15e0, 0.5e0), 0.7e0) END AS base
 FROM (SELECT *, interlaced <= greatest(8, round_even((progressive + interlaced) * 0.001e0, 0)) AND cadence_rate < 0.05e0 AND i_in_cadence < 0.1e0 AS noise,
   interlaced >= 100 OR (progressive + interlaced > 0 AND interlaced >= (progressive + interlaced) * 0.005e0) AS evidence,
   probe_parity <> 'auto' AND parity <> 'auto' AND probe_parity <> parity AS parity_mismatch FROM paritied) a) b""",
    "restored": """
SELECT *, CASE plan_mode WHEN 'ivtc' THEN concat('fieldmatch=order=', parity, ':combmatch=full,bwdif=mode=send_frame:parity=', parity, ':deint=interlaced,decimate')
  WHEN 'deinterlace' THEN concat('bwdif=mode=send_frame:parity=', parity) ELSE '' END AS filter_graph,
 CASE WHEN plan_mode = 'ivtc' THEN 24000 END AS out_num, CASE WHEN plan_mode = 'ivtc' THEN 1001 END AS out_den
FROM (SELECT *, CASE WHEN content_type = 'progressive' THEN 'none' WHEN content_type = 'interlaced' THEN 'deinterlace'
   WHEN content_type = 'mixed_progressive_interlaced' AND progressive_fraction < 0.9e0 THEN 'deinterlace'
   WHEN is_ntsc30 AND is_cfr THEN 'ivtc' ELSE 'none' END AS plan_mode FROM classed) a""",
    "levels": """
SELECT video_id, cq, CASE WHEN fine THEN coalesce(mean, 0e0) END AS mean, CASE WHEN fine THEN coalesce(harmonic, 0e0) END AS harmonic,
 CASE WHEN fine THEN p05 END AS p05, CASE WHEN fine THEN p01 END AS p01, CASE WHEN fine THEN coalesce(low, 0e0) END AS min, n
FROM (SELECT video_id, cq, avg(score) AS mean, count(*) FILTER (score > 0) / sum(CASE WHEN score > 0 THEN 1e0 / score END) AS harmonic,
  quantile_cont(score, 0.05) AS p05, quantile_cont(score, 0.01) AS p01, min(score) AS low, count(score) AS n, NOT coalesce(bool_or(isnan(score)), false) AS fine
 FROM v_scores GROUP BY video_id, cq) a""",
    "gated": """
SELECT *, mean_ok AND p05_ok AND p01_ok AS passed
FROM (SELECT *, coalesce(mean >= 97, false) AS mean_ok, coalesce(p05 >= 95, false) AS p05_ok, coalesce(p01 >= 90, false) AS p01_ok FROM levels) g""",
    "picked": """
SELECT *, NOT any_passed AS fell_short FROM (
 SELECT *, bool_or(passed) OVER (PARTITION BY video_id) AS any_passed,
  row_number() OVER (PARTITION BY video_id ORDER BY passed DESC, CASE WHEN passed THEN cq END DESC NULLS LAST, mean DESC NULLS LAST, cq) AS choice FROM gated)
WHERE choice = 1""",
    "search": """
SELECT video_id, 0 AS step, 25 AS lo, 55 AS hi, CAST(NULL AS INTEGER) AS best, CAST(NULL AS INTEGER) AS cq, CAST(NULL AS INTEGER) AS from_lo,
 CAST(NULL AS INTEGER) AS from_hi, false AS passed FROM (SELECT DISTINCT video_id FROM levels) v
UNION ALL
SELECT s.video_id, s.step + 1, CASE WHEN coalesce(g.passed, false) THEN s.mid + 1 ELSE s.lo END, CASE WHEN coalesce(g.passed, false) THEN s.hi ELSE s.mid - 1 END,
 CASE WHEN coalesce(g.passed, false) THEN s.mid ELSE s.best END, s.mid, s.lo, s.hi, coalesce(g.passed, false)
FROM (SELECT *, (lo + hi + 1) // 2 AS mid FROM search WHERE lo <= hi) s LEFT JOIN gated g ON g.video_id = s.video_id AND g.cq = s.mid""",
    "drawn": """
SELECT video_id, duration_s, n, i, CASE WHEN duration_s < 24 THEN 0e0 ELSE greatest(0e0, least(i * seg + u * (greatest(least(i * seg + seg, duration_s) - 12, i * seg) - i * seg), duration_s - 12)) END AS start_s,
 CASE WHEN duration_s < 24 THEN duration_s ELSE 12e0 END AS length_s
FROM (SELECT *, duration_s / n AS seg, ((video_id * 1597334677 + (i + 1) * 1327217885 + 12345 * 97) % 2147483647) / 2147483647e0 AS u
 FROM (SELECT *, unnest(range(n)) AS i FROM (SELECT *, CASE WHEN duration_s < 24 THEN 1 ELSE least(CAST(floor(duration_s / 12) AS INTEGER), 16) END AS n
  FROM v_durations WHERE duration_s > 0) a) b) c""",
    "flagged": """
SELECT *, end_s - start_s AS duration_s, end_s - start_s >= 360 AS is_main, max(chapter_idx) OVER (PARTITION BY disc_id) AS last,
 lead(end_s - start_s >= 360) OVER (PARTITION BY disc_id ORDER BY chapter_idx) AS next_main FROM v_chapters""",
    "ends": """
SELECT disc_id, chapter_idx, least(chapter_idx + 2, last) AS end_idx, row_number() OVER (PARTITION BY disc_id ORDER BY chapter_idx) AS nth
FROM flagged WHERE is_main AND NOT next_main""",
    "all_ranges": """
SELECT disc_id, nth, coalesce(lag(end_idx) OVER (PARTITION BY disc_id ORDER BY chapter_idx), -1) + 1 AS start_idx, end_idx, false AS is_tail FROM ends
UNION SELECT f.disc_id, coalesce(max(e.n), 0) + 1, coalesce(max(e.last_end), -1) + 1, max(f.last), true
FROM flagged f LEFT JOIN (SELECT disc_id, max(end_idx) AS last_end, count(*) AS n FROM ends GROUP BY disc_id) e USING (disc_id)
GROUP BY f.disc_id HAVING max(CASE WHEN f.is_main THEN f.chapter_idx END) > coalesce(max(e.last_end), -1)""",
    "good_ranges": "SELECT * FROM all_ranges WHERE start_idx <= end_idx",
    "phased": """
SELECT *, CASE WHEN op LIKE 'detection%' THEN 'detection' WHEN op LIKE 'phase1.%' THEN 'phase1' WHEN op LIKE 'phase2.%' THEN 'phase2'
 WHEN op LIKE 'final-encode%' THEN 'final_encode' WHEN op LIKE 'verification%' THEN 'verification' ELSE 'other' END AS phase FROM v_ops""",
    "shares": """
SELECT video_id, CAST(sum(cpu * hold_ms) AS BIGINT) AS cpu_ms, CAST(sum(nvenc * hold_ms) AS BIGINT) AS nvenc_ms, CAST(sum(nvdec * hold_ms) AS BIGINT) AS nvdec_ms,
 CAST(sum(cuda * hold_ms) AS BIGINT) AS cuda_ms
FROM v_ops GROUP BY video_id""",
    "share_rows": """
SELECT *, row_number() OVER (PARTITION BY resource ORDER BY ms DESC, video_id) AS rank, sum(ms) OVER (PARTITION BY resource) AS total FROM (
 SELECT video_id, 'cpu' AS resource, cpu_ms AS ms FROM shares UNION SELECT video_id, 'nvenc', nvenc_ms FROM shares
 UNION SELECT video_id, 'nvdec', nvdec_ms FROM shares UNION SELECT video_id, 'cuda', cuda_ms FROM shares) WHERE ms > 0""",
    "cpu_ticks": """
SELECT * EXCLUDE (pt, pi), CASE WHEN cpu_total > pt THEN 100e0 * ((cpu_total - pt) - greatest(cpu_idle - pi, 0)) / (cpu_total - pt) ELSE 0e0 END AS cpu_pct
FROM (SELECT *, lag(cpu_total) OVER (PARTITION BY host ORDER BY tick_ms) AS pt, lag(cpu_idle) OVER (PARTITION BY host ORDER BY tick_ms) AS pi FROM v_ticks)""",
    "guarded": """
SELECT *, CASE WHEN encoded_bytes < input_bytes THEN 'kept_smaller' WHEN mode <> 'none' THEN 'kept_restored'
 WHEN passthrough_bytes >= encoded_bytes THEN 'kept' ELSE 'fell_back' END AS outcome FROM v_sizes""",
    "verified": """
SELECT *, mode = 'none' AS skipped, CASE WHEN mode = 'none' THEN '' ELSE concat_ws(',', CASE WHEN progressive_fraction < 0.99e0 THEN 'residual_interlacing' END,
  CASE WHEN mode = 'ivtc' AND cadence_rate > 0.05e0 THEN 'residual_cadence' END,
  CASE WHEN mode = 'ivtc' AND abs(fps - 24000/1001.0) >= 0.01 THEN 'unexpected_rate' END) END AS warnings
FROM (SELECT v.video_id, v.mode, m.progressive_fraction, m.cadence_rate, r.fps FROM v_video v
 JOIN video_rates r USING (video_id) LEFT JOIN metrics m USING (video_id))""",
    "reconciled": """
SELECT m.video_id, coalesce(abs(m.progressive - t.progressive) <= 1 AND abs(m.tff - t.tff) <= 1 AND abs(m.bff - t.bff) <= 1
 AND abs(m.undetermined - t.undetermined) <= 1, true) AS totals_agree FROM metrics m LEFT JOIN v_totals t USING (video_id)""",
    "searched": """
SELECT *, fell_short OR abs(mean - 97) < 0.5e0 OR abs(p05 - 95) < 0.5e0 OR abs(p01 - 90) < 0.5e0 AS is_marginal
FROM (SELECT l.*, NOT bool_or(l.passed) OVER (PARTITION BY l.video_id) AS fell_short,
  row_number() OVER (PARTITION BY l.video_id ORDER BY l.passed DESC, CASE WHEN l.passed THEN l.cq END DESC NULLS LAST, l.mean DESC NULLS LAST, l.cq) AS choice
 FROM gated l JOIN search q ON q.video_id = l.video_id AND q.cq = l.cq) z WHERE choice = 1""",
    "summarised": """
SELECT r.video_id, r.content_type, r.plan_mode AS mode, r.undetermined_share, r.parity_mismatch, p.cq AS final_cq, p.fell_short, p.is_marginal, g.outcome,
 CASE WHEN g.outcome = 'fell_back' THEN 'passthrough' WHEN p.is_marginal THEN 'marginal' ELSE 'ok' END AS level, s.cpu_ms, t.totals_agree
FROM restored r LEFT JOIN searched p ON p.video_id = r.video_id
LEFT JOIN (SELECT z.video_id, CASE WHEN encoded_bytes < input_bytes THEN 'kept_smaller' WHEN r2.plan_mode <> 'none' THEN 'kept_restored'
   WHEN passthrough_bytes >= encoded_bytes THEN 'kept' ELSE 'fell_back' END AS outcome FROM v_sizes z JOIN restored r2 ON r2.video_id = z.video_id) g ON g.video_id = r.video_id
LEFT JOIN shares s ON s.video_id = r.video_id LEFT JOIN reconciled t ON t.video_id = r.video_id""",
}


def _over(prefix: str, names: list[str], inputs: dict[str, str]) -> dict[str, str]:
    """The named parts again, under names with a prefix, over other inputs."""
    renamed = {**inputs, **{n: f"{prefix}{n}" for n in names}}
    pattern = re.compile(r"\b(" + "|".join(renamed) + r")\b")
    return {f"{prefix}{n}": pattern.sub(lambda m: renamed[m[1]], PARTS[n]) for n in names}


# The same over the fleet, and over its outputs.
_SHOTS = ["frame_windows", "metrics", "video_rates"]
PARTS |= _over(
    "f_", [*_SHOTS, "paritied", "classed", "restored", "levels", "gated", "reconciled"],
    {"v_frames": "f_frames", "v_video": "f_video", "v_scores": "f_scores", "v_totals": "f_totals"},
)
PARTS |= _over("o_", _SHOTS, {"v_frames": "f_out_frames", "v_video": "f_out_video"})
PARTS |= {
    "f_tiers": """
SELECT video_id, CASE WHEN width >= 3840 OR height >= 2160 THEN 'UHD' WHEN width >= 1920 OR height >= 1080 THEN '1080p' WHEN width >= 1280 OR height >= 720 THEN '720p' ELSE 'SD' END AS tier,
 CASE WHEN width >= 3840 OR height >= 2160 THEN 25 WHEN width >= 1920 OR height >= 1080 THEN 28 WHEN width >= 1280 OR height >= 720 THEN 32 ELSE 38 END AS low,
 CASE WHEN width >= 3840 OR height >= 2160 THEN 55 WHEN width >= 1920 OR height >= 1080 THEN 58 WHEN width >= 1280 OR height >= 720 THEN 62 ELSE 63 END AS high
FROM f_video""",
    "f_search": """
SELECT video_id, low AS lo, high AS hi, CAST(NULL AS INTEGER) AS cq FROM f_tiers
UNION ALL
SELECT s.video_id, CASE WHEN coalesce(g.passed, false) THEN s.mid + 1 ELSE s.lo END, CASE WHEN coalesce(g.passed, false) THEN s.hi ELSE s.mid - 1 END, s.mid
FROM (SELECT *, (lo + hi + 1) // 2 AS mid FROM f_search WHERE lo <= hi) s LEFT JOIN f_gated g ON g.video_id = s.video_id AND g.cq = s.mid""",
    "f_searched": """
SELECT *, fell_short OR abs(mean - 97) < 0.5e0 OR abs(p05 - 95) < 0.5e0 OR abs(p01 - 90) < 0.5e0 AS is_marginal
FROM (SELECT l.*, NOT bool_or(l.passed) OVER (PARTITION BY l.video_id) AS fell_short,
  row_number() OVER (PARTITION BY l.video_id ORDER BY l.passed DESC, CASE WHEN l.passed THEN l.cq END DESC NULLS LAST, l.mean DESC NULLS LAST, l.cq) AS choice
 FROM f_gated l JOIN f_search q ON q.video_id = l.video_id AND q.cq = l.cq) z WHERE choice = 1""",
    "f_verified": """
SELECT video_id, mode = 'none' OR (probed AND has_frames AND found = '') AS verify_passed, CASE WHEN mode <> 'none' AND probed AND has_frames THEN found ELSE '' END AS found
FROM (SELECT r.video_id, r.plan_mode AS mode, o.video_id IS NOT NULL AS probed, m.video_id IS NOT NULL AS has_frames,
  concat_ws(',', CASE WHEN m.progressive_fraction < 0.99e0 THEN 'residual_interlacing' END, CASE WHEN r.plan_mode = 'ivtc' AND m.cadence_rate > 0.05e0 THEN 'residual_cadence' END,
   CASE WHEN r.plan_mode = 'ivtc' AND abs(o.fps - 24000/1001.0) >= 0.01 THEN 'unexpected_rate' END) AS found
 FROM f_restored r LEFT JOIN o_video_rates o USING (video_id) LEFT JOIN o_metrics m ON m.video_id = o.video_id) x""",
    "f_summarised": """
SELECT *, CASE WHEN NOT verify_passed THEN 'verify_failed' WHEN outcome = 'fell_back' THEN 'passthrough' WHEN is_marginal THEN 'marginal' ELSE 'ok' END AS level
FROM (SELECT v.video_id, w.tier, v.color_transfer IS NOT NULL AND lower(v.color_transfer) IN ('smpte2084', 'arib-std-b67') AS is_hdr,
  CASE WHEN v.pix_fmt LIKE '%12%' THEN 12 WHEN v.pix_fmt LIKE '%10%' THEN 10 ELSE 8 END AS bit_depth, h.max_cll,
  r.content_type, r.plan_mode AS mode, r.undetermined_share, r.parity_mismatch, p.cq AS final_cq, p.fell_short, p.is_marginal,
  CASE WHEN z.encoded_bytes < z.input_bytes THEN 'kept_smaller' WHEN r.plan_mode <> 'none' THEN 'kept_restored' WHEN z.passthrough_bytes >= z.encoded_bytes THEN 'kept' ELSE 'fell_back' END AS outcome,
  s.cpu_ms, t.totals_agree, c.verify_passed, c.found
 FROM f_video v JOIN f_tiers w ON w.video_id = v.video_id LEFT JOIN f_restored r ON r.video_id = v.video_id LEFT JOIN f_searched p ON p.video_id = v.video_id
 LEFT JOIN f_sizes z ON z.video_id = v.video_id LEFT JOIN shares s ON s.video_id = v.video_id LEFT JOIN f_reconciled t ON t.video_id = v.video_id
 LEFT JOIN f_verified c ON c.video_id = v.video_id LEFT JOIN f_hdr h ON h.video_id = v.video_id) y""",
}


def check(body: str) -> str:
    return compose(body, PARTS)
