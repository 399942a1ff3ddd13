"""Rule tables: content class, field parity, restoration plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelmetrics.functions.rates import NTSC24

# Thresholds of the content classes.
INTERLACED_MAX_PROGRESSIVE = 0.05
TELECINE_MIN_CADENCE = 0.80
IN_CADENCE_MIN = 0.60
NOISE_MIN_FRAMES = 8
NOISE_SHARE = 0.001
NOISE_MAX_CADENCE = 0.05
NOISE_MAX_IN_CADENCE = 0.10
EVIDENCE_MIN_FRAMES = 100
EVIDENCE_MIN_SHARE = 0.005
MISMATCH_PENALTY = 0.10
MISMATCH_FLOOR = 0.20
PARITY_DOMINANCE = 0.90
FAVOUR_PROGRESSIVE = 0.90


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def _percent(value: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f%%", value * 100)


def classify(
    interlaced: Column,
    classified: Column,
    progressive_fraction: Column,
    cadence_rate: Column,
    i_in_cadence: Column,
    parity_mismatch: Column,
) -> Column:
    """struct<content_type,confidence,branch,reason>; the first branch that applies wins."""

    def outcome(kind: str, confidence: Column, branch: str, reason: Column) -> Column:
        lowered = F.greatest(F.lit(MISMATCH_FLOOR), confidence - MISMATCH_PENALTY)
        return F.struct(
            F.lit(kind).alias("content_type"),
            F.when(parity_mismatch, lowered).otherwise(confidence).alias("confidence"),
            F.lit(branch).alias("branch"),
            reason.alias("reason"),
        )

    noise_cap = F.greatest(F.lit(float(NOISE_MIN_FRAMES)), F.rint(classified * NOISE_SHARE))
    is_noise = (
        (interlaced <= noise_cap) & (cadence_rate < NOISE_MAX_CADENCE) & (i_in_cadence < NOISE_MAX_IN_CADENCE)
    )
    has_evidence = (interlaced >= EVIDENCE_MIN_FRAMES) | (
        (classified > 0) & (interlaced >= classified * EVIDENCE_MIN_SHARE)
    )
    interlaced_share = _percent(F.lit(1.0) - progressive_fraction, 3)
    return (
        F.when(
            interlaced == 0,
            outcome("progressive", F.lit(0.99), "7.2.2.1", F.lit("no interlaced frame seen")),
        )
        .when(
            is_noise,
            outcome(
                "progressive",
                F.lit(0.95),
                "7.2.2.1",
                F.concat(
                    F.lit("within detector noise floor: "), interlaced_share,
                    F.lit(" interlaced, at most "), noise_cap.cast("long").cast("string"), F.lit(" frames allowed"),
                ),
            ),
        )
        .when(
            progressive_fraction <= INTERLACED_MAX_PROGRESSIVE,
            outcome(
                "interlaced",
                clamp(F.lit(0.85) + (F.lit(INTERLACED_MAX_PROGRESSIVE) - progressive_fraction) * 3.0, 0.85, 0.99),
                "7.2.2.3",
                F.concat(interlaced_share, F.lit(" of the classified frames are interlaced")),
            ),
        )
        .when(
            cadence_rate >= TELECINE_MIN_CADENCE,
            outcome(
                "telecined",
                clamp(F.lit(0.80) + (cadence_rate - TELECINE_MIN_CADENCE) * 2.0, 0.80, 0.99),
                "7.2.2.2",
                F.concat(F.lit("uniform 3:2 cadence in "), _percent(cadence_rate), F.lit(" of all windows")),
            ),
        )
        .when(
            i_in_cadence >= IN_CADENCE_MIN,
            outcome(
                "mixed_progressive_telecine",
                clamp(F.lit(0.60) + i_in_cadence * 0.3, 0.55, 0.90),
                "7.2.2.4",
                F.concat(_percent(i_in_cadence, 1), F.lit(" of the interlaced frames lie in 3:2 windows")),
            ),
        )
        .when(
            has_evidence,
            outcome(
                "mixed_progressive_interlaced",
                clamp(F.lit(0.50) + (F.lit(IN_CADENCE_MIN) - i_in_cadence) * 0.5, 0.45, 0.85),
                "7.2.2.5",
                F.concat(F.lit("only "), _percent(i_in_cadence, 1), F.lit(" of the interlaced frames lie in 3:2 windows")),
            ),
        )
        .otherwise(
            outcome(
                "mixed_progressive_telecine",
                clamp(F.lit(0.55) + progressive_fraction * 0.15, 0.50, 0.70),
                "7.2.2.4",
                F.concat(
                    F.lit("safe default of 7.2.3.1: "), interlaced_share,
                    F.lit(" interlaced is above noise but too little to verify"),
                ),
            )
        )
    )


def parity(tff: Column, bff: Column, is_ntsc: Column, probed: Column) -> Column:
    """struct<parity,from_ntsc>: dominance of the counts, else the probe, else NTSC habit."""
    share = F.try_divide(tff.cast("double"), (tff + bff).cast("double"))

    def answer(value, from_ntsc: bool) -> Column:
        value = value if isinstance(value, Column) else F.lit(value)
        return F.struct(value.alias("parity"), F.lit(from_ntsc).alias("from_ntsc"))

    return (
        F.when(share >= PARITY_DOMINANCE, answer("tff", False))
        .when(share <= 1.0 - PARITY_DOMINANCE, answer("bff", False))
        .when(probed != "auto", answer(probed, False))
        .when(is_ntsc, answer("tff", True))
        .otherwise(answer("auto", False))
    )


# Fixed value: filter texts understood by the external tool.
def inverse_telecine_filter(parity_text: Column) -> Column:
    return F.concat(
        F.lit("fieldmatch=order="), parity_text, F.lit(":combmatch=full,bwdif=mode=send_frame:parity="),
        parity_text, F.lit(":deint=interlaced,decimate"),
    )


def deinterlace_filter(parity_text: Column) -> Column:
    return F.concat(F.lit("bwdif=mode=send_frame:parity="), parity_text)


def restore_plan(
    content_type: Column,
    progressive_fraction: Column,
    cadence_rate: Column,
    i_in_cadence: Column,
    is_ntsc30: Column,
    is_cfr: Column,
    rate_text: Column,
    parity_text: Column,
) -> Column:
    """struct<mode,filter_graph,out_num,out_den,notes> for a classified video."""
    guard = F.coalesce(is_ntsc30, F.lit(False)) & F.coalesce(is_cfr, F.lit(True))
    shown = F.coalesce(rate_text, F.lit("?"))
    source = F.concat(
        F.lit(" [source "), shown, F.lit(" fps, "), F.when(is_cfr, "constant").otherwise("variable"), F.lit(" rate]")
    )
    why_not = F.concat_ws(
        " and ",
        F.when(~F.coalesce(is_ntsc30, F.lit(False)), F.concat(F.lit("rate "), shown, F.lit(" is not 30000/1001"))),
        F.when(~is_cfr, F.lit("variable frame rate")),
    )
    favoured = progressive_fraction >= FAVOUR_PROGRESSIVE
    share = _percent(progressive_fraction, 1)

    def plan(mode: str, notes: Column) -> Column:
        graph = {"ivtc": inverse_telecine_filter(parity_text), "deinterlace": deinterlace_filter(parity_text)}
        num, den = NTSC24 if mode == "ivtc" else (None, None)
        return F.struct(
            F.lit(mode).alias("mode"),
            graph.get(mode, F.lit("")).alias("filter_graph"),
            F.lit(num).cast("int").alias("out_num"),
            F.lit(den).cast("int").alias("out_den"),
            notes.alias("notes"),
        )

    def passed(what: Column) -> Column:
        return plan("none", F.concat(what, F.lit(": "), why_not, F.lit("; passing through")))

    mixed, progressive = content_type == "mixed_progressive_interlaced", content_type == "progressive"
    telecined, part_telecined = content_type == "telecined", content_type == "mixed_progressive_telecine"
    return (
        F.when(progressive, plan("none", F.concat(F.lit("progressive, no filter"), source)))
        .when(content_type == "interlaced", plan("deinterlace", F.concat(F.lit("interlaced, native rate kept"), source)))
        .when(
            telecined & guard,
            plan("ivtc", F.concat(F.lit("telecined, cadence "), _percent(cadence_rate, 1), source)),
        )
        .when(telecined, passed(F.lit("cadence found")))
        .when(
            part_telecined & guard,
            plan("ivtc", F.concat(F.lit("partly telecined, in cadence "), _percent(i_in_cadence, 1), source)),
        )
        .when(part_telecined, passed(F.lit("partial cadence found")))
        .when(
            mixed & favoured & guard,
            plan("ivtc", F.concat(F.lit("mostly progressive ("), share, F.lit("), inverse telecine"), source)),
        )
        .when(mixed & favoured, passed(F.concat(F.lit("mostly progressive ("), share, F.lit(")"))))
        .when(mixed, plan("deinterlace", F.concat(F.lit("progressive share "), share, F.lit(" below 90%"), source)))
        .otherwise(plan("none", F.lit("unknown content type")))
    )
