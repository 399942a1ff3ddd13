"""Content detection: from frame flags to a class and a restoration plan per video."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmetrics.functions import decide, rates
from reelmetrics.functions.probe import probe_parity
from reelmetrics.operators.cadence import frame_metrics
from reelmetrics.settings import DEFAULTS, Settings

# Fixed value: own counts and the detector's totals may differ by one frame.
TOTALS_TOLERANCE = 1
TOTALS = ("progressive", "tff", "bff", "undetermined")


def add_parity(counts: DataFrame) -> DataFrame:
    """Needs tff, bff, is_ntsc and field_order; adds parity columns and the mismatch flag."""
    rows = counts.withColumn("probe_parity", probe_parity(F.col("field_order")))
    rows = rows.withColumn(
        "__p", decide.parity(F.col("tff"), F.col("bff"), F.col("is_ntsc"), F.col("probe_parity"))
    )
    known = (F.col("probe_parity") != "auto") & (F.col("__p.parity") != "auto")
    return rows.withColumns(
        {
            "parity": F.col("__p.parity"),
            "from_ntsc": F.col("__p.from_ntsc"),
            "parity_mismatch": known & (F.col("probe_parity") != F.col("__p.parity")),
        }
    ).drop("__p")


def reconcile(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Own counts beside the detector's totals; a video without full totals passes."""
    reported = totals.select("video_id", *[F.col(t).alias(f"reported_{t}") for t in TOTALS])
    agrees = F.lit(True)
    for t in TOTALS:
        agrees = agrees & (F.abs(F.col(f"reported_{t}") - F.col(t)) <= TOTALS_TOLERANCE)
    complete = F.lit(True)
    for t in TOTALS:
        complete = complete & F.col(f"reported_{t}").isNotNull()
    return counts.join(reported, "video_id", "left").withColumn(
        "totals_agree", F.when(complete, agrees).otherwise(F.lit(True))
    )


def add_class(rows: DataFrame) -> DataFrame:
    """Adds content_type, confidence, branch and reason; parity_mismatch is optional."""
    mismatch = F.col("parity_mismatch") if "parity_mismatch" in rows.columns else F.lit(False)
    verdict = decide.classify(
        F.col("interlaced"),
        F.col("progressive") + F.col("interlaced"),
        F.col("progressive_fraction"),
        F.col("cadence_rate"),
        F.col("i_in_cadence"),
        mismatch,
    )
    return rows.withColumn("__c", verdict).select(*rows.columns, "__c.*")


def add_restore(detected: DataFrame) -> DataFrame:
    plan = decide.restore_plan(
        F.col("content_type"), F.col("progressive_fraction"), F.col("cadence_rate"), F.col("i_in_cadence"),
        F.col("is_ntsc30"), F.col("is_cfr"), F.col("rate_text"), F.col("parity"),
    )
    return detected.withColumn("__r", plan).select(*detected.columns, "__r.*")


def detect(
    frames: DataFrame, streams: DataFrame, totals: DataFrame | None = None, settings: Settings = DEFAULTS
) -> DataFrame:
    """One detection row per video of `streams` (rates and field order) that has frames."""
    metrics = frame_metrics(frames, settings)
    rows = rates.add_rates(streams).join(metrics, "video_id")
    rows = add_parity(rows)
    if totals is not None:
        rows = reconcile(rows, totals)
    return add_class(rows)
