"""Warnings and decision records of a finished video, from its summary row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _has(summary: DataFrame, part: str, field: str) -> bool:
    return part in summary.columns and field in summary.schema[part].dataType.names


def _warnings(summary: DataFrame) -> Column:
    """array<struct<source,code>> of everything a reader should look at."""
    found = []

    def warn(source: str, condition: Column, code) -> None:
        code = code if isinstance(code, Column) else F.lit(code)
        found.append(F.when(condition, F.struct(F.lit(source).alias("source"), code.alias("code"))))

    warn("detection", F.col("detection.undetermined_high"), "undetermined_high")
    warn("detection", F.col("detection.parity_mismatch"), "parity_mismatch")
    if _has(summary, "detection", "totals_agree"):
        warn("detection", ~F.col("detection.totals_agree"), "totals_disagree")
    warn("tuning", F.col("tuning.is_marginal"), "marginal")
    warn("size_guard", F.col("size_guard.bloat_pct").isNotNull(), F.col("size_guard.outcome"))
    single = F.array_compact(F.array(*found))
    checked = F.transform(
        "verification.warnings", lambda w: F.struct(F.lit("verification").alias("source"), w.alias("code"))
    )
    empty = F.array().cast("array<struct<source:string,code:string>>")
    return F.concat(single, F.coalesce(checked, empty))


def video_warnings(summary: DataFrame) -> DataFrame:
    """Per video its warnings and their number; none means a clean run."""
    rows = summary.select("video_id", _warnings(summary).alias("warnings"))
    return rows.withColumn("count", F.size("warnings"))


def decision_events(summary: DataFrame, run_id: str) -> DataFrame:
    """What was decided for each video, as event rows for `write_events`."""

    def event(level: str, source: str, message: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), F.lit(source).alias("op"), message.alias("message"))

    info = [
        event("Information", "detection", F.concat_ws(
            " ", F.col("detection.content_type"), F.col("detection.branch"),
            F.format_string("confidence %.2f", F.col("detection.confidence")), F.col("detection.reason"),
        )),
        event("Information", "restore", F.concat_ws(" ", "restore.mode", "restore.filter_graph", "restore.notes")),
        event("Information", "tuning", F.concat_ws(" ", F.format_string("level %d", F.col("tuning.cq")), F.col("tuning.reason"))),
        event("Information", "size_guard", F.col("size_guard.outcome")),
        event("Information", "verification", F.col("verification.notes")),
    ]
    noted = F.transform(
        _warnings(summary),
        lambda w: F.struct(F.lit("Warning").alias("level"), w["source"].alias("op"), w["code"].alias("message")),
    )
    reasons = F.transform(
        F.coalesce("tuning.marginal_reasons", F.array().cast("array<string>")),
        lambda r: F.struct(F.lit("Warning").alias("level"), F.lit("tuning").alias("op"), r.alias("message")),
    )
    rows = F.filter(F.concat(F.array(*info), noted, reasons), lambda e: e["message"].isNotNull())
    return summary.select(
        F.lit(run_id).alias("run_id"),
        F.current_timestamp().alias("t"),
        F.col("video_id").cast("string").alias("file"),
        F.inline(rows),
    )
