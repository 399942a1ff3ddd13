"""Line-level scans over captured tool logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def log_warnings(logs: DataFrame, keyword: str = "fieldmatch") -> DataFrame:
    """Every trimmed line that contains the keyword, in any case."""
    has = lambda c: F.contains(F.lower(c), F.lit(keyword.lower()))
    lines = logs.select("video_id", F.posexplode_outer(F.split("log", "\n")).alias("line_no", "line"))
    # Untrimmed lines are tested first, so only the few that remain are trimmed.
    trimmed = F.regexp_replace("line", r"^\s+|\s+$", "")
    return lines.where(has("line")).withColumn("line", trimmed).where(has("line"))


def log_warning_counts(logs: DataFrame, keyword: str = "fieldmatch") -> DataFrame:
    return log_warnings(logs, keyword).groupBy("video_id").agg(F.count(F.lit(1)).alias("lines"))
