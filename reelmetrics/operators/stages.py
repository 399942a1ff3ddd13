"""Progress records: stage changes, latest stage, recent completions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmetrics.operators.ordered import ordered_scan
from reelmetrics.settings import DEFAULTS, Settings


def stage_changes(stages: DataFrame, keys: Sequence[str] = ("slot",), settings: Settings = DEFAULTS) -> DataFrame:
    """Rows whose stage differs from the one before in the same slot (the first always does)."""
    scanned = ordered_scan(stages, keys, "seq", settings.stage_slice, previous={"__stage": "stage"})
    return scanned.where(~F.col("stage").eqNullSafe(F.col("__stage"))).drop("__stage")


def latest_stage(stages: DataFrame, keys: Sequence[str] = ("slot",)) -> DataFrame:
    latest = F.max_by(F.struct("seq", "stage", "detail"), F.col("seq"))
    return stages.groupBy(*keys).agg(latest.alias("__l")).select(*keys, "__l.*")


def recent(completions: DataFrame, at: str = "finished_at", tie: str = "video_id", keep: int = 8) -> DataFrame:
    """The most recent completions, newest first."""
    return completions.orderBy(F.col(at).desc(), F.col(tie).desc()).limit(keep)
