"""Stratified random sample windows inside each video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmetrics.settings import DEFAULTS, Settings

_PRIME = 2147483647


def modular_uniform(video_id: Column, index: Column, seed: int) -> Column:
    """Uniform in [0, 1) from whole-number arithmetic that any SQL engine repeats."""
    key = F.pmod(video_id.cast("long"), F.lit(_PRIME).cast("long"))
    mixed = key * F.lit(1597334677) + (index + 1).cast("long") * F.lit(1327217885) + F.lit(seed * 97).cast("long")
    return (mixed % _PRIME) / F.lit(float(_PRIME))


def hashed_uniform(video_id: Column, index: Column, seed: int) -> Column:
    """Uniform in [0, 1) from a 64-bit hash; takes keys of any type."""
    bits = F.call_function("shiftrightunsigned", F.xxhash64(F.lit(seed), video_id, index), F.lit(11))
    return bits / F.lit(float(1 << 53))


def sample_windows(videos: DataFrame, settings: Settings = DEFAULTS, uniform=hashed_uniform) -> DataFrame:
    """Rows (video_id, sample_idx, start_s, length_s) for `videos` with duration_s > 0.

    Below two window lengths the whole video is one window.  Otherwise the video is cut
    into as many equal strata as whole windows fit (at most `sample_count`) and each gets
    one window, placed at random so that it stays inside its stratum.
    """
    length, most = float(settings.window_seconds), settings.sample_count
    if settings.window_seconds <= 0 or most <= 0:
        raise ValueError("window_seconds and sample_count must be positive")
    duration = F.col("duration_s")
    is_short = duration < 2 * length
    fitting = F.floor(duration / length).cast("int")
    count = F.when(is_short, F.lit(1)).otherwise(F.least(fitting, F.lit(most)))
    rows = videos.where(duration > 0).select(
        "video_id", "duration_s", count.alias("n"), F.explode(F.sequence(F.lit(0), count - 1)).alias("sample_idx")
    )
    stratum = duration / F.col("n")
    begin = F.col("sample_idx") * stratum
    latest = F.greatest(F.least(begin + stratum, duration) - length, begin)
    drawn = begin + uniform(F.col("video_id"), F.col("sample_idx"), settings.seed) * (latest - begin)
    inside = F.greatest(F.lit(0.0), F.least(drawn, duration - length))
    return rows.select(
        "video_id",
        "sample_idx",
        F.when(is_short, F.lit(0.0)).otherwise(inside).alias("start_s"),
        F.when(is_short, duration).otherwise(F.lit(length)).alias("length_s"),
    )


def sample_coverage(windows: DataFrame, videos: DataFrame) -> DataFrame:
    """Windows used, seconds covered and share of the source per video."""
    covered = windows.groupBy("video_id").agg(F.count(F.lit(1)).alias("windows"), F.sum("length_s").alias("covered_s"))
    return videos.select("video_id", "duration_s").join(covered, "video_id").withColumn(
        "covered_pct", F.when(F.col("duration_s") > 0, F.col("covered_s") / F.col("duration_s") * 100).otherwise(0.0)
    )
