"""The three flows a user runs: compress analysis, episode split, chapter print-out."""

from __future__ import annotations

from dataclasses import asdict
from datetime import datetime
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmetrics.functions.probe import add_features
from reelmetrics.operators import chapters as ch
from reelmetrics.operators import detection, outcome, quality, sampling, search, usage
from reelmetrics.settings import DEFAULTS, Settings
from reelmetrics.sources.writers import write_bucketed


def assemble(videos: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """One row per video with every part as a nested column; parts have one row per video_id."""

    def nested(name: str, part: DataFrame) -> DataFrame:
        return part.select("video_id", F.struct(*[c for c in part.columns if c != "video_id"]).alias(name))

    joined = [nested(name, part) for name, part in parts.items()]
    return reduce(lambda rows, part: rows.join(part, "video_id", "left"), joined, videos)


def plan_sampling(videos: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Sample windows per video; needs video_id and duration_s."""
    return sampling.sample_windows(videos, settings)


def tune(scores: DataFrame, ranges: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Selection per video over the levels the search would have measured."""
    seen = search.probed_levels(quality.level_stats(scores), ranges, settings)
    return quality.add_marginal(quality.select_level(quality.add_neighbours(seen, settings), settings), settings)


def search_ranges(streams: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    return add_features(streams, settings).select("video_id", "search.tier", "search.min_cq", "search.max_cq")


def compress_summary(
    streams: DataFrame,
    frames: DataFrame,
    scores: DataFrame,
    sizes: DataFrame,
    output_frames: DataFrame | None = None,
    output_streams: DataFrame | None = None,
    totals: DataFrame | None = None,
    hdr: DataFrame | None = None,
    ops: DataFrame | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """The nested summary row per video that the job leaves behind.

    `streams` has one row per video with rates, field order, size and colour columns;
    `sizes` has video_id, input_bytes, encoded_bytes, passthrough_bytes.
    """
    featured = add_features(streams, settings)
    detected = detection.add_restore(detection.detect(frames, streams, totals, settings))
    plan = ["mode", "filter_graph", "out_num", "out_den", "notes"]
    facts = [c for c in detected.columns if c not in (*plan, *streams.columns)]
    guard = outcome.size_verdict(
        F.col("restore.mode"), F.col("input_bytes"), F.col("encoded_bytes"), F.col("passthrough_bytes")
    )
    rows = detected.select(
        "video_id", F.struct(*facts).alias("detection"), F.struct(*plan, "confidence").alias("restore")
    )
    rows = featured.join(rows, "video_id", "left").join(sizes, "video_id", "left")
    rows = rows.withColumn("size_guard", F.when(F.col("encoded_bytes").isNotNull(), guard))
    if output_frames is not None and output_streams is not None:
        found = detection.detect(output_frames, output_streams, None, settings)
        seen = output_streams.select("video_id", F.lit(True).alias("has_video")).join(
            found.select("video_id", "progressive_fraction", "cadence_rate", "fps"), "video_id", "left"
        )
        output = F.struct(*[c for c in seen.columns if c != "video_id"])
        rows = rows.join(seen.select("video_id", output.alias("output")), "video_id", "left").withColumn(
            "verification",
            outcome.verification(
                F.col("restore.mode"), F.col("restore.out_num") / F.col("restore.out_den"), F.col("output").isNotNull(),
                F.col("output.has_video"), F.col("output.progressive_fraction"), F.col("output.cadence_rate"),
                F.col("output.fps"),
            ),
        )
    else:
        rows = rows.withColumn(
            "verification", F.lit(None).cast("struct<skipped:boolean,passed:boolean,warnings:array<string>,notes:string>")
        )
    parts = {"tuning": tune(scores, featured.select("video_id", "search.min_cq", "search.max_cq"), settings)}
    if hdr is not None:
        parts["hdr"] = hdr
    if ops is not None:
        rows = rows.join(usage.video_usage(ops), "video_id", "left")
    return assemble(rows, parts).withColumns(
        {
            "final_cq": F.col("tuning.cq"),
            "level": outcome.result_level(
                F.col("verification.passed"), F.col("size_guard.fell_back"), F.col("tuning.is_marginal")
            ),
        }
    )


#: A bucketed table's partitioning counts for joins on the key and more, not only for joins on the key alone.
BUCKETED = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


def bucket(spark: SparkSession, tables: dict[str, DataFrame], folder: str, buckets: int) -> dict[str, DataFrame]:
    """`tables` written once below `folder`, bucketed by video_id, and read back as bucketed tables.

    The frames come in a session of their own, with the settings that let every step of `compress_summary` use the buckets;
    the session of the caller keeps its own. Rows without a video_id have a bucket like any other. All rows of a video lie in one
    bucket: where a single video has a large part of all frames or scores, `compress_summary` on plain tables, which cuts
    videos into slices, is the better choice.
    """
    own = spark.newSession()
    for name, value in BUCKETED.items():
        own.conf.set(name, value)
    found = {}
    for name, rows in tables.items():
        table = f"{name}_{uuid4().hex}"
        write_bucketed(rows, table, f"{folder}/{name}", buckets)
        found[name] = own.table(table)
    return found


def run_summary(
    results: DataFrame, run_id: str, started: datetime, finished: datetime | None = None, settings: Settings = DEFAULTS
) -> DataFrame:
    """The run's own row: times, settings and outcome totals.

    Videos, errors and samples are tables of their own and are found through run_id.
    """
    config = F.struct(
        *[
            (F.array(*map(F.lit, value)) if isinstance(value, tuple) else F.lit(value)).alias(name)
            for name, value in asdict(settings).items()
        ]
    )
    totals = outcome.run_outcomes(results)
    return totals.select(
        F.lit(run_id).alias("run_id"),
        F.lit(started).alias("started"),
        F.lit(finished).cast("timestamp").alias("finished"),
        config.alias("config"),
        F.struct(*totals.columns).alias("outcomes"),
    )


def split(
    chapters: DataFrame,
    series: str,
    season: int = 1,
    start_episode: int = 1,
    start_chapter: int = 1,
    settings: Settings = DEFAULTS,
) -> tuple[DataFrame, DataFrame]:
    """(cut manifest, renumbered chapters of every episode)."""
    kept = ch.trim_chapters(chapters, start_chapter)
    manifest = ch.episode_manifest(kept, series, season, start_episode, settings)
    return manifest, ch.episode_chapters(kept, settings, start_episode)


def print_chapters(chapters: DataFrame, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(chapter report, main and total counts per disc)."""
    return ch.chapter_report(chapters, settings), ch.chapter_counts(chapters, settings)
