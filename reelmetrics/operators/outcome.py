"""What came out: verification, size guard, resume, run totals, summary rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmetrics.functions.rates import TOLERANCE

# Limits a restored output has to keep.
MIN_PROGRESSIVE = 0.99
MAX_RESIDUAL_CADENCE = 0.05


def verification(
    mode: Column, expected_rate: Column, probed: Column, has_video: Column,
    progressive_fraction: Column, cadence_rate: Column, fps: Column,
) -> Column:
    """struct<skipped,passed,warnings,notes>: what a restored output has to keep."""
    found = F.array_compact(
        F.array(
            F.when(progressive_fraction < MIN_PROGRESSIVE, "residual_interlacing"),
            F.when((mode == "ivtc") & (cadence_rate > MAX_RESIDUAL_CADENCE), "residual_cadence"),
            F.when(F.abs(fps - expected_rate) >= TOLERANCE, "unexpected_rate"),
        )
    )
    skipped = mode == "none"
    broken = (
        F.when(~F.coalesce(probed, F.lit(False)), "probe failed")
        .when(~F.coalesce(has_video, F.lit(False)), "no video stream")
        .when(progressive_fraction.isNull(), "detection failed")
    )
    warnings = F.when(skipped | broken.isNotNull(), F.array().cast("array<string>")).otherwise(found)
    passed = skipped | (broken.isNull() & (F.size(warnings) == 0))
    return F.struct(
        skipped.alias("skipped"),
        passed.alias("passed"),
        warnings.alias("warnings"),
        F.when(skipped, "pass-through, nothing to verify")
        .when(broken.isNotNull(), broken)
        .when(passed, "passed")
        .otherwise(F.format_string("%d issue(s)", F.size(warnings)))
        .alias("notes"),
    )


def verify_outputs(plans: DataFrame, outputs: DataFrame) -> DataFrame:
    """Compare each restored output with its plan.

    `plans` has video_id, mode, out_num, out_den; `outputs` has video_id, has_video,
    progressive_fraction, cadence_rate, fps.  No output row means the probe failed.
    """
    rows = plans.join(outputs.withColumn("__probed", F.lit(True)), "video_id", "left")
    verdict = verification(
        F.col("mode"), F.col("out_num") / F.col("out_den"), F.col("__probed"), F.col("has_video"),
        F.col("progressive_fraction"), F.col("cadence_rate"), F.col("fps"),
    )
    return rows.select("video_id", "mode", verdict.alias("__v")).select("video_id", "mode", "__v.*")


def size_verdict(mode: Column, source: Column, encoded: Column, copied: Column) -> Column:
    """struct<outcome,fell_back,output,passthrough_bytes,saved_pct,bloat_pct,copy_saved_pct>.

    Keep the encode, or fall back to a plain copy of the source (null: the copy failed).
    Equal sizes do not count as smaller; a tie keeps the encode.
    """
    outcome = (
        F.when(encoded < source, "kept_smaller")
        .when(mode != "none", "kept_restored")
        .when(copied.isNull(), "kept_copy_failed")
        .when(copied >= encoded, "kept")
        .otherwise("fell_back")
    )
    fell_back = outcome == "fell_back"
    change = (F.try_divide(encoded.cast("double"), source) - 1.0) * 100.0
    return F.struct(
        outcome.alias("outcome"),
        fell_back.alias("fell_back"),
        F.when(fell_back, "passthrough").otherwise("encode").alias("output"),
        F.when(outcome.isin("kept", "fell_back"), copied).alias("passthrough_bytes"),
        F.when(change < 0, -change).alias("saved_pct"),
        F.when(change >= 0, change).alias("bloat_pct"),
        F.when(fell_back, (F.lit(1.0) - F.try_divide(copied.cast("double"), source)) * 100.0).alias("copy_saved_pct"),
    )


def size_guard(sizes: DataFrame) -> DataFrame:
    """Needs video_id, mode, input_bytes, encoded_bytes and passthrough_bytes."""
    verdict = size_verdict(
        F.col("mode"), F.col("input_bytes"), F.col("encoded_bytes"), F.col("passthrough_bytes")
    )
    kept = ["video_id", "mode", "input_bytes", "encoded_bytes"]
    return sizes.select(*kept, verdict.alias("__v")).select(*kept, "__v.*")


def result_level(verify_passed: Column, fell_back: Column, is_marginal: Column) -> Column:
    """Failed verification outranks a fallback, that outranks a marginal pick."""
    yes, no = F.lit(True), F.lit(False)
    return (
        F.when(F.coalesce(verify_passed, yes) == no, "verify_failed")
        .when(F.coalesce(fell_back, no), "passthrough")
        .when(F.coalesce(is_marginal, no), "marginal")
        .otherwise("ok")
    )


def split_resumed(videos: DataFrame, prior: DataFrame, force_redo: bool = False) -> tuple[DataFrame, DataFrame]:
    """(videos still to do, prior rows taken over).  Prior rows that did not parse are redone."""
    if "_corrupt_record" in prior.columns:
        prior = prior.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    done = prior.where(F.col("video_id").isNotNull())
    if force_redo:
        return videos, done.limit(0)
    return videos.join(done, "video_id", "left_anti"), done.join(videos, "video_id", "left_semi")


def combine_results(resumed: DataFrame, processed: DataFrame) -> DataFrame:
    """Resumed and new result rows in one table, told apart by `resumed`."""
    return resumed.withColumn("resumed", F.lit(True)).unionByName(
        processed.withColumn("resumed", F.lit(False)), allowMissingColumns=True
    )


def run_outcomes(results: DataFrame) -> DataFrame:
    """One row of totals.  `results` has resumed, error, verify_passed, fell_back, is_marginal."""
    failed = F.col("error").isNotNull()
    level = result_level(F.col("verify_passed"), F.col("fell_back"), F.col("is_marginal"))
    rows = results.withColumn("level", F.when(~failed, level))
    no = F.lit(False)
    return rows.agg(
        F.count(F.lit(1)).alias("videos"),
        F.count_if(~failed).alias("completed"),
        F.count_if(failed).alias("errored"),
        F.count_if(~failed & F.coalesce("resumed", no)).alias("skipped"),
        F.count_if(~failed & F.coalesce("is_marginal", no)).alias("marginal"),
        F.count_if(~failed & F.coalesce("fell_back", no)).alias("passthrough"),
        *[
            F.count_if(F.col("level") == name).alias(f"level_{name}")
            for name in ("ok", "marginal", "passthrough", "verify_failed")
        ],
    )
