"""Where time and hardware went: analytics over op records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmetrics.settings import DEFAULTS, Settings

RESOURCES = ("cpu", "nvenc", "nvdec", "cuda")
# Fixed value: op-name prefixes of the five phases.
PHASES = {
    "detection": "detection",
    "phase1": "phase1.",
    "phase2": "phase2.",
    "final_encode": "final-encode",
    "verification": "verification",
}


def phase_of(op: Column) -> Column:
    phase = None
    for name, prefix in PHASES.items():
        test = op.startswith(prefix)
        phase = F.when(test, name) if phase is None else phase.when(test, name)
    return phase.otherwise("other")


def _by_phase(ops: DataFrame, *more: Column) -> DataFrame:
    return ops.withColumn("phase", phase_of(F.col("op"))).groupBy("video_id", "phase").agg(
        F.min(F.col("start_ms") - F.col("wait_ms")).alias("begin"),
        F.max(F.col("start_ms") + F.col("hold_ms")).alias("end"),
        F.sum("wait_ms").alias("queue_ms"),
        F.sum("hold_ms").alias("run_ms"),
        F.count(F.lit(1)).alias("ops"),
        *more,
    )


def _held(ops: DataFrame) -> list[Column]:
    hold = F.col("hold_ms").cast("long")
    return [F.sum(F.col(r) * hold).alias(f"{r}_ms") for r in RESOURCES]


def video_usage(ops: DataFrame) -> DataFrame:
    """Per video `timings` (total_ms and the phases of `time_card`) and `resource_share`, in one pass over the ops."""
    phases = _by_phase(ops, *_held(ops))
    row = F.struct("phase", (F.col("end") - F.col("begin")).alias("wall_ms"), "queue_ms", "run_ms", "ops")
    # At most six phases per video.
    videos = phases.groupBy("video_id").agg(
        (F.max("end") - F.min("begin")).alias("total_ms"), F.array_sort(F.collect_list(row)).alias("rows"),
        *[F.sum(f"{r}_ms").alias(f"{r}_ms") for r in RESOURCES],
    )
    share = lambda p: F.coalesce(F.try_divide(p["wall_ms"], F.col("total_ms")) * 100, F.lit(0.0))
    rows = F.transform("rows", lambda p: p.withField("total_pct", share(p)))
    return videos.select(
        "video_id", F.struct("total_ms", rows.alias("phases")).alias("timings"),
        F.struct(*[f"{r}_ms" for r in RESOURCES]).alias("resource_share"),
    )


def time_card(ops: DataFrame) -> DataFrame:
    """Wall time, summed waits and holds, op count and share of the total per phase.

    An op occupies [start_ms - wait_ms, start_ms + hold_ms); a phase's wall time runs from
    its first request to its last release, and the total likewise over the whole video.
    """
    phases = _by_phase(ops)
    # At most six phase rows per video meet here.
    video = Window.partitionBy("video_id")
    total = F.max("end").over(video) - F.min("begin").over(video)
    wall = F.col("end") - F.col("begin")
    return phases.select(
        "video_id", "phase", wall.alias("wall_ms"), "queue_ms", "run_ms", "ops", total.alias("total_ms")
    ).withColumn("total_pct", F.coalesce(F.try_divide(F.col("wall_ms"), F.col("total_ms")) * 100, F.lit(0.0)))


def op_stats(ops: DataFrame) -> DataFrame:
    """Waits, holds and fallbacks per video, op and level (the level is part of the op name).

    Rows are added up by the raw op text first, so that names are taken apart once per
    distinct text and not once per row.
    """
    measures = ("wait", "hold")
    raw = ops.groupBy("video_id", "op").agg(
        F.count(F.lit(1)).alias("n"),
        *[f(f"{c}_ms").alias(f"{c}_{label}") for c in measures for label, f in (("max", F.max), ("sum", F.sum))],
        F.count_if(F.col("alt_index") > 0).alias("fallbacks"),
    )
    level = F.regexp_extract("op", r"\.cq([0-9]+)$", 1).try_cast("int")
    name = F.regexp_replace("op", r"\.cq[0-9]+$", "")
    merged = raw.withColumns({"op": name, "cq": level}).groupBy("video_id", "op", "cq").agg(
        F.sum("n").alias("n"),
        *[f(f"{c}_{label}").alias(f"{c}_{label}") for c in measures for label, f in (("max", F.max), ("sum", F.sum))],
        F.sum("fallbacks").alias("fallbacks"),
    )
    return merged.withColumns({f"{c}_avg": F.col(f"{c}_sum") / F.col("n") for c in measures})


def resource_share(ops: DataFrame) -> DataFrame:
    """Units held times milliseconds, per video and resource."""
    return ops.groupBy("video_id").agg(*_held(ops))


def resource_totals(share: DataFrame) -> DataFrame:
    """Per-video rows plus one grand-total row (video_id null)."""
    return share.rollup("video_id").agg(*[F.sum(f"{r}_ms").alias(f"{r}_ms") for r in RESOURCES])


def resource_rollup(ops: DataFrame, run: str = "run_id") -> DataFrame:
    """Per video and run, per run, and over all: units held times milliseconds, and ops, in one pass.

    `grain` says what a row adds up (video, run or total); a null run or video in a row of a finer grain is a key that is
    null, not a subtotal.
    """
    grain = F.when(F.grouping_id() == 0, "video").when(F.grouping_id() == 1, "run").otherwise("total")
    return ops.rollup(run, "video_id").agg(grain.alias("grain"), *_held(ops), F.count(F.lit(1)).alias("ops"))


def _long(share: DataFrame) -> DataFrame:
    pairs = [F.struct(F.lit(r).alias("resource"), F.col(f"{r}_ms").alias("ms")) for r in RESOURCES]
    return share.select("video_id", F.inline(F.array(*pairs))).where(F.col("ms") > 0)


def resource_top(share: DataFrame, keep: int = 5) -> DataFrame:
    """The biggest users of every resource and one row for all others.

    Only `keep` rows per resource are ranked; the rest is the total minus those.
    """
    used = _long(share)
    totals = used.groupBy("resource").agg(F.sum("ms").alias("total"), F.count(F.lit(1)).alias("users"))
    order = Window.partitionBy("resource").orderBy(F.col("ms").desc(), F.col("video_id"))
    top = used.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
    row = F.struct(
        F.col("rank"), F.col("video_id").cast("string").alias("video"), F.lit(1).cast("bigint").alias("videos"), F.col("ms")
    )
    # From here on there is one row per resource, four at most, with `keep` entries each.
    lists = top.groupBy("resource").agg(F.collect_list(row).alias("shown"), F.sum("ms").alias("shown_ms"))
    joined = lists.join(F.broadcast(totals), "resource")
    left = F.col("users") - F.size("shown")
    others = F.struct(
        F.lit(keep + 1).alias("rank"), F.lit("others").alias("video"), left.alias("videos"),
        (F.col("total") - F.col("shown_ms")).alias("ms"),
    )
    rows = F.concat("shown", F.array_compact(F.array(F.when(left > 0, others))))
    return joined.select("resource", "total", F.inline(rows)).select(
        "resource", "rank", "video", "videos", "ms", (F.col("ms") * 100 / F.col("total")).alias("pct")
    )


def top_waits(ops: DataFrame, keep: int = 3) -> DataFrame:
    """The longest non-zero waits of every video."""
    tie = [F.col(c) for c in ("start_ms", "op", "hold_ms", "cpu")]
    order = Window.partitionBy("video_id").orderBy(F.col("wait_ms").desc(), *tie)
    waited = ops.where(F.col("wait_ms") > 0)
    return waited.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def thin_events(ops: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The acquire and release events worth keeping; stateless, so it serves streams too.

    Acquires that waited, and releases that woke a waiter or were held long.
    """
    noteworthy = F.filter(
        F.array(
            F.struct(F.lit("acquire").alias("event"), (F.col("wait_ms") > 0).alias("keep")),
            F.struct(
                F.lit("release").alias("event"),
                ((F.col("woken") > 0) | (F.col("hold_ms") >= settings.long_hold_ms)).alias("keep"),
            ),
        ),
        lambda e: e["keep"],
    )
    return ops.select("*", F.explode(noteworthy).alias("__e")).select(*ops.columns, "__e.event")
