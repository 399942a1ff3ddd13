"""Interval and range joins as equi-joins on buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmetrics.functions.rates import add_rates
from reelmetrics.operators.ordered import KEY, ordered_scan
from reelmetrics.settings import DEFAULTS, Settings

RESOURCES = ("cpu", "nvenc", "nvdec", "cuda")


# Ops are kept in buckets about as wide as they are long: each step is so many times the one before.
STEP, STEPS = 8, 7


def held_ops(
    ticks: DataFrame, ops: DataFrame, keys: Sequence[str], bucket_ms: int = 10_000, salts: int = 64
) -> DataFrame:
    """Every (tick, op) pair of the same `keys` with the tick inside [start_ms, start_ms + hold_ms).

    An op is repeated for the at most nine buckets of its own width that it touches (only ops longer than all
    widths touch more), a tick lies in one bucket of each width, so each pair meets once.  The ops of a bucket
    are spread over parts, and its ticks repeated for the parts that have ops, so a burst of ops is shared by
    several tasks.  Keys may be null; rows without a time pair with nothing.
    """
    width = lambda step: (F.lit(bucket_ms) * F.pow(F.lit(STEP), step)).cast("bigint")
    bucket = lambda c, step: F.floor(c / width(step))
    end = F.col("start_ms") + F.col("hold_ms")
    step = F.least(F.greatest(F.ceil(F.log(float(STEP), F.col("hold_ms") / bucket_ms)), F.lit(0)), F.lit(STEPS - 1)).cast("int")
    part = F.pmod(F.xxhash64(*[c for c in ops.columns if c not in keys]), F.lit(salts)).cast("int")
    held = ops.where((F.col("hold_ms") > 0) & F.col("start_ms").isNotNull())
    held = held.select("*", end.alias("end_ms"), part.alias("__salt"), step.alias("__step"), F.struct(*keys).alias(KEY))
    touched = F.sequence(bucket(F.col("start_ms"), F.col("__step")), bucket(F.col("end_ms") - 1, F.col("__step")))
    held = held.withColumn("__bucket", F.explode(touched))
    place = [KEY, "__step", "__bucket"]
    parts = held.groupBy(*place).agg(F.collect_set("__salt").alias("__salts"))
    at = ticks.where(F.col("tick_ms").isNotNull()).select(
        F.struct(*keys).alias(KEY), "tick_id", "tick_ms", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))).alias("__step")
    ).withColumn("__bucket", bucket(F.col("tick_ms"), F.col("__step")))
    at = at.join(parts, place).withColumn("__salt", F.explode("__salts")).drop("__salts")
    inside = (F.col("tick_ms") >= F.col("start_ms")) & (F.col("tick_ms") < F.col("end_ms"))
    pairs = at.join(held, [*place, "__salt"]).where(inside)
    return pairs.select(*keys, "tick_id", "tick_ms", *[c for c in ops.columns if c not in keys])


def held_load(ticks: DataFrame, ops: DataFrame, keys: Sequence[str], slice_ms: int = 3_600_000) -> DataFrame:
    """Number of ops and units of each resource held at every tick of the same `keys`, without forming pairs.

    Each op adds its units when it starts and takes them back when it ends; the running total at a tick's
    time is what is held.  Ticks go through the sweep as rows of their own.  Work grows with ops + ticks, not
    with pairs.  Keys may be null; at a tick without a time nothing is known.
    """
    names = ["ops", *RESOURCES]
    both = F.array(
        F.struct(F.col("start_ms").alias("at"), F.lit(1).alias("sign")),
        F.struct((F.col("start_ms") + F.col("hold_ms")).alias("at"), F.lit(-1).alias("sign")),
    )
    timed = ops.where((F.col("hold_ms") > 0) & F.col("start_ms").isNotNull())
    changes = timed.select(*keys, *RESOURCES, F.lit(1).alias("ops"), F.inline(both))
    changes = changes.groupBy(*keys, "at").agg(*[F.sum(F.col(n) * F.col("sign")).alias(f"d_{n}") for n in names])
    # At one time changes come first; ticks add nothing, so their order among each other does not matter.
    moments = changes.withColumns({"order": F.col("at") * 2, "is_tick": F.lit(False)}).unionByName(
        ticks.select(
            *keys, "tick_id", F.col("tick_ms").alias("at"), (F.col("tick_ms") * 2 + 1).alias("order"), F.lit(True).alias("is_tick"),
            *[F.lit(0).cast("bigint").alias(f"d_{n}") for n in names],
        ),
        allowMissingColumns=True,
    )
    totals = ordered_scan(moments, keys, "order", 2 * slice_ms, totals={f"held_{n}": F.col(f"d_{n}") for n in names})
    known = [F.when(F.col("at").isNotNull(), F.col(f"held_{n}")).alias(f"held_{n}") for n in names]
    return totals.where("is_tick").select(*keys, "tick_id", F.col("at").alias("tick_ms"), *known)


def frame_ranges(windows: DataFrame, streams: DataFrame) -> DataFrame:
    """Sample windows in seconds to whole frame numbers [first_frame, last_frame]."""
    fps = add_rates(streams).select("video_id", "fps")
    return windows.join(fps, "video_id").select(
        "video_id", "sample_idx",
        F.ceil(F.col("start_s") * F.col("fps")).alias("first_frame"),
        (F.ceil((F.col("start_s") + F.col("length_s")) * F.col("fps")) - 1).alias("last_frame"),
    )


def window_frames(frames: DataFrame, spans: DataFrame, bucket: int = 512) -> DataFrame:
    """Frames inside the spans (video_id, sample_idx, first_frame, last_frame).

    Joined on (video, frame bucket), so a long video spreads over many tasks; a span
    repeats once per bucket it touches.  Spark broadcasts the spans when they turn out small.
    """
    cut = spans.where(F.col("first_frame") <= F.col("last_frame")).select(
        "video_id", "sample_idx", "first_frame", "last_frame",
        F.explode(F.sequence(F.floor(F.col("first_frame") / bucket), F.floor(F.col("last_frame") / bucket))).alias("__b"),
    )
    rows = frames.withColumn("__b", F.floor(F.col("frame_idx") / bucket))
    inside = F.col("frame_idx").between(F.col("first_frame"), F.col("last_frame"))
    return rows.join(cut, ["video_id", "__b"]).where(inside).drop("__b", "first_frame", "last_frame")
