"""System samples: CPU use from counters, busy shares, checkpoints, hints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmetrics.operators.ordered import ordered_scan
from reelmetrics.settings import DEFAULTS, Settings

# When a pool counts as busy while the hardware idles; memory headroom in MB.
BUSY_PCT = 75.0
IDLE_PCT = 30.0
HEADROOM_MB = 1024

POOLS = ("cpu", "nvenc", "nvdec", "cuda")
GAUGES = ("gpu_pct", "mem_pct", "vram_mb", "nvenc_sessions")


def busy_share(total: Column, idle: Column, previous_total: Column, previous_idle: Column) -> Column:
    """CPU percent between two counter readings; 0 without a usable earlier reading."""
    passed = total - previous_total
    idled = F.greatest(idle - previous_idle, F.lit(0))
    return F.when(passed > 0, F.try_divide((passed - idled) * 100.0, passed)).otherwise(F.lit(0.0))


def cpu_pct(ticks: DataFrame, keys: Sequence[str] = ("host",), settings: Settings = DEFAULTS) -> DataFrame:
    """Adds cpu_pct from the cumulative counters cpu_total and cpu_idle (idle + iowait)."""
    scanned = ordered_scan(
        ticks, keys, "tick_ms", settings.tick_slice_ms,
        previous={"__total": "cpu_total", "__idle": "cpu_idle"},
    )
    share = busy_share(F.col("cpu_total"), F.col("cpu_idle"), F.col("__total"), F.col("__idle"))
    return scanned.withColumn("cpu_pct", share).drop("__total", "__idle")


def _partials(columns: Sequence[str]) -> list[Column]:
    parts = [F.count(F.lit(1)).alias("samples")]
    for pool in POOLS:
        if f"{pool}_free" in columns:
            free = F.col(f"{pool}_free")
            parts += [F.sum(free).alias(f"{pool}_free_sum"), F.min(free).alias(f"{pool}_free_min")]
    for gauge in ("cpu_pct", *GAUGES):
        if gauge in columns:
            g = F.col(gauge)
            parts += [F.sum(g).alias(f"{gauge}_sum"), F.count(g).alias(f"{gauge}_n"), F.max(g).alias(f"{gauge}_max")]
    return parts


def _summary(columns: Sequence[str], settings: Settings) -> list[Column]:
    shown = [F.col("samples")]
    for pool in POOLS:
        if f"{pool}_free_sum" in columns:
            total = getattr(settings, f"{pool}_total")
            free = F.col(f"{pool}_free_sum") / F.col("samples")
            busy = (F.lit(float(total)) - free) * 100.0 / total if total > 0 else F.lit(0.0)
            shown += [busy.alias(f"{pool}_busy_pct"), F.col(f"{pool}_free_min")]
    for gauge in ("cpu_pct", *GAUGES):
        if f"{gauge}_sum" in columns:
            shown += [
                F.try_divide(F.col(f"{gauge}_sum"), F.col(f"{gauge}_n")).alias(f"{gauge}_avg"),
                F.col(f"{gauge}_max"),
            ]
    return shown


def tick_summary(ticks: DataFrame, keys: Sequence[str] = ("host",), settings: Settings = DEFAULTS) -> DataFrame:
    """Declared busy shares beside real averages and peaks; gauges nobody reported stay null.

    Only sums, counts and extremes are kept, so batch and stream share it.
    """
    partial = ticks.groupBy(*keys).agg(*_partials(ticks.columns))
    return partial.select(*keys, *_summary(partial.columns, settings))


def checkpoints(ticks: DataFrame, keys: Sequence[str] = ("host",), settings: Settings = DEFAULTS) -> DataFrame:
    """The summary since the start, at the end of every checkpoint interval.

    Samples are added up per interval first; only interval rows are accumulated.
    """
    bucket = F.floor(F.col("tick_ms") / settings.checkpoint_ms).alias("bucket")
    partial = ticks.groupBy(*keys, bucket).agg(*_partials(ticks.columns))
    upto = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    names = [c for c in partial.columns if c not in (*keys, "bucket")]
    combine = {"_min": F.min, "_max": F.max}
    running = partial.select(
        *keys, "bucket", *[combine.get(n[-4:], F.sum)(n).over(upto).alias(n) for n in names]
    )
    return running.select(
        *keys, ((F.col("bucket") + 1) * settings.checkpoint_ms).alias("until_ms"), *_summary(running.columns, settings)
    )


def util_hints(summary: DataFrame, settings: Settings = DEFAULTS, vram_total_mb: int | None = None) -> DataFrame:
    """Adds `hints`: pools that look busy while the hardware idles, and scarce GPU memory."""
    have = set(summary.columns)
    idle = {"cpu": "cpu_pct_avg", "nvdec": "gpu_pct_avg", "cuda": "gpu_pct_avg", "nvenc": "nvenc_sessions_avg"}
    hints = []
    for pool in POOLS:
        real = idle[pool]
        if f"{pool}_busy_pct" not in have or real not in have:
            continue
        share = F.col(real)
        if pool == "nvenc":
            share = share * 100.0 / settings.nvenc_total if settings.nvenc_total > 0 else F.lit(None).cast("double")
        hints.append(F.when((F.col(f"{pool}_busy_pct") >= BUSY_PCT) & (share <= IDLE_PCT), f"{pool}_underused"))
    if vram_total_mb is not None and "vram_mb_max" in have:
        hints.append(F.when(F.lit(vram_total_mb) - F.col("vram_mb_max") < HEADROOM_MB, "vram_near_limit"))
    texts = F.array(*hints).cast("array<string>") if hints else F.array().cast("array<string>")
    return summary.withColumn("hints", F.array_compact(texts))
