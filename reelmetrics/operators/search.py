"""Bisection for the highest passing level, for all videos at once."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmetrics.functions.probe import range_problem
from reelmetrics.operators.quality import gates, level_stats, passes
from reelmetrics.settings import DEFAULTS, Settings
from reelmetrics.sources.folders import shared_folder

# 64 levels (0..63) need at most seven probes.
MAX_PROBES = 7


def cut_lineage(rows: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder that driver and executors share."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(rows.sparkSession))
    return rows.checkpoint(eager=True)


def _middle(low: Column, high: Column) -> Column:
    return F.floor((low + high + 1) / 2).cast("int")


def expected_probes(low: Column, high: Column) -> Column:
    return F.ceil(F.log2((high - low + 2).cast("double"))).cast("int")


def _searchable() -> Column:
    return F.coalesce(F.col("cq").between(0, 63), F.lit(False))


def level_rejects(levels: DataFrame) -> DataFrame:
    """Level rows that a search cannot use, with the reason."""
    reason = F.when(F.col("cq").isNull(), "level is missing").otherwise("level is outside 0..63")
    return levels.where(~_searchable()).withColumn("reason", reason)


def grouped_levels(levels: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Per video the passing and the measured levels as 64-bit sets, and the level rows.

    Levels outside 0..63 cannot be searched, so a video has 64 rows at most; see `level_rejects`.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("cq").cast("int"))
    known = levels.where(_searchable()).withColumn("__ok", passes(settings))
    facts = F.struct(*[c for c in levels.columns if c != "video_id"])
    return known.groupBy("video_id").agg(
        F.bit_or(F.when(F.col("__ok"), bit)).alias("passing"),
        F.bit_or(bit).alias("measured"),
        F.collect_list(facts).alias("levels"),
    )


def _has(bits: Column, level: Column) -> Column:
    return F.call_function("shiftrightunsigned", bits, level).bitwiseAND(F.lit(1).cast("long")) == 1


def bisect(levels: DataFrame, ranges: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Run the search of every video over levels that are all measured already.

    `ranges` has video_id, min_cq, max_cq.  Returns the best level (null if none passed),
    the number of probes, the steps taken and the video's level rows; a level that was
    never measured counts as failing and is marked so.
    """
    rows = ranges.where(range_problem(F.col("min_cq"), F.col("max_cq")).isNull()).join(
        grouped_levels(levels, settings), "video_id", "left"
    )
    none = F.lit(0).cast("long")
    rows = rows.withColumns({"passing": F.coalesce("passing", none), "measured": F.coalesce("measured", none)})
    step_type = "array<struct<step:int,lo:int,hi:int,cq:int,passed:boolean,measured:boolean>>"
    start = F.struct(
        F.col("min_cq").cast("int").alias("lo"),
        F.col("max_cq").cast("int").alias("hi"),
        F.lit(None).cast("int").alias("best"),
        F.array().cast(step_type).alias("steps"),
    )

    def probe(state: Column, number: Column) -> Column:
        mid = _middle(state["lo"], state["hi"])
        ok = _has(F.col("passing"), mid)
        step = F.struct(
            number.cast("int").alias("step"), state["lo"].alias("lo"), state["hi"].alias("hi"), mid.alias("cq"),
            ok.alias("passed"), _has(F.col("measured"), mid).alias("measured"),
        )
        moved = F.struct(
            F.when(ok, mid + 1).otherwise(state["lo"]).cast("int").alias("lo"),
            F.when(ok, state["hi"]).otherwise(mid - 1).cast("int").alias("hi"),
            F.when(ok, mid).otherwise(state["best"]).cast("int").alias("best"),
            F.concat(state["steps"], F.array(step)).cast(step_type).alias("steps"),
        )
        return F.when(state["lo"] <= state["hi"], moved).otherwise(state)

    done = F.aggregate(F.sequence(F.lit(1), F.lit(MAX_PROBES)), start, probe)
    return rows.withColumn("__d", done).select(
        "video_id", "min_cq", "max_cq",
        F.col("__d.best").alias("best_cq"),
        F.size("__d.steps").alias("probes"),
        expected_probes(F.col("min_cq"), F.col("max_cq")).alias("expected_probes"),
        F.col("__d.steps").alias("steps"),
        "levels",
    )


def bisect_trace(levels: DataFrame, ranges: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row per probe, in order, with the bounds it was taken from."""
    return bisect(levels, ranges, settings).select("video_id", F.inline("steps"))


def probed_levels(levels: DataFrame, ranges: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The level rows a search would really have measured."""
    taken = F.transform("steps", lambda s: s["cq"])
    kept = F.filter("levels", lambda row: F.array_contains(taken, row["cq"].cast("int")))
    return bisect(levels, ranges, settings).select("video_id", F.inline(kept))


def search_levels(
    ranges: DataFrame,
    measure: Callable[[DataFrame], DataFrame],
    settings: Settings = DEFAULTS,
) -> tuple[DataFrame, DataFrame]:
    """Search with scores produced on demand, all videos moving one step per round.

    `measure` turns rows of (video_id, cq) into score rows (video_id, cq, score).  It is
    called at most seven times, each time with every unfinished video's next level.
    Returns (state with best_cq and probes, trace with one row per probe).  Every
    round is checkpointed, so a lost executor costs the current round only.
    """
    valid = range_problem(F.col("min_cq"), F.col("max_cq")).isNull()
    state = ranges.where(valid).select(
        "video_id",
        F.col("min_cq").cast("int").alias("lo"),
        F.col("max_cq").cast("int").alias("hi"),
        F.lit(None).cast("int").alias("best_cq"),
        F.lit(0).alias("probes"),
    )
    rounds = []
    for number in range(1, MAX_PROBES + 1):
        asked = state.where(F.col("lo") <= F.col("hi")).select(
            "video_id", _middle(F.col("lo"), F.col("hi")).alias("cq")
        )
        if asked.isEmpty():
            break
        stats = gates(level_stats(measure(asked)), settings)
        answers = asked.join(stats, ["video_id", "cq"], "left")
        taken = cut_lineage(state.join(answers, "video_id", "left").withColumn("step", F.lit(number)))
        probed = taken.where(F.col("cq").isNotNull())
        rounds.append(probed.select("video_id", "step", "lo", "hi", *stats.columns[1:]))
        active, ok = F.col("cq").isNotNull(), F.coalesce(F.col("passed"), F.lit(False))
        state = taken.select(
            "video_id",
            F.when(active & ok, F.col("cq") + 1).otherwise(F.col("lo")).alias("lo"),
            F.when(active & ~ok, F.col("cq") - 1).otherwise(F.col("hi")).alias("hi"),
            F.when(active & ok, F.col("cq")).otherwise(F.col("best_cq")).alias("best_cq"),
            (F.col("probes") + active.cast("int")).alias("probes"),
        )
    if not rounds:  # no usable range: a trace without rows
        none = gates(level_stats(measure(state.select("video_id", F.col("lo").alias("cq")).where("false"))), settings)
        rounds = [state.select("video_id", F.lit(1).alias("step"), "lo", "hi").join(none, "video_id").select("video_id", "step", "lo", "hi", *none.columns[1:])]
    trace = reduce(DataFrame.unionByName, rounds)
    return state.select("video_id", "best_cq", "probes"), trace
