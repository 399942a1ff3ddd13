"""Score statistics per video and level, gates, outliers and level selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmetrics.settings import DEFAULTS, Settings

# Fixed value: the tail percentiles every level is judged by.
PERCENTILES = {"p05": 0.05, "p01": 0.01}
LEVEL = ["video_id", "cq"]
# Scores lie in 0..100; this many cells per point, and so many parts of the few cells that hold a wanted rank,
# bound what any task sees at once.
CELLS_PER_POINT, PARTS = 64, 4096


def _cell(score: Column) -> Column:
    """Order-preserving cell number; scores outside 0..100 fall into the end cells.

    It is never null by type, so a join on it adds no filter and both sides of the join
    in `level_stats` read the same shuffle.
    """
    return F.coalesce(F.floor(F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0)) * CELLS_PER_POINT), F.lit(0))


def level_stats(scores: DataFrame) -> DataFrame:
    """Mean, harmonic mean, exact interpolated p05/p01, minimum and count per level.

    A level without any score has mean, harmonic mean and minimum 0, no percentiles and count 0.  A level
    with a score that is not a number has a count but no statistics, so that it meets no gate.

    The percentiles are found by rank, without bringing a level's scores together:
    equal scores are counted first (map side), counts are added up per cell, the few
    cells that hold the wanted ranks are looked up, cut once more between their own least and
    greatest score, and only the values of the parts with a wanted rank are ordered.
    """
    counted = (
        scores.groupBy(*LEVEL, F.col("score").cast("double").alias("score"))
        .agg(F.count("score").alias("n"))
        .withColumn("cell", _cell(F.col("score")))
    )
    cells = counted.groupBy(*LEVEL, "cell").agg(
        F.sum("n").alias("c"),
        F.sum(F.col("n") * F.col("score")).alias("s"),
        F.min("score").alias("low"),
        F.max("score").alias("high"),
        F.sum(F.when(F.col("score") > 0, F.col("n"))).alias("positive"),
        F.sum(F.when(F.col("score") > 0, F.col("n") / F.col("score"))).alias("inverse"),
        F.max(F.coalesce(F.isnan("score"), F.lit(False))).alias("odd"),
    )
    level = Window.partitionBy(*LEVEL)
    before = level.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        *LEVEL, "cell", "c", F.col("low").alias("least"), "high",
        F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"),
        F.sum("c").over(level).alias("total"),
        F.sum("s").over(level).alias("s"),
        F.min("low").over(level).alias("min"),
        F.sum("positive").over(level).alias("positive"),
        F.sum("inverse").over(level).alias("inverse"),
        F.max("odd").over(level).alias("odd"),
    )
    ranks = {name: (F.col("total") - 1) * F.lit(p) for name, p in PERCENTILES.items()}
    wanted = {}
    for name, rank in ranks.items():
        wanted[f"{name}_lo"], wanted[f"{name}_hi"] = F.floor(rank), F.ceil(rank)
    # An empty level has one cell, which is kept as it is.
    in_cell = F.col("total") == 0
    for position in wanted.values():
        in_cell = in_cell | ((position >= F.col("start")) & (position < F.col("start") + F.col("c")))
    hits = cells.where(in_cell).drop("c")

    # The parts of a hit cell: the same once more, from its start.
    within = (F.col("score") - F.col("least")) * PARTS / (F.col("high") - F.col("least"))
    part = F.coalesce(F.when(F.col("high") > F.col("least"), F.floor(F.least(within, F.lit(PARTS - 1.0)))), F.lit(0))
    inside = counted.join(hits, [*LEVEL, "cell"]).withColumn("part", part)
    facts = ("start", "total", "s", "min", "positive", "inverse", "odd")
    sizes = inside.groupBy(*LEVEL, "cell", "part").agg(F.sum("n").alias("c"), *[F.first(c).alias(c) for c in facts])
    ahead = Window.partitionBy(*LEVEL, "cell").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("start", F.col("start") + F.coalesce(F.sum("c").over(ahead), F.lit(0)))
    chosen = sizes.where(in_cell).drop("c")

    ordered = Window.partitionBy(*LEVEL, "cell", "part").orderBy("score")
    ranked = (
        inside.select(*LEVEL, "cell", "part", "score", "n").join(chosen, [*LEVEL, "cell", "part"])
        .withColumn("end", F.col("start") + F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("begin", F.col("end") - F.col("n"))
    )
    picked = [
        F.max(F.when((pos >= F.col("begin")) & (pos < F.col("end")), F.col("score"))).alias(name)
        for name, pos in wanted.items()
    ]
    kept = [F.first(c).alias(c) for c in ("total", "s", "min", "positive", "inverse", "odd")]
    found = ranked.groupBy(*LEVEL).agg(*picked, *kept)

    def interpolated(name: str) -> Column:
        weight = ranks[name] - F.floor(ranks[name])
        return F.col(f"{name}_lo") * (F.lit(1.0) - weight) + F.col(f"{name}_hi") * weight

    zero = F.lit(0.0)
    known = {
        "mean": F.coalesce(F.try_divide(F.col("s"), F.col("total")), zero),
        "harmonic": F.coalesce(F.try_divide(F.col("positive"), F.col("inverse")), zero),
        **{name: interpolated(name) for name in PERCENTILES},
        "min": F.coalesce("min", zero),
    }
    return found.select(
        *LEVEL, *[F.when(~F.col("odd"), value).alias(name) for name, value in known.items()], F.col("total").alias("n")
    )


def level_stats_approx(scores: DataFrame, accuracy: int = 10000) -> DataFrame:
    """The same columns in one aggregation, with approximate percentiles."""
    s = F.col("score").cast("double")
    fine = ~F.coalesce(F.max(F.isnan(s)), F.lit(False))
    zero = F.lit(0.0)
    tails = [F.when(fine, F.percentile_approx(s, p, accuracy)).alias(name) for name, p in PERCENTILES.items()]
    harmonic = F.try_divide(F.count_if(s > 0), F.sum(F.when(s > 0, F.lit(1.0) / s)))
    return scores.groupBy(*LEVEL).agg(
        F.when(fine, F.coalesce(F.avg(s), zero)).alias("mean"),
        F.when(fine, F.coalesce(harmonic, zero)).alias("harmonic"),
        *tails,
        F.when(fine, F.coalesce(F.min(s), zero)).alias("min"),
        F.count(s).alias("n"),
    )


#: Items that a sketch of scores keeps: percentiles of at most so many scores are exact, of more within about 2.3 / k^0.9 of the rank.
SKETCH = 4096


def score_sketches(scores: DataFrame, keys: Sequence[str] = ("day",), k: int = SKETCH) -> DataFrame:
    """Per level and `keys` what can be added up later without the scores: a quantile sketch, counts, sums and the minimum.

    Rows of these can be kept day by day, and `merged_sketches` makes the statistics of any days of them.
    """
    s = F.col("score").cast("double")
    real = F.when(~F.isnan(s), s)
    return scores.groupBy(*LEVEL, *keys).agg(
        F.kll_sketch_agg_double(real, k).alias("sketch"),
        F.count(s).alias("n"),
        F.sum(s).alias("sum"),
        F.count_if(s > 0).alias("positive"),
        F.sum(F.when(s > 0, F.lit(1.0) / s)).alias("inverse"),
        F.min(real).alias("min"),
        F.coalesce(F.max(F.isnan(s)), F.lit(False)).alias("odd"),
    )


def merged_sketches(sketches: DataFrame, k: int = SKETCH) -> DataFrame:
    """The columns of `level_stats` from rows of `score_sketches`; a percentile is the least score that so many scores do not exceed."""
    summed = sketches.groupBy(*LEVEL).agg(
        F.kll_merge_agg_double("sketch", k).alias("sketch"),
        *[F.sum(c).alias(c) for c in ("n", "sum", "positive", "inverse")], F.min("min").alias("min"), F.max("odd").alias("odd"),
    )
    zero, some = F.lit(0.0), F.col("n") > 0
    known = {
        "mean": F.coalesce(F.try_divide(F.col("sum"), F.col("n")), zero),
        "harmonic": F.coalesce(F.try_divide(F.col("positive"), F.col("inverse")), zero),
        **{name: F.when(some, F.kll_sketch_get_quantile_double("sketch", F.lit(p))) for name, p in PERCENTILES.items()},
        "min": F.coalesce("min", zero),
    }
    return summed.select(*LEVEL, *[F.when(~F.col("odd"), value).alias(name) for name, value in known.items()], "n")


def _met(column: str, target: float) -> Column:
    """A value that is missing or not a number misses the gate (it would sort above all numbers)."""
    return F.coalesce((F.col(column) >= target) & ~F.isnan(column), F.lit(False))


def passes(settings: Settings = DEFAULTS) -> Column:
    met = F.lit(True)
    for column, target in settings.targets:
        met = met & _met(column, target)
    return met


def failure_text(settings: Settings = DEFAULTS, row: str = "") -> Column:
    """`all gates met`, or for every gate that was missed what it needs and what there is."""
    missed = [
        F.when(~_met(row + c, t), F.format_string(f"{c} needs {t:.1f}, has %s", F.coalesce(F.format_number(row + c, 2), F.lit("none"))))
        for c, t in settings.targets
    ]
    text = F.concat_ws("; ", *missed)
    return F.when(text == "", F.lit("all gates met")).otherwise(text)


def gates(levels: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One boolean per gate, the verdict, the missed gates, and the same as text with values."""
    rows = levels.withColumns({f"{c}_ok": _met(c, t) for c, t in settings.targets})
    missed = F.array_compact(F.array(*[F.when(~F.col(f"{c}_ok"), c) for c, _ in settings.targets]))
    return rows.withColumns({"passed": passes(settings), "missed": missed, "failure": failure_text(settings)})


def sample_means(scores: DataFrame) -> DataFrame:
    return scores.groupBy(*LEVEL, "sample_idx").agg(F.avg("score").alias("mean"), F.count("score").alias("n"))


def sample_outliers(scores: DataFrame, keep: int = 3) -> DataFrame:
    """The samples with the lowest mean of every level."""
    # Means are compared to nine digits: beyond that the order of summation shows.
    worst = Window.partitionBy(*LEVEL).orderBy(F.round("mean", 9).asc(), F.col("sample_idx").asc())
    ranked = sample_means(scores).where(F.col("mean").isNotNull()).withColumn("rank", F.row_number().over(worst))
    return ranked.where(F.col("rank") <= keep)


def select_level(levels: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Highest passing level per video, else the best mean (ties: the lowest level)."""
    facts = F.struct(*[c for c in levels.columns if c != "video_id"])
    chosen = levels.groupBy("video_id").agg(
        F.max_by(facts, F.when(passes(settings), F.col("cq"))).alias("best"),
        F.max_by(facts, F.struct(F.round("mean", 9), -F.col("cq"))).alias("fallback"),
    )
    gates_text = ", ".join(f"{c}>={t:.1f}" for c, t in settings.targets)
    return chosen.select(
        "video_id",
        F.coalesce("best", "fallback").alias("__s"),
        F.col("best").isNull().alias("fell_short"),
    ).select(
        "video_id", "__s.*", "fell_short",
        F.when(F.col("fell_short"), "no level met every gate; best mean taken")
        .otherwise(f"highest level with {gates_text}")
        .alias("reason"),
    )


def add_neighbours(levels: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds the measured levels one above and one below as `above` and `below`.

    A video has at most 64 levels, which is all that meets in this window.
    """
    facts = F.struct("cq", *[c for c, _ in settings.targets], failure_text(settings).alias("failure"))
    video = Window.partitionBy("video_id").orderBy("cq")
    sides = {"above": F.lead("__f").over(video), "below": F.lag("__f").over(video)}
    rows = levels.withColumn("__f", facts).withColumns(sides)
    for side, shift in (("above", 1), ("below", -1)):
        rows = rows.withColumn(side, F.when(F.col(f"{side}.cq") == F.col("cq") + shift, F.col(side)))
    return rows.drop("__f")


def add_marginal(selection: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Flag picks close to a gate.  Neighbours, where selected along, stay for those only."""
    near = [
        F.when(
            F.abs(F.col(c) - t) < settings.marginal_band,
            F.format_string(f"{c}=%.2f is within {settings.marginal_band} of {t:.1f}", F.col(c)),
        )
        for c, t in settings.targets
    ]
    short = F.format_string(f"no level met every gate, best mean %.2f (target {settings.target_mean:.1f})", F.col("mean"))
    reasons = F.when(F.col("fell_short"), F.array(short)).otherwise(F.array_compact(F.array(*near)))
    rows = selection.withColumn("marginal_reasons", reasons)
    rows = rows.withColumn("is_marginal", F.size("marginal_reasons") > 0)
    shown = F.col("is_marginal") & ~F.col("fell_short")
    sides = [c for c in ("above", "below") if c in rows.columns]
    return rows.withColumns({c: F.when(shown, F.col(c)) for c in sides}) if sides else rows
