"""Frame counts and 3:2 cadence metrics per video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmetrics.operators.ordered import SLICE, with_slice
from reelmetrics.settings import DEFAULTS, Settings

# Fixed value: above this share of undetermined frames a video is flagged.
UNDETERMINED_WARN = 0.02
SPAN = 5
# Frame codes: one small number goes through the shuffle instead of a text, and the sum over
# five frames modulo FIELD tells how many of them are progressive (1 each) and interlaced (8 each).
FIELD = 64
CODES = {"progressive": 1, "tff": 8, "bff": 8 + FIELD, "undetermined": 0}
MATCH = 3 * CODES["progressive"] + 2 * CODES["tff"]


def _share(part: Column, whole: Column, empty: float) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(empty))


def _derived(counts: DataFrame) -> DataFrame:
    interlaced = F.col("tff") + F.col("bff")
    classified = F.col("progressive") + interlaced
    total = classified + F.col("undetermined")
    return counts.withColumns(
        {
            "interlaced": interlaced,
            "total": total,
            "progressive_fraction": _share(F.col("progressive"), classified, 1.0),
            "undetermined_share": _share(F.col("undetermined"), total, 0.0),
            "undetermined_high": _share(F.col("undetermined"), total, 0.0) > UNDETERMINED_WARN,
        }
    )


def _counts() -> list[Column]:
    known = [F.count_if(F.col("flag") == f).alias(f) for f in ("progressive", "tff", "bff")]
    other = F.count_if(~F.coalesce(F.col("flag"), F.lit("")).isin("progressive", "tff", "bff"))
    return [*known, other.alias("undetermined")]


def _look_ahead(rows: DataFrame, *keys: str) -> DataFrame:
    """Adds span (the codes of this and the next four frames added up), centre and is_head.

    The span is null where fewer than four frames follow.  Plain look-ahead is several
    times cheaper here than aggregates over a moving frame.
    """
    order = Window.partitionBy(*keys).orderBy("frame_idx")
    following = [F.lead("code", n).over(order).alias(f"__f{n}") for n in range(1, SPAN)]
    seen = rows.select("*", *following, F.lag("code", SPAN - 1).over(order).isNull().alias("is_head"))
    span = F.col("code")
    for n in range(1, SPAN):
        span = span + F.col(f"__f{n}")
    return seen.withColumns({"span": span, "centre": F.col(f"__f{SPAN // 2}")}).drop(*[f"__f{n}" for n in range(1, SPAN)])


def _tallies(counted: Column) -> dict[str, Column]:
    """What to count among the rows that open a whole window."""
    hit, centred = F.col("span") % FIELD == MATCH, F.col("centre") >= CODES["tff"]
    return {
        "windows": counted,
        "matches": counted & hit,
        "centres": counted & centred,
        "centre_matches": counted & centred & hit,
    }


def frame_counts(frames: DataFrame) -> DataFrame:
    """One row per video: frames by flag and the shares derived from them."""
    return _derived(frames.groupBy("video_id").agg(*_counts()))


def frame_metrics(frames: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Frame counts plus cadence rate and interlaced-in-cadence ratio.

    A window is five consecutive frames in order; it matches when it holds three
    progressive and two interlaced ones.  Undetermined frames take a place but count
    as neither.  The same window serves both metrics: its third frame is the centre.

    Videos are cut into slices of `frame_slice` frames.  Windows inside a slice are
    settled there; the at most eight frames at a slice's two ends go on to a second,
    tiny pass that settles the windows crossing slice borders.
    """
    flag = F.col("flag")
    code = F.when(flag == "progressive", CODES["progressive"]).when(flag == "tff", CODES["tff"]).when(flag == "bff", CODES["bff"])
    rows = frames.select("video_id", "frame_idx", code.otherwise(CODES["undetermined"]).alias("code"))
    rows = with_slice(rows, "frame_idx", settings.frame_slice)
    viewed = _look_ahead(rows, "video_id", SLICE)
    is_open = F.col("span").isNull()
    tallies = _tallies(~is_open)
    at_edge = F.when(is_open | F.col("is_head"), F.struct("frame_idx", "code", is_open.alias("open")))
    tallies = {name: F.col("code") == code for name, code in CODES.items()} | tallies
    names = list(tallies)
    slices = viewed.groupBy("video_id", SLICE).agg(
        *[F.count_if(t).alias(n) for n, t in tallies.items()], F.collect_list(at_edge).alias("edge")
    )
    # Each slice's tallies travel with its first edge frame only.
    edges = slices.select("video_id", *names, F.posexplode("edge")).select(
        "video_id", "col.*", *[F.when(F.col("pos") == 0, F.col(n)).otherwise(F.lit(0)).alias(n) for n in names],
    )
    crossing = _tallies(F.col("open") & F.col("span").isNotNull())
    edges = _look_ahead(edges, "video_id")
    sums = [(F.sum(n) + F.count_if(crossing[n])).alias(n) if n in crossing else F.sum(n).alias(n) for n in names]
    summed = edges.groupBy("video_id").agg(*sums)
    return _derived(summed).withColumns(
        {
            "cadence_rate": _share(F.col("matches"), F.col("windows"), 0.0),
            "i_in_cadence": _share(F.col("centre_matches"), F.col("centres"), 0.0),
        }
    ).drop(*crossing)
