"""Stream features from probe properties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmetrics.settings import DEFAULTS, Settings

# Transfer characteristics that mean HDR; default peak in nits.
HDR_TRANSFERS = ("smpte2084", "arib-std-b67")
DEFAULT_PEAK = 1000


def is_actual_video(stream: Column) -> Column:
    """A video stream that is not an attached picture."""
    return F.coalesce(stream["codec_type"] == "video", F.lit(False)) & (
        F.coalesce(stream["disposition"]["attached_pic"], F.lit(0)) != 1
    )


def first_video(streams: Column) -> Column:
    return F.try_element_at(F.filter(streams, is_actual_video), F.lit(1))


def is_usable(duration_s: Column, streams: Column, settings: Settings = DEFAULTS) -> Column:
    any_video = F.coalesce(F.exists(streams, is_actual_video), F.lit(False))
    return any_video & (F.coalesce(duration_s, F.lit(0.0)) > settings.min_duration_s)


def is_hdr(transfer: Column) -> Column:
    return F.coalesce(F.lower(transfer).isin(*HDR_TRANSFERS), F.lit(False))


def bit_depth(pix_fmt: Column) -> Column:
    return F.when(pix_fmt.contains("12"), 12).when(pix_fmt.contains("10"), 10).otherwise(8)


def encode_format(depth: Column) -> Column:
    return F.when(depth >= 10, "p010le").otherwise("nv12")


def compare_format(depth: Column) -> Column:
    return F.when(depth >= 10, "yuv420p10le").otherwise("yuv420p")


def _at_least(width: Column, height: Column, min_w: int | Column, min_h: int | Column) -> Column:
    return (F.coalesce(width, F.lit(0)) >= min_w) | (F.coalesce(height, F.lit(0)) >= min_h)


def score_model(width: Column, height: Column, settings: Settings = DEFAULTS) -> Column:
    _, min_w, min_h, *_ = settings.tiers[0]
    return F.when(_at_least(width, height, min_w, min_h), settings.uhd_model).otherwise(settings.standard_model)


def search_tier(width: Column, height: Column, settings: Settings = DEFAULTS) -> Column:
    """struct<tier,min_cq,max_cq> of the first tier whose width or height bound is met."""
    chosen = None
    for tier, min_w, min_h, low, high in settings.tiers:
        row = F.struct(F.lit(tier).alias("tier"), F.lit(low).alias("min_cq"), F.lit(high).alias("max_cq"))
        met = _at_least(width, height, min_w, min_h)
        chosen = F.when(met, row) if chosen is None else chosen.when(met, row)
    return chosen


def range_problem(low: Column, high: Column) -> Column:
    """Null for a valid search range within 0..63, otherwise what is wrong with it."""
    return (
        F.when(~F.coalesce(low.between(0, 63), F.lit(False)), "min_cq outside 0..63")
        .when(~F.coalesce(high.between(0, 63), F.lit(False)), "max_cq outside 0..63")
        .when(low > high, "min_cq above max_cq")
    )


#: Most rules of a table.
MOST_RULES = 1_000


def split_rules(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable rules, unusable ones with the problem). `rules` has rank, tier, min_width, min_height, min_cq, max_cq."""
    problem = F.coalesce(
        F.when(F.col("rank").isNull() | F.col("tier").isNull(), "rank or tier is missing"),
        F.when(F.col("min_width").isNull() | F.col("min_height").isNull(), "size bound is missing"),
        range_problem(F.col("min_cq"), F.col("max_cq")),
    )
    checked = rules.withColumn("problem", problem)
    return checked.where("problem is null").drop("problem"), checked.where("problem is not null")


def tiers_by_rules(streams: DataFrame, rules: DataFrame, keys: Sequence[str] = ("file_id",)) -> DataFrame:
    """The first rule (by rank, then tier) whose width or height bound a stream meets: tier, min_cq and max_cq, null if none does.

    Rules may overlap. The usable ones, in order, become one array of constants, so that a stream finds its rule without a join;
    more than `MOST_RULES` of them raise an error. A stream without a size counts as 0 x 0.
    """
    usable, _ = split_rules(rules)
    order = ["rank", "tier", "min_cq", "max_cq"]
    ordered = usable.orderBy(*order).select("tier", "min_width", "min_height", "min_cq", "max_cq").limit(MOST_RULES + 1).collect()
    if len(ordered) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    kind = "struct<tier:string,min_width:int,min_height:int,min_cq:int,max_cq:int>"
    table = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in r.asDict().items()]) for r in ordered]).cast(f"array<{kind}>")
    met = F.filter(table, lambda rule: _at_least(F.col("width"), F.col("height"), rule["min_width"], rule["min_height"]))
    found = F.get(met, F.lit(0))
    return streams.select(*keys, *[found[c].alias(c) for c in ("tier", "min_cq", "max_cq")])


def nominal_peak(max_cll: Column, mastering: Column) -> Column:
    return F.when(max_cll > 0, max_cll).when(mastering > 0, mastering).otherwise(F.lit(DEFAULT_PEAK))


def peak_origin(max_cll: Column, mastering: Column) -> Column:
    """Where the peak is said to come from: this looks at presence only, not at the value."""
    return (
        F.when(max_cll.isNotNull(), "max_cll").when(mastering.isNotNull(), "mastering_display").otherwise("default")
    )


def probe_parity(field_order: Column) -> Column:
    text = F.lower(F.trim(field_order))
    return (
        F.when(text.contains("tt") | text.contains("tff"), "tff")
        .when(text.contains("bb") | text.contains("bff"), "bff")
        .otherwise("auto")
    )


def add_features(rows, settings: Settings = DEFAULTS):
    """HDR flag, bit depth, formats, score model and search tier beside the stream columns."""
    width, height = F.col("width"), F.col("height")
    rows = rows.withColumns({"is_hdr": is_hdr(F.col("color_transfer")), "bit_depth": bit_depth(F.col("pix_fmt"))})
    return rows.withColumns(
        {
            "encode_format": encode_format(F.col("bit_depth")),
            "compare_format": compare_format(F.col("bit_depth")),
            "score_model": score_model(width, height, settings),
            "search": search_tier(width, height, settings),
        }
    )
