"""Chapters: report, episode ranges, cut manifest and renumbered chapter documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmetrics.functions.once import settled
from reelmetrics.functions.text import episode_name, normalize_timecode, timecode_seconds
from reelmetrics.operators.ordered import SLICE, with_slice
from reelmetrics.settings import DEFAULTS, Settings

CHAPTER = ["disc_id", "chapter_idx"]


def add_times(chapters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Time codes to seconds.  Returns (good rows, rows whose time code is not one)."""
    columns = [c for c in chapters.columns if c not in ("start_text", "end_text")]
    times = F.struct(
        normalize_timecode(F.col("start_text")).alias("start_text"),
        normalize_timecode(F.col("end_text")).alias("end_text"),
        timecode_seconds(F.col("start_text")).alias("start_s"),
        timecode_seconds(F.col("end_text")).alias("end_s"),
    )
    rows = settled(chapters, "__t", times).select(*columns, "__t.*")
    bad = F.col("start_s").isNull() | F.col("end_s").isNull()
    return rows.where(~bad), rows.where(bad)


def trim_chapters(chapters: DataFrame, start_chapter: int = 1) -> DataFrame:
    """Drop chapters before the 1-based `start_chapter` and count the rest from zero."""
    if start_chapter < 1:
        raise ValueError("start_chapter counts from 1")
    first = start_chapter - 1
    return chapters.where(F.col("chapter_idx") >= first).withColumn("chapter_idx", F.col("chapter_idx") - first)


def flag_main(chapters: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    duration = F.col("end_s") - F.col("start_s")
    return chapters.withColumns({"duration_s": duration, "is_main": duration >= settings.main_chapter_s})


def chapter_report(chapters: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    title = F.col("title") if "title" in chapters.columns else F.lit(None).cast("string")
    return flag_main(chapters, settings).select(
        "disc_id",
        (F.col("chapter_idx") + 1).alias("number"),
        F.coalesce(F.nullif(title, F.lit("")), F.lit("(untitled)")).alias("title"),
        "start_s", "end_s", "duration_s", "is_main",
    )


def chapter_counts(chapters: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    return flag_main(chapters, settings).groupBy("disc_id").agg(
        F.count_if("is_main").alias("main_chapters"), F.count(F.lit(1)).alias("chapters")
    )


def episode_ranges(chapters: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Chapter ranges (disc_id, nth, start_idx, end_idx, is_tail), as computed.

    A main chapter followed by a non-main one is a turn: it ends an episode
    `extra_chapters` later, at most at the last chapter; the next one starts right after.
    What is left at the end is one more episode if it has a main chapter.  Ends that were
    held back to the last chapter can leave a later range empty; see `split_ranges`.

    A disc's chapters are packed into slices of at most `chapter_slice`.  Turns are found
    slice by slice; across slices only one summary row each is put in order, so a disc
    with any number of chapters spreads over many tasks.
    """
    rows = with_slice(flag_main(chapters, settings), "chapter_idx", settings.chapter_slice)
    pair = F.struct(F.col("chapter_idx").alias("i"), F.col("is_main").alias("m"))
    packed = rows.groupBy("disc_id", SLICE).agg(F.array_sort(F.collect_list(pair)).alias("c"))
    shifted = F.slice("c", F.lit(2), F.greatest(F.size("c") - 1, F.lit(0)))
    turn = lambda here, after: F.when(here["m"] & ~after["m"], here["i"])
    packed = packed.select(
        "disc_id", SLICE,
        F.array_compact(F.zip_with("c", shifted, turn)).alias("turns"),
        F.element_at("c", 1)["m"].alias("first_main"),
        F.element_at("c", -1).alias("tip"),
        F.array_max(F.transform(F.filter("c", lambda x: x["m"]), lambda x: x["i"])).alias("top_main"),
    )

    disc = Window.partitionBy("disc_id")
    along = disc.orderBy(SLICE)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    summary = packed.select(
        "disc_id", SLICE, "tip", "top_main",
        F.size("turns").alias("inner"),
        F.try_element_at("turns", F.lit(-1)).alias("inner_turn"),
        F.lead("first_main").over(along).alias("next_main"),
    )
    summary = summary.withColumn("turns_at_tip", F.coalesce(F.col("tip.m") & ~F.col("next_main"), F.lit(False)))
    summary = summary.withColumns(
        {
            "count": F.col("inner") + F.col("turns_at_tip").cast("int"),
            "last_turn": F.when(F.col("turns_at_tip"), F.col("tip.i")).otherwise(F.col("inner_turn")),
        }
    )
    edges = summary.select(
        "disc_id", SLICE, "turns_at_tip",
        F.coalesce(F.sum("count").over(before), F.lit(0)).alias("turns_before"),
        F.last("last_turn", ignorenulls=True).over(before).alias("turn_before"),
        F.sum("count").over(disc).alias("turns_total"),
        F.max("last_turn").over(disc).alias("final_turn"),
        F.max("tip.i").over(disc).alias("last"),
        F.max("top_main").over(disc).alias("last_main"),
        F.col("next_main").isNull().alias("is_last_slice"),
    )
    joined = packed.select("disc_id", SLICE, "turns", "tip").join(edges, ["disc_id", SLICE])
    none = F.array().cast("array<bigint>")
    joined = joined.withColumn(
        "turns", F.concat("turns", F.when(F.col("turns_at_tip"), F.array("tip.i")).otherwise(none))
    )
    end_of = lambda t: F.when(
        t.isNotNull(), F.least(t + settings.extra_chapters, F.col("last"))
    )
    item = lambda nth, start, end, tail: F.struct(
        nth.cast("bigint").alias("nth"), start.cast("bigint").alias("start_idx"),
        end.cast("bigint").alias("end_idx"), F.lit(tail).alias("is_tail"),
    )

    def found(turn: Column, at: Column) -> Column:
        earlier = F.coalesce(F.when(at > 0, F.try_element_at("turns", at)), F.col("turn_before"))
        return item(F.col("turns_before") + at + 1, F.coalesce(end_of(earlier) + 1, F.lit(0)), end_of(turn), False)

    claimed = F.coalesce(end_of(F.col("final_turn")), F.lit(-1))
    tail = item(F.col("turns_total") + 1, claimed + 1, F.col("last"), True)
    has_tail = F.col("is_last_slice") & (F.col("last_main") > claimed)
    tails = F.array_compact(F.array(F.when(has_tail, tail)))
    return joined.select("disc_id", F.inline(F.concat(F.transform("turns", found), tails)))


def split_ranges(ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable ranges, empty ranges to report)."""
    usable = F.col("start_idx") <= F.col("end_idx")
    return ranges.where(usable), ranges.where(~usable)


def episodes(chapters: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    return split_ranges(episode_ranges(chapters, settings))[0]


def episode_chapters(
    chapters: DataFrame, settings: Settings = DEFAULTS, start_episode: int = 1, ranges: DataFrame | None = None
) -> DataFrame:
    """Every claimed chapter with its episode and its new number inside it.

    A range join on (disc, run of 64 chapters): an episode is repeated for every run it
    touches, so neither a long disc nor a long episode lands in one task.
    """
    found = episodes(chapters, settings) if ranges is None else ranges
    run, block = 64, 65536
    blocks = F.sequence(F.floor(F.col("start_idx") / block), F.floor(F.col("end_idx") / block))
    pieces = found.select("disc_id", "nth", "start_idx", "end_idx", F.explode(blocks).alias("__b"))
    first = F.greatest(F.col("start_idx"), F.col("__b") * block)
    last = F.least(F.col("end_idx"), (F.col("__b") + 1) * block - 1)
    pieces = pieces.select(
        "disc_id", "nth", "start_idx", "end_idx",
        F.explode(F.sequence(F.floor(first / run), F.floor(last / run))).alias("__run"),
    )
    rows = chapters.withColumn("__run", F.floor(F.col("chapter_idx") / run)).join(pieces, ["disc_id", "__run"])
    number = F.col("chapter_idx") - F.col("start_idx") + 1
    return rows.where(F.col("chapter_idx").between(F.col("start_idx"), F.col("end_idx"))).select(
        *chapters.columns,
        (F.col("nth") + start_episode - 1).alias("episode"),
        number.alias("number"),
        F.concat(F.lit("Chapter "), number.cast("string")).alias("label"),
        F.lit("en").alias("label_language"),
    )


def episode_manifest(
    chapters: DataFrame,
    series: str | Column,
    season: int = 1,
    start_episode: int = 1,
    settings: Settings = DEFAULTS,
    start: str = "start_s",
    end: str = "end_s",
) -> DataFrame:
    """What to cut: one row per episode with its bounds and output name."""
    series = F.lit(series) if isinstance(series, str) else series
    found = episodes(chapters, settings)
    # Both bounds of every episode are looked up in one join.
    bounds = F.array(
        F.struct(F.col("start_idx").alias("chapter_idx"), F.lit(True).alias("opens")),
        F.struct(F.col("end_idx").alias("chapter_idx"), F.lit(False).alias("opens")),
    )
    asked = found.select("disc_id", "nth", "start_idx", "end_idx", F.inline(bounds))
    times = chapters.select(*CHAPTER, F.col(start).alias("cut_start"), F.col(end).alias("cut_end"))
    cut = asked.join(times, CHAPTER).groupBy("disc_id", "nth", "start_idx", "end_idx").agg(
        F.max(F.when(F.col("opens"), F.col("cut_start"))).alias("cut_start"),
        F.max(F.when(~F.col("opens"), F.col("cut_end"))).alias("cut_end"),
    )
    episode = F.col("nth") + start_episode - 1
    return cut.select(
        "disc_id",
        episode.alias("episode"),
        "start_idx", "end_idx", "cut_start", "cut_end",
        episode_name(series, F.lit(season), episode).alias("file_name"),
    )


# What surrounds the atoms of a chapter document.
_HEAD = (
    '<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE Chapters SYSTEM "matroskachapters.dtd">\n'
    "<Chapters>\n<EditionEntry>"
)
_FOOT = "</EditionEntry>\n</Chapters>"


def chapter_document_lines(claimed: DataFrame) -> DataFrame:
    """Text lines (disc_id, episode, line, text) of the renumbered chapter documents.

    Takes `episode_chapters` rows with uid, start_text and end_text.  A document is
    the rows of one (disc_id, episode) in `line` order; none is ever put together in memory.
    """
    atom = F.struct(
        F.col("uid").alias("ChapterUID"),
        F.col("start_text").alias("ChapterTimeStart"),
        F.col("end_text").alias("ChapterTimeEnd"),
        F.struct(
            F.col("label").alias("ChapterString"), F.col("label_language").alias("ChapterLanguage")
        ).alias("ChapterDisplay"),
    )
    atoms = claimed.select(
        "disc_id", "episode", F.col("number").alias("line"), F.to_xml(atom, {"rowTag": "ChapterAtom"}).alias("text")
    )
    frame = claimed.groupBy("disc_id", "episode").agg(F.max("number").alias("n")).select(
        "disc_id", "episode",
        F.inline(
            F.array(
                F.struct(F.lit(0).cast("bigint").alias("line"), F.lit(_HEAD).alias("text")),
                F.struct((F.col("n") + 1).cast("bigint").alias("line"), F.lit(_FOOT).alias("text")),
            )
        ),
    )
    return atoms.unionByName(frame)
