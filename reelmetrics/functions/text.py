"""Text, time code and naming helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelmetrics.functions.once import let


def file_stem(path: Column) -> Column:
    """File name without directories and without its last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")


def safe_id(stem: Column) -> Column:
    """Every character that is not a letter, digit, '-', '_' or '.' becomes '_'."""
    return F.regexp_replace(stem, r"[^\p{L}\p{Nd}._-]", "_")


def normalize_timecode(text: Column) -> Column:
    """Drop trailing zeros of the fraction; text without a fraction stays as it is."""
    trimmed = F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))
    return F.when(text.contains("."), trimmed).otherwise(F.coalesce(text, F.lit("")))


_TIMECODE = r"^\s*([0-9]+\.)?([01]?[0-9]|2[0-3]):[0-5]?[0-9](:[0-5]?[0-9](\.[0-9]{1,9})?)?\s*$"


def timecode_seconds(text: Column) -> Column:
    """`[d.]HH:MM[:SS[.fraction]]` to decimal seconds; null when it is not a time code."""

    def seconds(parts: Column) -> Column:
        head = F.split(F.get(parts, F.lit(0)), r"\.")
        days = F.when(F.size(head) == 2, F.get(head, F.lit(0)).try_cast("bigint")).otherwise(F.lit(0))
        minutes = days * 1440 + F.element_at(head, -1).try_cast("int") * 60 + F.get(parts, F.lit(1)).try_cast("int")
        tail = F.coalesce(F.get(parts, F.lit(2)).try_cast("decimal(18,9)"), F.lit(0).cast("decimal(18,9)"))
        return (minutes * 60 + tail).cast("decimal(18,9)")

    return F.when(text.rlike(_TIMECODE), let(F.split(F.trim(text), ":"), seconds))


def episode_name(series: Column, season: Column, episode: Column) -> Column:
    return F.format_string("%s - S%02dE%02d.mkv", series, season.cast("int"), episode.cast("int"))
