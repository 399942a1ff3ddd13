"""Parsers: a column of raw text to typed columns.  They work on batch and streaming rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmetrics import schemas
from reelmetrics.functions import probe, rates
from reelmetrics.functions.once import settled
from reelmetrics.settings import DEFAULTS, Settings

_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def number(text: Column) -> Column:
    """Plain decimal text to double, null for anything else."""
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def parse_probe(docs: DataFrame, text: str = "doc") -> DataFrame:
    """Probe documents: duration_s, bit_rate, size, streams, the first real video, usability."""
    keep = [c for c in docs.columns if c != text]
    rows = settled(docs, "__d", F.from_json(F.col(text), schemas.PROBE_DOCUMENT)).select(
        *keep,
        number(F.col("__d.format.duration")).alias("duration_s"),
        F.coalesce(F.col("__d.format.bit_rate").try_cast("bigint"), F.lit(0)).alias("bit_rate"),
        F.coalesce(F.col("__d.format.size").try_cast("bigint"), F.lit(0)).alias("size"),
        F.col("__d.streams").alias("streams"),
    )
    return rows.withColumns(
        {
            "video": probe.first_video(F.col("streams")),
            "usable": probe.is_usable(F.col("duration_s"), F.col("streams")),
        }
    )


def usable_videos(probed: DataFrame) -> DataFrame:
    """Files worth processing, with the columns of their first real video stream."""
    keep = [c for c in probed.columns if c not in ("streams", "video", "usable")]
    return probed.where(F.col("usable")).select(*keep, "video.*").drop("disposition")


def output_stats(probed: DataFrame) -> DataFrame:
    """Codec, resolution, rate, duration, bit rate and size of an output; unknown numbers are 0."""
    keep = [c for c in probed.columns if c not in ("streams", "video", "usable", "duration_s", "bit_rate", "size")]
    rows = probed.select(*keep, "duration_s", "bit_rate", "size", "video.*")
    rows = rates.add_rates(rows)
    return rows.select(
        *keep,
        F.coalesce("codec_name", F.lit("?")).alias("codec"),
        F.coalesce("width", F.lit(0)).alias("width"),
        F.coalesce("height", F.lit(0)).alias("height"),
        F.coalesce("rate_text", F.lit("?")).alias("rate_text"),
        F.coalesce("duration_s", F.lit(0.0)).alias("duration_s"),
        "bit_rate", "size",
    )


def parse_frame_records(records: DataFrame, text: str = "value") -> DataFrame:
    """Records of the detector's frame log to frame_idx and flag.

    A record is the text after one `frame:`; one without a detector line is no frame.
    Words that are not known count as undetermined.
    """
    keep = [c for c in records.columns if c != text]
    word = F.lower(F.regexp_extract(text, r"lavfi\.idet\.multiple\.current_frame=(\w+)", 1))
    number_text = F.regexp_extract(text, r"^\s*([0-9]+)", 1)
    read = F.struct(number_text.try_cast("bigint").alias("frame_idx"), word.alias("__w"))
    rows = settled(records, "__r", read).select(*keep, "__r.*")
    known = F.col("__w").isin("progressive", "tff", "bff")
    return rows.where(F.col("frame_idx").isNotNull() & (F.col("__w") != "")).select(
        *keep, "frame_idx", F.when(known, F.col("__w")).otherwise("undetermined").alias("flag")
    )


_TOTALS = (
    r"Multi frame detection:\s*TFF:\s*([0-9]+)\s*BFF:\s*([0-9]+)\s*Progressive:\s*([0-9]+)\s*Undetermined:\s*([0-9]+)"
)


def parse_totals(logs: DataFrame, text: str = "log") -> DataFrame:
    """The detector's own totals: the last such line of a log counts, without one all are null."""
    keep = [c for c in logs.columns if c != text]
    last = F.try_element_at(F.regexp_extract_all(F.col(text), F.lit(_TOTALS), F.lit(0)), F.lit(-1))
    rows = logs.select(*keep, last.alias("__t"))
    group = lambda i: F.regexp_extract("__t", _TOTALS, i).try_cast("bigint")
    return rows.select(
        *keep,
        group(3).alias("progressive"), group(1).alias("tff"), group(2).alias("bff"), group(4).alias("undetermined"),
    )


def _scored(docs: DataFrame, text: str) -> DataFrame:
    keep = [c for c in docs.columns if c != text]
    return settled(docs, "__d", F.from_json(F.col(text), schemas.SCORE_DOCUMENT)).select(*keep, "__d")


def parse_scores(docs: DataFrame, text: str = "doc") -> DataFrame:
    """One row per scored frame; frames without a score are left out."""
    rows = _scored(docs, text)
    keep = [c for c in rows.columns if c != "__d"]
    return rows.select(*keep, F.posexplode("__d.frames").alias("frame_idx", "__f")).where(
        F.col("__f.metrics.vmaf").isNotNull()
    ).select(*keep, "frame_idx", F.col("__f.metrics.vmaf").alias("score"))


def parse_pooled(docs: DataFrame, text: str = "doc") -> DataFrame:
    """Pooled mean, harmonic mean and minimum per document; 0 or missing falls back to the frames."""
    rows = _scored(docs, text)
    keep = [c for c in rows.columns if c != "__d"]
    scores = F.filter(F.transform("__d.frames", lambda f: f["metrics"]["vmaf"]), lambda s: s.isNotNull())
    rows = rows.withColumn("__s", F.coalesce(scores, F.array().cast("array<double>")))
    total = F.aggregate("__s", F.lit(0.0), lambda acc, s: acc + s)
    mean = F.try_divide(total, F.size("__s"))
    pooled = "__d.pooled_metrics.vmaf"
    zero = F.lit(0.0)
    return rows.select(
        *keep,
        F.coalesce(F.nullif(F.col(f"{pooled}.mean"), zero), mean, zero).alias("mean"),
        F.coalesce(F.col(f"{pooled}.harmonic_mean"), zero).alias("harmonic_mean"),
        F.coalesce(F.nullif(F.col(f"{pooled}.min"), zero), F.array_min("__s"), zero).alias("min"),
        F.size("__s").cast("bigint").alias("n"),
    )


def parse_hdr(docs: DataFrame, text: str = "doc") -> DataFrame:
    """Light levels and mastering peak; documents without any of them give no row.

    The last usable entry of a kind counts.  Nominal peak and its origin come along.
    """
    keep = [c for c in docs.columns if c != text]
    empty = "array<struct<side_data_type:string,max_content:string,max_average:string,max_luminance:string>>"
    lists = F.transform(
        F.from_json(F.col(text), schemas.SIDE_DATA_DOCUMENT)["frames"],
        lambda f: F.coalesce(f["side_data_list"], F.array().cast(empty)),
    )
    rows = settled(docs, "__e", F.flatten(lists)).select(*keep, "__e")

    def luminance(t: Column) -> Column:
        parts = F.split(t, "/")
        ratio = F.try_divide(number(F.try_element_at(parts, F.lit(1))), number(F.try_element_at(parts, F.lit(2))))
        return F.when(F.size(parts) == 2, ratio).otherwise(number(t))

    def last(kind: str, field: str, convert) -> Column:
        values = F.transform(
            F.filter("__e", lambda e: e["side_data_type"] == kind), lambda e: convert(e[field])
        )
        return F.try_element_at(F.filter(values, lambda v: v.isNotNull()), F.lit(-1))

    whole = lambda t: F.trim(t).try_cast("int")
    light, display = "Content light level metadata", "Mastering display metadata"
    values = F.struct(
        last(light, "max_content", whole).alias("max_cll"),
        last(light, "max_average", whole).alias("max_fall"),
        F.rint(last(display, "max_luminance", luminance)).try_cast("int").alias("mastering_max_luminance"),
    )
    rows = settled(rows, "__v", values).select(*keep, "__v.*")
    found = F.coalesce("max_cll", "max_fall", "mastering_max_luminance").isNotNull()
    return rows.where(found).withColumns(
        {
            "nominal_peak": probe.nominal_peak(F.col("max_cll"), F.col("mastering_max_luminance")),
            "peak_origin": probe.peak_origin(F.col("max_cll"), F.col("mastering_max_luminance")),
        }
    )


def _chapter_atoms(docs: DataFrame, text: str) -> DataFrame:
    """Documents with the chapters of their first edition as `__a`, and why there are none as `reason`."""
    keep = [c for c in docs.columns if c != text]
    read = F.from_xml(F.col(text), schemas.CHAPTER_DOCUMENT, {"columnNameOfCorruptRecord": "_corrupt_record"})
    rows = settled(docs, "__d", read)
    atoms = F.get(F.col("__d.EditionEntry"), F.lit(0))["ChapterAtom"]
    unreadable = F.col("__d").isNull() | F.col("__d._corrupt_record").isNotNull()
    reason = F.when(unreadable, "document is not readable").when(F.coalesce(F.size(atoms), F.lit(0)) < 1, "document has no chapters")
    return rows.select(*keep, F.col(text), atoms.alias("__a"), reason.alias("reason"))


def chapter_rejects(docs: DataFrame, text: str = "doc") -> DataFrame:
    """Chapter documents that give no chapter, with the reason; every other one gives rows in `parse_chapters`."""
    return _chapter_atoms(docs, text).where(F.col("reason").isNotNull()).drop("__a")


def parse_chapters(docs: DataFrame, text: str = "doc") -> DataFrame:
    """Chapter documents to one row per chapter, numbered from 0 in document order.

    Chapter numbers are unsigned 64-bit; one that is no number is null.  Of several editions the first counts.
    """
    keep = [c for c in docs.columns if c != text]
    rows = _chapter_atoms(docs, text).where(F.col("reason").isNull())
    return rows.select(*keep, F.posexplode("__a").alias("__i", "__a")).select(
        *keep,
        F.col("__i").cast("bigint").alias("chapter_idx"),
        F.col("__a.ChapterUID").try_cast("decimal(20,0)").alias("uid"),
        F.coalesce("__a.ChapterTimeStart", F.lit("")).alias("start_text"),
        F.coalesce("__a.ChapterTimeEnd", F.lit("")).alias("end_text"),
        F.coalesce("__a.ChapterDisplay.ChapterString", F.lit("")).alias("title"),
        F.coalesce("__a.ChapterDisplay.ChapterLanguage", F.lit("")).alias("language"),
    )


# Beginnings of the message templates that analytics use.
EVENT_KINDS = {
    "acquire": "Pool acquired",
    "release": "Pool released",
    "tick": "System util sample",
    "checkpoint": "Pool-vs-hardware checkpoint",
    "run_start": "Run start",
    "run_config": "Run config",
    "run_end": "Run end",
    "detection": "Detection complete",
    "stage": "Stage:",
}


def parse_events(lines: DataFrame, text: str = "value") -> DataFrame:
    """Compact JSON log lines: t, level, mt, kind, file, op and all properties as a VARIANT."""
    keep = [c for c in lines.columns if c != text]
    props = F.col("props")
    get = lambda name, kind: F.try_variant_get(props, f"$['{name}']", kind)
    rows = settled(lines, "props", F.try_parse_json(F.col(text))).select(*keep, "props").where(props.isNotNull())
    rows = rows.select(
        *keep,
        F.try_to_timestamp(get("@t", "string")).alias("t"),
        F.coalesce(get("@l", "string"), F.lit("Information")).alias("level"),
        get("@mt", "string").alias("mt"),
        get("File", "string").alias("file"),
        get("Op", "string").alias("op"),
        "props",
    )
    kind = None
    for name, prefix in EVENT_KINDS.items():
        test = F.col("mt").startswith(prefix)
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    return rows.withColumn("kind", kind.otherwise("message"))


def _field(path: str, kind: str) -> Column:
    return F.try_variant_get(F.col("props"), path, kind)


def pool_events(events: DataFrame) -> DataFrame:
    """Acquire and release events as columns (the log is thinned: use op records for sums)."""
    keep = [c for c in events.columns if c not in ("props", "level", "mt")]
    shape = lambda r: F.coalesce(
        _field(f"$.Granted.{r}", "int"), _field(f"$.Released.{r}", "int")
    )
    return events.where(F.col("kind").isin("acquire", "release")).select(
        *keep,
        *[shape(r).alias(r.lower()) for r in ("Cpu", "Nvenc", "Nvdec", "Cuda")],
        _field("$.AltIndex", "int").alias("alt_index"),
        _field("$.WaitMs", "bigint").alias("wait_ms"),
        _field("$.HoldMs", "bigint").alias("hold_ms"),
        _field("$.WaitersGrantedInScan", "int").alias("woken"),
    )


def tick_events(events: DataFrame) -> DataFrame:
    """System samples of the log as tick columns."""
    keep = [c for c in events.columns if c not in ("props", "level", "mt", "kind", "file", "op", "t")]
    return events.where(F.col("kind") == "tick").select(
        *keep,
        "t",
        *[_field(f"$.Pool.{r}", "bigint").alias(f"{r.lower()}_free") for r in ("Cpu", "Nvenc", "Nvdec", "Cuda")],
        _field("$.CpuPct", "double").alias("cpu_pct"),
        _field("$.Load1m", "double").alias("load1m"),
        _field("$.Gpu.GpuUtilPct", "int").alias("gpu_pct"),
        _field("$.Gpu.MemoryUtilPct", "int").alias("mem_pct"),
        _field("$.Gpu.VramMbUsed", "int").alias("vram_mb"),
        _field("$.Gpu.NvencSessionCount", "int").alias("nvenc_sessions"),
    )


def parse_cpu_line(lines: DataFrame, text: str = "cpu_line") -> DataFrame:
    """First line of the kernel's CPU statistics to cumulative totals; iowait counts as idle."""
    keep = [c for c in lines.columns if c != text]
    parts = F.split(F.trim(text), r"\s+")
    value = lambda i: F.try_element_at(parts, F.lit(i + 1)).try_cast("bigint")
    optional = lambda i: F.coalesce(value(i), F.lit(0))
    idle = value(4) + optional(5)
    busy = value(1) + value(2) + value(3) + optional(6) + optional(7) + optional(8)
    return lines.select(*keep, (idle + busy).alias("cpu_total"), idle.alias("cpu_idle"))


def load_average(text: Column) -> Column:
    """One-minute load from the kernel's load line; 0 if it cannot be read."""
    return F.coalesce(number(F.try_element_at(F.split(F.trim(text), " "), F.lit(1))), F.lit(0.0))


def parse_gpu_csv(lines: DataFrame, text: str = "gpu_line") -> DataFrame:
    """First non-blank CSV line of the GPU tool; `[N/A]` and missing fields are null."""
    keep = [c for c in lines.columns if c != text]
    first = F.try_element_at(F.filter(F.split(text, "\n"), lambda s: F.trim(s) != ""), F.lit(1))
    rows = lines.select(*keep, F.split(first, ",").alias("__p"))

    def whole(i: int) -> Column:
        t = F.trim(F.regexp_replace(F.try_element_at("__p", F.lit(i)), r"\s", " "))
        return F.when(~F.contains(F.upper(t), F.lit("N/A")), t.try_cast("int"))

    names = ("gpu_pct", "mem_pct", "vram_mb", "nvenc_sessions")
    return rows.select(*keep, *[whole(i + 1).alias(name) for i, name in enumerate(names)])


def candidates(files: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Files that are not hidden and not tiny; hidden folders are not excluded."""
    name = F.regexp_extract("path", r"([^/\\]*)$", 1)
    return files.where((F.col("length") >= settings.min_file_bytes) & ~name.startswith("."))


def catalog_order(files: DataFrame) -> DataFrame:
    """Deterministic output order, case-insensitive."""
    return files.orderBy(F.lower("path"), "path")
