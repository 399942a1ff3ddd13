"""Readers: paths to DataFrames, batch and streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmetrics import schemas
from reelmetrics.functions.text import file_stem, safe_id
from reelmetrics.settings import DEFAULTS, Settings
from reelmetrics.sources import documents
from reelmetrics.sources.folders import list_files, open_store

# Streams take this many files per trigger, which bounds what one batch brings in.
FILES_PER_TRIGGER = 64
# A task that reads written documents takes about this many files or bytes, and hands texts on in batches of so many bytes.
TASK_FILES, TASK_BYTES, BATCH_BYTES = 5_000, 64 << 20, 4 << 20


def _video_key(column: str = "path"):
    # Paths come as URIs, where '%20' stands for a blank.
    return safe_id(file_stem(F.url_decode(F.regexp_replace(column, r"\+", "%2B"))))


def read_catalog(spark: SparkSession, folder: str, settings: Settings = DEFAULTS) -> DataFrame:
    """Files below `folder` with their key; file contents are never read.

    Names that begin with '_' and folders that begin with '.' belong to it; files that begin with '.' do not.
    """
    return documents.candidates(list_files(spark, folder), settings).withColumn("video_id", _video_key())


def duplicate_keys(catalog: DataFrame) -> DataFrame:
    """Keys that more than one file maps to (same stem in two folders)."""
    return catalog.groupBy("video_id").agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("first_path")).where(
        F.col("files") > 1
    )


def _whole_files(spark: SparkSession, path: str, key: str) -> DataFrame:
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return rows.select(_video_key("_metadata.file_path").alias(key), F.col("value").alias("doc"))


def _read_batches(folder: str):
    """The whole text of each file, by its path below `folder`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        paths, texts, size = [], [], 0

        def held() -> pa.RecordBatch:
            return pa.record_batch([pa.array(paths, pa.string()), pa.array(texts, pa.string())], ["path", "doc"])

        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{path}", compression=None) as file:
                    data = file.read()
                paths.append(path)
                texts.append(data.decode(errors="replace"))
                size += len(data)
                if size >= BATCH_BYTES:
                    yield held()
                    paths, texts, size = [], [], 0
        yield held()

    return run


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """The documents that `write_documents` put below `folder`, whole, as path and doc.

    Files come from the manifest, so that the driver lists none, and a task opens many. One that is not there raises an error.
    """
    found = manifest.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    tasks = 2 + max(found["files"] // TASK_FILES, found["bytes"] // TASK_BYTES)
    return manifest.select("path").repartition(tasks, "path").mapInArrow(_read_batches(folder), "path string, doc string")


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    return documents.parse_probe(_whole_files(spark, path, "video_id"))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Score documents named `{video}/cq{level}_s{sample}.json`."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    file = F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B"))
    named = rows.select(
        safe_id(F.regexp_extract(file, r"([^/]+)/[^/]+$", 1)).alias("video_id"),
        F.regexp_extract(file, r"cq([0-9]+)_s[0-9]+\.[^/]*$", 1).try_cast("int").alias("cq"),
        F.regexp_extract(file, r"cq[0-9]+_s([0-9]+)\.[^/]*$", 1).try_cast("int").alias("sample_idx"),
        F.col("value").alias("doc"),
    )
    return documents.parse_scores(named.where(F.col("cq").isNotNull()))


def read_hdr(spark: SparkSession, path: str) -> DataFrame:
    return documents.parse_hdr(_whole_files(spark, path, "video_id"))


def read_chapters(spark: SparkSession, path: str) -> DataFrame:
    return documents.parse_chapters(_whole_files(spark, path, "disc_id"))


def read_totals(spark: SparkSession, path: str) -> DataFrame:
    return documents.parse_totals(_whole_files(spark, path, "video_id").withColumnRenamed("doc", "log"))


def read_frame_log(spark: SparkSession, path: str) -> DataFrame:
    """Frame logs, split at `frame:` so that one huge log is read by many tasks."""
    rows = spark.read.option("lineSep", "frame:").option("recursiveFileLookup", True).text(path)
    return documents.parse_frame_records(rows.select(_video_key("_metadata.file_path").alias("video_id"), "value"))


def stream_frame_log(spark: SparkSession, path: str, files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    rows = (
        spark.readStream.option("lineSep", "frame:")
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_trigger)
        .text(path)
    )
    return documents.parse_frame_records(rows.select(_video_key("_metadata.file_path").alias("video_id"), "value"))


def read_summaries(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Prior summaries; a document that does not parse keeps its text in `_corrupt_record`."""
    return (
        spark.read.schema(schemas.SUMMARY)
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        .option("recursiveFileLookup", True)
        .json(path)
    )


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return documents.parse_events(spark.read.text(path))


def stream_events(spark: SparkSession, path: str, files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    return documents.parse_events(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path))


def stream_table(
    spark: SparkSession, path: str, schema: str, file_format: str = "json", files_per_trigger: int = FILES_PER_TRIGGER
) -> DataFrame:
    """A folder of JSON or Parquet files as a stream with a given schema."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(file_format).load(path)
    )
