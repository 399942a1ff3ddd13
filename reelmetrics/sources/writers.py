"""Sinks: summaries, runs, events, manifests and chapter documents."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmetrics.operators.chapters import chapter_document_lines
from reelmetrics.sources.folders import open_store


def write_summaries(summaries: DataFrame, path: str, mode: str = "append") -> None:
    """Nested per-video rows as JSON, nulls left out, one folder per run."""
    summaries.write.mode(mode).option("ignoreNullFields", True).partitionBy("run_id").json(path)


def write_run(run: DataFrame, path: str, mode: str = "append") -> None:
    """The run's own row; videos are found through run_id, not nested inside."""
    run.write.mode(mode).option("ignoreNullFields", True).json(path)


def write_events(events: DataFrame, path: str, by_video: bool = False, mode: str = "append") -> None:
    """Events as JSON by run, or one folder per video below the run.

    The rows of a folder are brought together first, so that not every task writes a file into it; a large
    folder is shared by several.
    """
    folders = ["run_id", "file"] if by_video else ["run_id"]
    events.hint("rebalance", *[F.col(c) for c in folders]).write.mode(mode).option("ignoreNullFields", True).partitionBy(*folders).json(path)


def write_manifest(manifest: DataFrame, path: str, file_format: str = "parquet", mode: str = "overwrite") -> None:
    manifest.write.mode(mode).format(file_format).save(path)


_WRITTEN_DDL = "path string, lines long, bytes long, sha256 string"


def _write_batches(folder: str):
    """Writes sorted lines (path, line, text), a file for each path, under temporary names that are changed at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        made, at, out, done = set(), None, None, []
        lines, size, digest = 0, 0, hashlib.sha256()

        def close() -> None:
            if at is not None:
                out.close()
                store.move(f"{root}/{at}{unfinished}", f"{root}/{at}")
                done.append((at, lines, size, digest.hexdigest()))

        unfinished = f".{uuid.uuid4().hex}.part"
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if path != at:
                    close()
                    above = f"{root}/{path}".rpartition("/")[0]
                    if above not in made:
                        store.create_dir(above, recursive=True)
                        made.add(above)
                    at, out = path, store.open_output_stream(f"{root}/{path}{unfinished}", compression=None)
                    lines, size, digest = 0, 0, hashlib.sha256()
                data = (text or "").encode() + b"\n"
                out.write(data)
                digest.update(data)
                lines, size = lines + 1, size + len(data)
            if len(done) >= 1_000:
                yield _written(done)
                done = []
        close()
        yield _written(done)

    return run


def _written(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["path", "lines", "bytes", "sha256"])


def write_documents(lines: DataFrame, folder: str) -> DataFrame:
    """Writes text files below `folder`, one for each `path` (relative), its rows in the order of `line` with a line feed after each.

    A task writes many files, line by line, so that neither a file's lines nor a list of files is held. A file gets its name when it is
    whole; a task that is tried again writes it anew with the same content. The manifest (path, lines, bytes, sha256) is
    written last, to `_manifest` beside them, and returned. Null texts are empty lines. Rows need a path.
    """
    rows = lines.where("path is not null").repartition("path").sortWithinPartitions("path", "line").select("path", F.col("text").cast("string"))
    rows.mapInArrow(_write_batches(folder), _WRITTEN_DDL).write.mode("overwrite").parquet(f"{folder}/_manifest")
    return lines.sparkSession.read.schema(_WRITTEN_DDL).parquet(f"{folder}/_manifest")


def write_episode_documents(claimed: DataFrame, folder: str) -> DataFrame:
    """One chapter document per episode, `{disc_id}/{episode}.xml` below `folder`, many to a task; returns the manifest."""
    lines = chapter_document_lines(claimed)
    path = F.concat(F.col("disc_id").cast("string"), F.lit("/"), F.col("episode").cast("string"), F.lit(".xml"))
    return write_documents(lines.select(path.alias("path"), "line", "text"), folder)


def write_chapter_documents(claimed: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The same in Spark's own layout: a folder per episode. For few episodes; see `write_episode_documents`."""
    lines = chapter_document_lines(claimed)
    (
        lines.repartition("disc_id", "episode")
        .sortWithinPartitions("disc_id", "episode", "line")
        .select("disc_id", "episode", F.col("text").alias("value"))
        .write.mode(mode)
        .partitionBy("disc_id", "episode")
        .text(path)
    )


def write_bucketed(rows: DataFrame, name: str, folder: str, buckets: int, key: str = "video_id") -> None:
    """A table `name` at `folder`, cut into `buckets` by the key (as a long), and sorted by it in each.

    Rows are dealt out by the key before they are written, so that a bucket is one file. Tables with equal keys and equally many
    buckets join without a shuffle, and anything grouped by the key, alone or with others, needs none.
    """
    keyed = rows.withColumn(key, F.col(key).cast("long"))
    keyed.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", folder).saveAsTable(name)
