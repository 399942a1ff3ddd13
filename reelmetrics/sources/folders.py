"""Folders for intermediate data, which driver and executors must share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`, or the warehouse where that is unset; never a folder of one machine's own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"


def scratch_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4()}"


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that this session has made, in whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def open_store(folder: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a folder, and the folder's path in it."""
    if folder.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + unquote(folder.removeprefix("file:")).lstrip("/")
    return pa.fs.FileSystem.from_uri(folder) if "://" in folder else (pa.fs.LocalFileSystem(), folder)


#: Tasks that list folders at once, and files that a task hands on together.
WALK_TASKS, WALK_ROWS = 1_000, 10_000
_FOUND = pa.schema([("path", pa.string()), ("is_folder", pa.bool_()), ("length", pa.int64()), ("modified", pa.timestamp("us", "UTC"))])
_FOUND_DDL = "path string, is_folder boolean, length long, modified timestamp"


def _children(folder: str):
    """What each folder of a level holds: its files and the folders of the next level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                found = store.get_file_info(pa.fs.FileSelector(path, recursive=False))
                for at in range(0, len(found), WALK_ROWS):
                    part = [(e.path, e.type == pa.fs.FileType.Directory, e.size, e.mtime) for e in found[at : at + WALK_ROWS]]
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), _FOUND, strict=True)], schema=_FOUND)

    return run


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """All files below `folder`, whatever they and their folders are called: path (as a URI), length, modified.

    Spark's own listing leaves out names that begin with `_` or `.`.  The tree is walked level by level: the folders of a
    level are dealt out, each is listed by a task, and what was found is written to a scratch folder, from which the next level
    is taken. The driver sees how many folders a level has, and nothing else. A folder that is not there raises an error.
    """
    root = open_store(folder)[1]
    base = folder if urlsplit(folder).scheme else f"file:{root}"
    base = base[: len(base) - len(root)] if base.endswith(root) else "file:"
    scratch, level = scratch_folder(spark, "walk"), 0
    frontier = spark.createDataFrame([(root,)], "path string")
    while True:
        at = f"{scratch}/level={level}"
        frontier.mapInArrow(_children(folder), _FOUND_DDL).write.parquet(at)
        folders = spark.read.schema(_FOUND_DDL).parquet(at).where("is_folder").select("path")
        number = folders.count()
        if not number:
            break
        frontier, level = folders.repartition(min(number, WALK_TASKS)), level + 1
    files = spark.read.schema(_FOUND_DDL).parquet(*[f"{scratch}/level={k}" for k in range(level + 1)]).where("not is_folder")
    return files.select(F.concat(F.lit(base), _quoted("path")).alias("path"), "length", "modified")


def _quoted(path: str) -> Column:
    """A path as it stands in a URI: all but letters, digits, `/` and `_.-~` as percent codes of its bytes."""
    coded = F.regexp_replace(F.regexp_replace(F.url_encode(path), r"\+", "%20"), "%2F", "/")
    return F.regexp_replace(F.regexp_replace(coded, r"\*", "%2A"), "%7E", "~")
