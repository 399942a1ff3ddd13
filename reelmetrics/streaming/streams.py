"""Structured Streaming forms of the counters, samples and progress records."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from reelmetrics.operators import cadence, stages, ticks, usage
from reelmetrics.settings import DEFAULTS, Settings
from reelmetrics.sources.folders import remove, scratch_folder

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark) -> Iterator[None]:
    """Streams started inside use the state store that the stateful processors below need; the session keeps its own."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STATE_STORE)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def live_frame_counts(frames: DataFrame) -> DataFrame:
    """Frame counts per video while logs arrive (update or complete mode)."""
    return cadence.frame_counts(frames)


def live_tick_summary(samples: DataFrame, keys=("host",), settings: Settings = DEFAULTS) -> DataFrame:
    """Summary since the start; state per key is a handful of numbers.

    With a five-minute trigger every update is a cumulative checkpoint.
    """
    return ticks.tick_summary(samples, keys, settings)


def tick_intervals(
    samples: DataFrame, at: str = "t", keys=("host",), width: str = "5 minutes", late: str = "10 minutes",
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Summary per tumbling interval, final once the watermark has passed it."""
    watched = samples.withWatermark(at, late).withColumn("interval", F.window(at, width))
    return ticks.tick_summary(watched, [*keys, "interval"], settings)


def split_late(folder: str, at: str = "t", width: str = "5 minutes", late: str = "10 minutes") -> Callable[[DataFrame, int], None]:
    """foreachBatch function: rows whose interval the watermark has closed already go to `folder/rejects`.

    The watermark of a batch follows from the latest time in the batches before it, which every batch hands on in a folder of its
    own; a batch that is retried replaces what it wrote.
    """
    times = f"{folder}/latest"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema("latest timestamp").parquet(f"{times}/batch={batch_id - 1}").first().latest if batch_id else None
        closed = F.window(at, width)["end"] <= F.lit(before).cast("timestamp") - F.expr(f"interval {late}")
        batch.where(closed).write.mode("overwrite").parquet(f"{folder}/rejects/batch={batch_id}")
        batch.agg(F.greatest(F.max(at), F.lit(before).cast("timestamp")).alias("latest")).write.mode("overwrite").parquet(f"{times}/batch={batch_id}")

    return write


def run_intervals(
    samples: DataFrame, folder: str, at: str = "t", keys=("host",), width: str = "5 minutes", late: str = "10 minutes",
    settings: Settings = DEFAULTS,
) -> None:
    """Takes in all samples that are there now: final intervals go to `folder/closed`, late samples to `folder/rejects`.

    Called again when more has come, it goes on from its checkpoints. Intervals that the watermark has not passed stay in the state.
    A sample is late when its interval ends at or before the watermark, which is `late` before the latest time of the runs and
    batches before; any other sample counts, however old. Both queries must be given all files at once (no limit of files a
    trigger), so that they see the same batches.
    """
    def start(stream, name):
        return stream.option("checkpointLocation", f"{folder}/checkpoint-{name}").trigger(availableNow=True)

    intervals = tick_intervals(samples, at, keys, width, late, settings)
    with rocksdb(samples.sparkSession):
        running = [
            start(intervals.writeStream.outputMode("append").format("parquet"), "closed").start(f"{folder}/closed"),
            start(samples.writeStream.foreachBatch(split_late(folder, at, width, late)), "rejects").start(),
        ]
        for query in running:
            query.awaitTermination()


def live_thin_events(ops: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    return usage.thin_events(ops, settings)


def _ordered(batches: Iterator[pd.DataFrame], by: str) -> pd.DataFrame:
    """One key's rows of one micro-batch; the reader's files per trigger bound them."""
    return pd.concat(list(batches), ignore_index=True).sort_values(by, kind="stable")


class CpuUse(StatefulProcessor):
    """Keeps a host's last counters and turns every new reading into a percentage; late ones get none and are marked."""

    OUTPUT = "host BIGINT, tick_id BIGINT, tick_ms BIGINT, cpu_pct DOUBLE, late BOOLEAN"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "tick_ms BIGINT, total BIGINT, idle BIGINT")

    def handleInputRows(self, key, rows, timerValues):
        batch = _ordered(rows, "tick_ms")
        before = self.last.get() if self.last.exists() else (None, None, None)
        stamp, total, idle = before
        fresh = batch if stamp is None else batch[batch["tick_ms"] > stamp]
        totals = pd.concat([pd.Series([total], dtype="float64"), fresh["cpu_total"].astype("float64")])
        idles = pd.concat([pd.Series([idle], dtype="float64"), fresh["cpu_idle"].astype("float64")])
        passed = totals.diff().iloc[1:]
        idled = idles.diff().iloc[1:].clip(lower=0)
        pct = ((passed - idled) * 100.0 / passed).where(passed > 0, 0.0)
        out = batch[["tick_id", "tick_ms"]].copy()
        out.insert(0, "host", key[0])
        # A reading older than the state cannot be placed any more: what it would have been is not known.
        out["cpu_pct"] = pct.fillna(0.0).reindex(out.index)
        out["late"] = ~out.index.isin(fresh.index)
        if len(fresh):
            newest = fresh.iloc[-1]
            self.last.update((int(newest["tick_ms"]), int(newest["cpu_total"]), int(newest["cpu_idle"])))
        yield out

    def close(self) -> None:
        pass


def live_cpu_pct(samples: DataFrame) -> DataFrame:
    """cpu_pct per tick from cumulative counters, across micro-batches (append mode)."""
    return (
        samples.select("host", "tick_id", "tick_ms", "cpu_total", "cpu_idle")
        .groupBy("host")
        .transformWithStateInPandas(CpuUse(), outputStructType=CpuUse.OUTPUT, outputMode="Append", timeMode="None")
    )


class StageState(StatefulProcessor):
    """Follows one slot: begin opens it, set changes the stage, complete and skip close it.

    Only changes of the stage are passed on; a `set` for a slot that is not open is ignored.  An update
    that comes after a later one of its slot changes nothing and is passed on as `late`.
    """

    OUTPUT = (
        "run_id STRING, slot BIGINT, seq BIGINT, change STRING, file STRING, stage STRING, detail STRING, level STRING"
    )

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "seq BIGINT, file STRING, stage STRING")

    def handleInputRows(self, key, rows, timerValues):
        last, file, stage = self.open.get() if self.open.exists() else (None, None, None)
        is_open = file is not None
        changes = []
        for row in _ordered(rows, "seq").itertuples(index=False):
            if last is not None and row.seq < last:
                changes.append((row.seq, "late", row.file or "", row.stage or "", row.detail or "", row.level))
                continue
            last = row.seq
            if row.kind == "begin":
                is_open, file, stage = True, row.file or "", "Starting"
                changes.append((row.seq, "begin", file, stage, "", None))
            elif row.kind == "set" and is_open and row.stage != stage:
                stage = row.stage
                changes.append((row.seq, "stage", file, stage, row.detail or "", None))
            elif row.kind == "complete" and is_open:
                changes.append((row.seq, "complete", file, stage, row.detail or "", row.level))
                is_open, file, stage = False, None, None
            elif row.kind == "skip":
                changes.append((row.seq, "skip", row.file or "", "", row.detail or "", "skipped"))
        # A closed slot keeps its number, so that a late update does not open it again.
        self.open.update((int(last), file, stage))
        out = pd.DataFrame(changes, columns=["seq", "change", "file", "stage", "detail", "level"])
        out.insert(0, "slot", key[1])
        out.insert(0, "run_id", key[0])
        yield out

    def close(self) -> None:
        pass


def live_stages(updates: DataFrame) -> DataFrame:
    """Stage changes and completions from raw updates (append mode); see schemas.STAGES."""
    return updates.groupBy("run_id", "slot").transformWithStateInPandas(
        StageState(), outputStructType=StageState.OUTPUT, outputMode="Append", timeMode="None"
    )


def progress(changes: DataFrame) -> DataFrame:
    """Done and skipped counts per run from stage changes; skipped files count as done."""
    closed = F.col("change").isin("complete", "skip")
    return changes.groupBy("run_id").agg(
        F.count_if(closed).alias("done"), F.count_if(F.col("change") == "skip").alias("skipped")
    )


def with_recent(table: str, view: str, keep: int = 8) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: add the batch to `table` and keep the newest completions in `view`.

    Every batch writes its own folder, so one that is retried replaces itself.  The view of a
    batch is made from the view before it and the batch alone; `view/batch={id}` is the latest.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")
        done = spark.read.schema(batch.schema).parquet(f"{table}/batch={batch_id}").where(
            F.col("change").isin("complete", "skip")
        )
        if batch_id > 0:
            done = done.unionByName(spark.read.schema(batch.schema).parquet(f"{view}/batch={batch_id - 1}"))
        stages.recent(done, "seq", "slot", keep).write.mode("overwrite").parquet(f"{view}/batch={batch_id}")

    return write


def run_progress(updates: DataFrame, folder: str, keep: int = 8) -> int | None:
    """Takes in all stage updates that are there now; changes go to `folder/changes`, the newest completions to `folder/recent`.

    Returns the number of the last batch, if there was one. Called again it goes on from its checkpoint; a batch whose commit was lost is
    done again, with the same outcome.
    """
    writer = live_stages(updates).writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    with rocksdb(updates.sparkSession):
        query = writer.foreachBatch(with_recent(f"{folder}/changes", f"{folder}/recent", keep)).start()
        query.awaitTermination()
    return max((p["batchId"] for p in query.recentProgress if p["numInputRows"]), default=None)


def progress_now(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(done and skipped counts per run, newest completions) as of the last batch."""
    changes = spark.read.schema(f"{StageState.OUTPUT}, batch INT").parquet(f"{folder}/changes")
    views = spark.read.schema(f"{StageState.OUTPUT}, batch INT").parquet(f"{folder}/recent")
    return progress(changes), views.where(F.col("batch") == changes.agg(F.max("batch")).first()[0]).drop("batch")


def run_event_sink(events: DataFrame, folder: str, keys: Sequence[str] = ("run_id",)) -> None:
    """Writes all events that are there now as JSON below `folder/events`, in a folder for each of `keys`.

    Called again it goes on from its checkpoint. Each batch's files count once the sink's own log names them, so that a batch that
    was stopped half way is done again without a row missing or twice; Spark's reader follows that log.
    """
    writer = events.writeStream.outputMode("append").format("json").option("ignoreNullFields", True).partitionBy(*keys)
    writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/events").awaitTermination()


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over everything that is there now and return what it wrote.

    In complete mode the last batch's result is what counts.  State and progress are removed at the end.
    """
    spark = stream.sparkSession
    folder = scratch_folder(spark, "stream")
    out, state = f"{folder}/out", f"{folder}/checkpoint"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    with rocksdb(spark):
        if mode == "append":
            query = writer.format("parquet").start(out)
        else:
            query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
        query.awaitTermination()
    remove(spark, state)
    return spark.read.schema(stream.schema).parquet(out)
