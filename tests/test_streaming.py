"""Streams give what batch gives, also when stopped and started again."""

import json
import os
import random
import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from reelmetrics import schemas
from reelmetrics.operators import cadence, ticks
from reelmetrics.sources import readers
from reelmetrics.streaming import streams


@pytest.fixture(autouse=True)
def state_store(spark):
    with streams.rocksdb(spark):
        yield


def drop(folder, name, data):
    """Put a file of JSON rows into a landing folder, a minute newer than the one before."""
    folder.mkdir(parents=True, exist_ok=True)
    age = 3600 - 60 * len(list(folder.iterdir()))
    (folder / name).write_text("\n".join(json.dumps(d) for d in data) + "\n")
    stamp = time.time() - age
    os.utime(folder / name, (stamp, stamp))


def run(df, out, checkpoint, mode="append", **options):
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True)
    query = writer.format("parquet").start(str(out)) if mode == "append" else writer.foreachBatch(options["sink"]).start()
    query.awaitTermination()


def test_frame_counts_follow_the_logs(spark, tmp_path):
    rng = random.Random(1)
    landing = tmp_path / "landing"
    landing.mkdir()
    flags = {"a": rng.choices(["progressive", "tff", "bff", "odd"], k=300), "b": ["tff"] * 40}

    def log(name, part, words, start):
        text = "".join(f"frame:{start + i} pts:0\nlavfi.idet.multiple.current_frame={w}\n" for i, w in enumerate(words))
        (landing / part).mkdir(exist_ok=True)
        (landing / part / f"{name}.log").write_text(text)

    latest = {}

    def sink(batch, _):
        latest.update({r["video_id"]: r for r in rows(batch)})

    log("a", "p1", flags["a"][:120], 0)
    live = streams.live_frame_counts(readers.stream_frame_log(spark, str(landing), files_per_trigger=1))
    run(live, None, tmp_path / "cp", "update", sink=sink)
    assert latest["a"]["total"] == 120
    log("a", "p2", flags["a"][120:], 120)
    log("b", "p2", flags["b"], 0)
    live = streams.live_frame_counts(readers.stream_frame_log(spark, str(landing), files_per_trigger=1))
    run(live, None, tmp_path / "cp", "update", sink=sink)
    batch = {r["video_id"]: r for r in rows(cadence.frame_counts(readers.read_frame_log(spark, str(landing))))}
    assert latest == batch and batch["a"]["total"] == 300


def tick_rows(n):
    rng = random.Random(4)
    total = {h: 0 for h in range(3)}
    idle = {h: 0 for h in range(3)}
    for i in range(n):
        h = i % 3
        step = rng.choice([0, 10, 100])
        total[h] += step
        idle[h] += rng.randint(0, step)
        yield {"host": h, "tick_id": i, "tick_ms": i * 700, "cpu_total": total[h], "cpu_idle": idle[h],
               "gpu_pct": rng.choice([None, 5, 50]), "cpu_free": rng.randint(0, 20), "nvenc_free": rng.randint(0, 4)}


def test_cpu_use_across_batches_and_restart(spark, tmp_path):
    data = list(tick_rows(240))
    landing, out = tmp_path / "landing", tmp_path / "out"
    drop(landing, "1.json", data[:50])
    drop(landing, "2.json", data[50:55])
    live = lambda: streams.live_cpu_pct(readers.stream_table(spark, str(landing), schemas.TICKS, files_per_trigger=1))
    run(live(), out, tmp_path / "cp")
    drop(landing, "3.json", data[55:])
    run(live(), out, tmp_path / "cp")
    got = {r["tick_id"]: r["cpu_pct"] for r in rows(spark.read.parquet(str(out)))}
    whole = ticks.cpu_pct(spark.read.schema(schemas.TICKS).json(str(landing)))
    want = {r["tick_id"]: r["cpu_pct"] for r in rows(whole)}
    assert len(got) == 240 and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_summary_equals_batch(spark, tmp_path):
    data = list(tick_rows(100))
    landing = tmp_path / "landing"
    for n in range(4):
        drop(landing, f"{n}.json", data[n * 25 : (n + 1) * 25])
    latest = {}
    live = streams.live_tick_summary(readers.stream_table(spark, str(landing), schemas.TICKS, files_per_trigger=1))
    run(live, None, tmp_path / "cp", "update", sink=lambda b, _: latest.update({r["host"]: r for r in rows(b)}))
    batch = {r["host"]: r for r in rows(ticks.tick_summary(spark.read.schema(schemas.TICKS).json(str(landing))))}
    assert latest == batch


def test_intervals_close_with_the_watermark(spark, tmp_path):
    landing, out = tmp_path / "landing", tmp_path / "out"
    stamp = lambda m: f"2024-01-01T{m // 60:02d}:{m % 60:02d}:00Z"
    drop(landing, "1.json", [{"t": stamp(m), "host": 1, "cpu_free": m} for m in (0, 1, 4, 5, 9)])
    drop(landing, "2.json", [{"t": stamp(m), "host": 1, "cpu_free": m} for m in (2, 30)])
    drop(landing, "3.json", [{"t": stamp(m), "host": 1, "cpu_free": m} for m in (59,)])
    drop(landing, "4.json", [{"t": stamp(m), "host": 1, "cpu_free": m} for m in (3,)])
    source = readers.stream_table(spark, str(landing), "t TIMESTAMP, host INT, cpu_free INT", files_per_trigger=1)
    run(streams.tick_intervals(source), out, tmp_path / "cp")
    got = {r["interval"]["start"].minute: r["samples"] for r in rows(spark.read.parquet(str(out)))}
    # the sample of minute 2 is late but in time, that of minute 3 comes after its interval was closed
    assert got[0] == 4 and got[5] == 2 and 55 not in got


def follow(updates):
    """The slots' states, one update at a time."""
    opened, out = {}, []
    for u in updates:
        slot, kind = u["slot"], u["kind"]
        if kind == "begin":
            opened[slot] = "Starting"
            out.append((slot, u["seq"], "begin", "Starting"))
        elif kind == "set" and slot in opened and opened[slot] != u["stage"]:
            opened[slot] = u["stage"]
            out.append((slot, u["seq"], "stage", u["stage"]))
        elif kind == "complete" and slot in opened:
            out.append((slot, u["seq"], "complete", opened.pop(slot)))
        elif kind == "skip":
            out.append((slot, u["seq"], "skip", ""))
    return sorted(out)


def test_stage_states_progress_and_recent(spark, tmp_path):
    rng = random.Random(9)
    updates = []
    for seq in range(400):
        kind = rng.choice(["begin", "set", "set", "set", "complete", "skip"])
        updates.append({"run_id": "r", "slot": rng.randint(0, 5), "seq": seq, "kind": kind, "file": f"f{seq}",
                        "stage": rng.choice(["Detect", "Phase 1"]) if kind == "set" else None, "detail": None, "level": "ok" if kind == "complete" else None})
    landing, table, view = tmp_path / "landing", str(tmp_path / "changes"), str(tmp_path / "recent")
    for n in range(4):
        drop(landing, f"{n}.json", updates[n * 100 : (n + 1) * 100])
    source = readers.stream_table(spark, str(landing), schemas.STAGES, files_per_trigger=1)
    query = (
        streams.live_stages(source).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).foreachBatch(streams.with_recent(table, view)).start()
    )
    query.awaitTermination()
    changes = spark.read.parquet(table).drop("batch")
    got = sorted((r["slot"], r["seq"], r["change"], r["stage"]) for r in rows(changes))
    want = follow(updates)
    assert got == want
    done = [w for w in want if w[2] in ("complete", "skip")]
    (count,) = rows(streams.progress(changes))
    assert (count["done"], count["skipped"]) == (len(done), len([w for w in want if w[2] == "skip"]))
    newest = [r["seq"] for r in rows(spark.read.parquet(f"{view}/batch=3"))]
    assert sorted(newest, reverse=True) == sorted((w[1] for w in done), reverse=True)[:8]


def test_thinning_is_stateless(spark, tmp_path):
    landing, out = tmp_path / "landing", tmp_path / "out"
    base = {"video_id": 1, "op": "x", "alt_index": 0, "cpu": 1, "nvenc": 0, "nvdec": 0, "cuda": 0}
    drop(landing, "1.json", [base | {"wait_ms": w, "hold_ms": h, "woken": k} for w, h, k in [(0, 5, 0), (7, 5, 1), (0, 30_000, 0)]])
    run(streams.live_thin_events(readers.stream_table(spark, str(landing), schemas.OPS)), out, tmp_path / "cp")
    assert sorted(r["event"] for r in rows(spark.read.parquet(str(out)))) == ["acquire", "release", "release"]


def test_events_stream(spark, tmp_path):
    landing, out = tmp_path / "landing", tmp_path / "out"
    drop(landing, "1.json", [{"@t": "2024-05-01T10:00:00Z", "@mt": "Stage: {Stage}", "File": "f"}])
    run(readers.stream_events(spark, str(landing)).select("t", "kind", "file"), out, tmp_path / "cp")
    assert rows(spark.read.parquet(str(out)).select("kind", "file")) == [{"kind": "stage", "file": "f"}]
    assert spark.read.parquet(str(out)).where(F.col("t").isNull()).count() == 0


def test_intervals_over_runs_with_rejects(spark, tmp_path):
    """Every sample is in a closed interval, still open, or rejected; rejected ones are those of intervals closed before."""
    landing, folder = tmp_path / "landing", str(tmp_path / "out")
    stamp = lambda m: f"2024-01-01T{m // 60:02d}:{m % 60:02d}:00Z"
    runs = [[0, 1, 4, 9, 16], [2, 7, 30], [3, 8, 12, 31, 44], [21, 29, 58]]
    for n, minutes in enumerate(runs):
        drop(landing, f"{n}.json", [{"t": stamp(m), "host": 1, "cpu_free": m} for m in minutes])
        source = spark.readStream.schema("t TIMESTAMP, host INT, cpu_free INT").json(str(landing))
        streams.run_intervals(source, folder)
    latest, closed, rejected = None, {}, []
    for minutes in runs:
        for m in minutes:
            if latest is not None and m // 5 * 5 + 5 <= latest - 10:
                rejected.append(m)
            else:
                closed.setdefault(m // 5 * 5, []).append(m)
        latest = max(minutes + [latest or 0])
    closed = {k: len(v) for k, v in closed.items() if k + 5 <= latest - 10}
    got = {r["interval"]["start"].minute: r["samples"] for r in rows(spark.read.parquet(f"{folder}/closed"))}
    assert got == closed and rejected
    assert sorted(r["cpu_free"] for r in rows(spark.read.schema("t TIMESTAMP, host INT, cpu_free INT").parquet(f"{folder}/rejects"))) == sorted(rejected)


def test_a_batch_done_again_changes_nothing(spark, tmp_path):
    landing, folder = str(tmp_path / "landing"), str(tmp_path / "out")
    for n in range(3):
        updates = [{"run_id": "r", "slot": s, "seq": n * 10 + k, "kind": kind, "file": f"f{s}", "stage": "Detect", "detail": "", "level": "ok"}
                   for s in range(4) for k, kind in enumerate(("begin", "set", "complete", "skip"))]
        drop(tmp_path / "landing", f"{n}.json", updates)
        source = spark.readStream.schema(schemas.STAGES).json(landing)
        last = streams.run_progress(source, folder)
        counts, newest = streams.progress_now(spark, folder)
    before = rows(counts), rows(newest, "seq", "slot")
    assert before[0] == [{"run_id": "r", "done": 24, "skipped": 12}] and len(before[1]) == 8
    assert streams.run_progress(source, folder) is None
    (tmp_path / "out" / "checkpoint" / "commits" / str(last)).unlink()
    (tmp_path / "out" / "checkpoint" / "commits" / f".{last}.crc").unlink(missing_ok=True)
    assert streams.run_progress(source, folder) == last
    counts, newest = streams.progress_now(spark, folder)
    assert (rows(counts), rows(newest, "seq", "slot")) == before


def test_event_sink_goes_on_after_a_stop(spark, tmp_path):
    landing, folder = tmp_path / "landing", str(tmp_path / "out")
    for n in range(3):
        drop(landing, f"{n}.json", [{"run_id": f"r{k % 2}", "event": "acquire", "n": n * 10 + k} for k in range(10)])
        streams.run_event_sink(spark.readStream.schema("run_id STRING, event STRING, n LONG").json(str(landing)), folder)
    # A file that no batch of the sink's log names, as a stopped task leaves it, does not count.
    (tmp_path / "out" / "events" / "run_id=r0" / "part-stopped.json").write_text('{"event":"acquire","n":99}\n')
    found = spark.read.schema("event STRING, n LONG, run_id STRING").json(f"{folder}/events")
    assert sorted(r["n"] for r in rows(found)) == list(range(30)) and {r["run_id"] for r in rows(found)} == {"r0", "r1"}
