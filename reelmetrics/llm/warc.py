"""Deterministic sharded WARC archives: a writer that commits through a manifest, and a reader.

The pages are cut into shards, ranges of page_id of about equal volume, that follow from the table alone. A task sorts a
shard, gives every record a gzip member of its own and starts the next file when the compressed size is reached, so equal
tables give equal files byte for byte, however the input was partitioned. Files are written under temporary names;
those of tasks that ended well are then renamed, and the manifest that lists them with sizes and digests makes the
archive valid. Attempts of lost tasks are in no manifest.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmetrics.llm.common import kept

#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 100
#: Every record's date: the archive is made anew from a table that has no dates.
DATE = "2000-01-01T00:00:00Z"
LEVEL = 4
#: Ranges that a shard's share of ids is first cut into, and that a heavy one is cut into again.
FIRST, AGAIN = 4096, 16
#: Most tasks that read files.
READERS = 100_000
#: Bytes counted for a record besides its payload.
HEAD = 400

_FILE_DDL = "name string, temporary string, shard long, records long, bytes long, sha256 string"
_MANIFEST_DDL = "name string, shard long, records long, bytes long, sha256 string"
_RECORD_DDL = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, file string"
_RECORD_KINDS = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _store(folder: str) -> tuple[pa.fs.FileSystem, str]:
    if folder.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return pa.fs.FileSystem.from_uri(folder) if "://" in folder else (pa.fs.LocalFileSystem(), folder)


def shard_starts(weights: DataFrame, volume: int) -> list[int]:
    """First ids of ranges of about `volume` in all, from `weights` (page_id, weight): a range is refined while it is heavier and has more ids than one."""
    weights = weights.where("page_id is not null").withColumn("at", F.col("page_id").cast("decimal(20, 0)"))
    low, high = weights.agg(F.min("page_id"), F.max("page_id")).first()
    if low is None:
        return []
    width = 1
    while width * FIRST < high - low + 1:
        width *= AGAIN
    heavy, cells = None, {}
    while heavy is None or heavy:
        found = weights.withColumn("cell", F.expr(f"cast((at - {low}) div {width} as long)"))
        if heavy is not None:
            parents = weights.sparkSession.createDataFrame([(c,) for c in heavy], "parent long")  # at most one for each `volume`
            found = found.withColumn("parent", F.expr(f"cell div {AGAIN}")).join(F.broadcast(parents), "parent")
        counts = {r.cell: r.w for r in found.groupBy("cell").agg(F.sum("weight").alias("w")).collect()}
        heavy = [c for c, w in counts.items() if w > volume and width > 1]
        cells |= {low + c * width: w for c, w in counts.items() if w <= volume or width == 1}
        width //= AGAIN
    starts, filled = [], 0
    for start in sorted(cells):
        if not starts or filled + cells[start] > volume:
            starts.append(start)
            filled = 0
        filled += cells[start]
    return starts


def record_id(page_id: int | None, digest: str, repeat: int = 0) -> str:
    name = f"{page_id} {digest} {repeat}" if repeat else f"{page_id} {digest}"
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(name.encode()).digest()[:16], version=4)}>"


def _head(fields: list[tuple[str, object]]) -> bytes:
    lines = (f"{k}: {re.sub(r'[\r\n]+', ' ', str(v))}\r\n" for k, v in fields if v is not None)
    return ("WARC/1.1\r\n" + "".join(lines) + "\r\n").encode()


def _member(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One record as a gzip member without a date."""
    fields = [*fields, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", len(block))]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(_head(fields)) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def page_member(page_id: int | None, url: str | None, payload: bytes, first: int | None, repeat: int) -> bytes:
    """The record of a page: a response, or with `first` a revisit of that page."""
    digest = hashlib.sha256(payload).hexdigest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields: list[tuple[str, object]] = [
        ("WARC-Type", "response" if first is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest, repeat)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", url),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Page-ID", page_id),
    ]
    if first is not None:
        fields += [("WARC-Profile", _REVISIT), ("WARC-Refers-To", record_id(first, digest)), ("X-Refers-To-Page-ID", first)]
    return _member(fields, http + (payload if first is None else b""))


class _File:
    """A file under a temporary name, with what the manifest says of it."""

    def __init__(self, folder: str, shard: int, number: int) -> None:
        self.name = f"pages-{shard:06d}-{number:05d}.warc.gz"
        self.temporary = f"_temporary/{uuid.uuid4().hex}-{self.name}"
        self.shard, self.records, self.bytes, self.hash = shard, 0, 0, hashlib.sha256()
        store, path = _store(folder)
        store.create_dir(f"{path}/_temporary", recursive=True)
        self.out = store.open_output_stream(f"{path}/{self.temporary}", compression=None)
        about = f"format: WARC File Format 1.1\r\nfilename: {self.name}\r\n".encode()
        self.put(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, self.name)), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], about))
        self.records = 0

    def put(self, member: bytes) -> None:
        self.out.write(member)
        self.hash.update(member)
        self.records, self.bytes = self.records + 1, self.bytes + len(member)

    def close(self) -> pa.RecordBatch:
        self.out.close()
        return pa.RecordBatch.from_pylist([{"name": self.name, "temporary": self.temporary, "shard": self.shard, "records": self.records, "bytes": self.bytes, "sha256": self.hash.hexdigest()}])


def _write_batches(folder: str, limit: int):
    """Writes sorted shards. A page's marks, which say what it revisits, come before its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, number, mark, page, repeat = None, 0, None, None, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for shard, page_id, digest, first, url, payload in zip(*(batch.column(i).slice(at, 64).to_pylist() for i in range(6)), strict=True):
                    if payload is None:
                        mark = (page_id, digest, first)
                        continue
                    if file is not None and file.shard != shard:
                        yield file.close()
                        file = None
                        number = 0
                    repeat = repeat + 1 if page == (page_id, digest) else 0
                    page = (page_id, digest)
                    member = page_member(page_id, url, payload, mark[2] if mark and mark[:2] == page else None, repeat)
                    if file is not None and file.records and file.bytes + len(member) > limit:
                        yield file.close()
                        file, number = None, number + 1
                    file = file or _File(folder, shard, number)
                    file.put(member)
        if file is not None:
            yield file.close()

    return run


def _commit_batches(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                if store.get_file_info(f"{path}/{row['temporary']}").type != pa.fs.FileType.NotFound:
                    store.move(f"{path}/{row['temporary']}", f"{path}/{row['name']}")
                elif store.get_file_info(f"{path}/{row['name']}").size != row["bytes"]:  # else an earlier attempt has moved it
                    raise FileNotFoundError(row["temporary"])
            yield batch.select(["name", "shard", "records", "bytes", "sha256"])

    return run


def write_archives(pages: DataFrame, folder: str, shard_bytes: int = 64 << 20, file_bytes: int = 32 << 20) -> DataFrame:
    """Writes a record for each row of `pages` (page_id, url, html) below `folder`, and returns the manifest.

    The payload is the html in UTF-8; null counts as empty. Of rows with equal payloads of at least 100 bytes those with the
    least page_id are responses, the others revisits of it; all others are responses. Repeated rows are records of their own.
    A row with a null page_id stands in shard 0, revisits a page with an id if one has its payload, and is a response
    otherwise. A null url is left out. Files hold about `file_bytes`, shards about `shard_bytes` of payload; only rows of one page_id cannot be
    divided. An empty table gives an archive without files. `folder` must not hold an archive yet.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    lean = kept(rows.select("page_id", "digest", F.length("payload").alias("size")))
    long = lean.where(F.col("size") >= LEAST_REVISIT)
    firsts = kept(long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first"))
    marks = long.join(firsts, "digest").where("not page_id <=> first").select("page_id", "digest", "first").distinct()
    starts = shard_starts(lean.select("page_id", (F.col("size") + HEAD).alias("weight")), shard_bytes)

    @F.arrow_udf("long")
    def shard_of(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(np.array(starts, np.int64), ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), "right"))

    none = F.lit(None)
    both = marks.select("page_id", "digest", "first", none.cast("string").alias("url"), none.cast("binary").alias("payload")).unionByName(rows.withColumn("first", none.cast("long")))
    sharded = both.select(shard_of("page_id").alias("shard"), "page_id", "digest", "first", "url", "payload").repartition(len(starts) + 1, "shard")
    ordered = sharded.sortWithinPartitions("shard", "page_id", "digest", F.col("payload").isNotNull(), "url")
    files = kept(ordered.mapInArrow(_write_batches(folder, file_bytes), _FILE_DDL))
    files.mapInArrow(_commit_batches(folder), _MANIFEST_DDL).write.mode("error").json(f"{folder}/manifest")
    store, path = _store(folder)
    if store.get_file_info(f"{path}/_temporary").type == pa.fs.FileType.Directory:
        store.delete_dir(f"{path}/_temporary")
    return spark.read.schema(_MANIFEST_DDL).json(f"{folder}/manifest")


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The uncompressed content of each gzip member of a file."""
    data, unpacker, parts = b"", zlib.decompressobj(31), []
    while data or (data := stream.read(chunk)):
        parts.append(unpacker.decompress(data))
        data = unpacker.unused_data
        if unpacker.eof:
            yield b"".join(parts)
            unpacker, parts = zlib.decompressobj(31), []
    if any(parts):
        raise EOFError("the last record is cut short")


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, by lower-case name, and block of a record, whose length and digest are checked."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n" or fields["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"record {fields['warc-record-id']} is damaged")
    return fields, block


def _page(fields: dict[str, str], block: bytes, file: str, with_payload: bool) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    size, digest = int(re.search(rb"Content-Length: (\d+)", head)[1]), fields["warc-payload-digest"].removeprefix("sha256:")
    response = fields["warc-type"] == "response"
    if response and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
    number = lambda name: int(fields[name]) if name in fields else None
    return number("x-page-id"), fields.get("warc-target-uri"), payload if response and with_payload else None, size, digest, fields["warc-type"], number("x-refers-to-page-id"), fields["warc-record-id"], file


def _read_batches(folder: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            names = [c.split()[0] for c in _RECORD_DDL.split(", ")]
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _RECORD_KINDS, strict=True)], names)

        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for fields, block in map(parse_record, members(stream)):
                        if fields["warc-type"] != "warcinfo":
                            rows.append(_page(fields, block, name, with_payload))
                            held += len(block) if with_payload else HEAD
                        if held > 8 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return run


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """The page records of the files that the manifest lists; lengths and digests are checked, and damage raises.

    payload is null in revisits; payload_bytes and payload_digest are those of the full payload in both kinds.
    """
    files = spark.read.schema(_MANIFEST_DDL).json(f"{folder}/manifest").select("name")
    # One file a task; without a number, the names are so short that they would be put into one.
    files = files.repartition(max(1, min(files.count(), READERS)))
    return files.mapInArrow(_read_batches(folder, with_payload), _RECORD_DDL)
