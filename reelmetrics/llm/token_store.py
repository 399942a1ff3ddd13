"""Token ids in ORC: integer run-length encoding, row indexes, and Bloom filters on document ids.

Documents are sorted into ranges of doc_id, a range is encoded by one task and becomes one file of stripes. Each row holds its
document's ids and how many ids its file has before it, so that any stripe can be read by itself. The manifest, written last,
has each file's rows, ids and id range, and its place among all ids.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmetrics.llm.packing import _byte_letters, _Memo

#: Id after each document.
END = 2
#: Parts of plain texts and words of others that are remembered.
PARTS, WORDS = 800_000, 100_000
#: Rows of a batch with ids.
SLICE = 256
#: Most files whose places are broadcast (16 bytes each); beyond that they are joined.
BROADCAST_FILES = 1_000_000
#: A word with the white space before it. No token of the tokenizer goes from a word on into white space.
_CHUNK = re.compile(r"\s*\S+|\s+")
#: Control characters that are white space to `re` only.
_CONTROLS = re.compile("[\x1c-\x1f]")
#: Latin letters, which all versions of Unicode agree on; and what else than those and ASCII is in a text.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_OTHER = re.compile(f"[^\\x00-\\x7f{_LETTERS}]")
#: How the tokenizer parts a text (a fixed value), for texts of ASCII and Latin letters.
_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+")

_ROW_DDL = "part int, doc_id long, before long, n_tokens long, ids array<int>"
_ROW = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
_MANIFEST_DDL = "part int, rows long, tokens long, least long, most long, start long"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Token ids of texts, as little-endian unsigned 32-bit, the same as the tokenizer's own for the whole text.

    A byte-level tokenizer parts a text before it merges. So plain texts are parted here, and each part is encoded once and
    remembered. A text with other letters is cut at the ends of words, where a part always ends, and words with such letters
    go to the tokenizer; so does the whole of a text with a special token's string.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer, self.letters = _tokenizer(path), _byte_letters()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.parts, self.words = _Memo(self._part, PARTS), _Memo(self._word, WORDS)

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _part(self, part: str) -> bytes:
        ids = [t.id for t in self.tokenizer.model.tokenize("".join([self.letters[b] for b in part.encode()]))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        return self._whole(word) if _OTHER.search(word) else self._plain(word)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, _PARTS.findall(text)))

    def text(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special) or _CONTROLS.search(text):
            return self._whole(text)
        return b"".join(map(self.words.__getitem__, _CHUNK.findall(text))) if _OTHER.search(text) else self._plain(text)


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """A worker's encoder, with what it remembers, serves all its tasks."""
    return Encoder(path)


def _encode_batches(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before, mark = _encoder(path), TaskContext.get().partitionId(), 0, struct.pack("<I", end)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                keys, texts = (batch.column(i).slice(at, SLICE) for i in (0, 1))
                ids = [encoder.text(t) + mark for t in texts.to_pylist()]
                n = np.array([len(b) // 4 for b in ids], np.int64)
                offsets = np.r_[0, np.cumsum(n)]
                values = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))
                yield pa.record_batch([pa.array(np.full(len(n), part), pa.int32()), keys, pa.array(before + offsets[:-1]), pa.array(n), values], schema=_ROW)
                before += int(offsets[-1])

    return run


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    end: int = END,
    files: int | None = None,
    stripe_bytes: int = 64 << 20,
    index_rows: int = 1_000,
    false_positives: float = 0.01,
    compression: str = "zstd",
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Writes the documents' token ids, each with `end` after it, in ascending doc_id order below `folder`; returns the manifest.

    A null or empty text is `end` alone. Rows without an id come last, and rows of one id are in the order of their texts'
    hashes and texts; each row keeps its own ids. `files` is the number of files, by default that of the partitions of
    `docs`; an id that repeats is spread by its texts. Ids are unsigned to the tokenizer and below 2^31 in the files. `folder`
    must not exist. An empty table gives a manifest without rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = [F.asc_nulls_last("doc_id"), F.xxhash64("text").asc(), F.col("text").asc()]
    ranged = rows.repartitionByRange(files or max(1, rows.rdd.getNumPartitions()), *order[:2]).sortWithinPartitions(*order)
    encoded = ranged.mapInArrow(_encode_batches(tokenizer_path, end), _ROW_DDL)
    options = {
        "compression": compression,
        "orc.stripe.size": stripe_bytes,
        "orc.create.index": "true",
        "orc.row.index.stride": index_rows,
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": false_positives,
    }
    encoded.write.mode("error").options(**options).orc(f"{folder}/tokens")
    found = _rows(spark, folder).groupBy("part").agg(F.count("*").alias("rows"), F.sum("n_tokens").alias("tokens"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    start, manifest = 0, []
    for r in found.orderBy("part").collect():  # one row a file
        manifest.append((*r, start))
        start += r.tokens
    spark.createDataFrame(manifest, _MANIFEST_DDL).coalesce(1).write.mode("error").json(f"{folder}/manifest")
    return read_manifest(spark, folder)


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_ROW_DDL).orc(f"{folder}/tokens")


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """part, rows, tokens, least and most (doc_id) and start (ids in the files before) of each file."""
    return spark.read.schema(_MANIFEST_DDL).json(f"{folder}/manifest")


def read_tokens(spark: SparkSession, folder: str, where: Column | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of the documents written.

    `where` is a condition on doc_id; it reaches the files, whose stripes and row groups without such ids are not read. Stripes are
    read by as many tasks as `spark.sql.files.maxPartitionBytes` asks for.
    """
    rows = _rows(spark, folder)
    rows = rows if where is None else rows.where(where)
    places = read_manifest(spark, folder).select(F.col("part"), F.col("start").alias("_start"))
    if places.count() <= BROADCAST_FILES:
        places = F.broadcast(places)
    return rows.join(places, "part").select("doc_id", (F.col("_start") + F.col("before")).alias("start"), "n_tokens", "ids")


def _crc_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4")
        crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit) of what `read_tokens` gives."""
    return tokens.mapInArrow(_crc_batches, "doc_id long, start long, n_tokens long, ids_crc32 long")
