"""SimHash near-duplicates, found with a hierarchical index over fingerprints in Gray order.

Fingerprints that differ in few bits are found in three steps.

1. Pigeonhole. The 64 bits are cut into pieces; two fingerprints with at most `bits` differences agree on all but `bits`
   of the pieces. For each choice of agreeing pieces the fingerprint's bits are moved so that these come first.
2. Gray order. The moved fingerprints are range-partitioned and sorted by Gray rank. Those agreeing on the leading pieces
   stand next to each other (a bucket), and neighbours in a bucket share many more bits.
3. Index. Runs of a bucket are leaves; above them, nodes hold the bits that all their fingerprints share. Two nodes are
   compared by the shared bits in which they differ, added up on the way down: a pair of nodes with too many is dropped
   with everything below it.

A bucket that is long, or that goes on in the next partition, is cut into chunks. Chunks become rows with their shared
bits, so that the top of the index is a join in Spark and a hot bucket is worked on by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from reelmetrics.llm.common import components, kept

SEED = 42
WORDS = 3
#: Rows taken from an Arrow batch at a time.
SLICE = 256
#: Fingerprints in a leaf and in a chunk, and children of an inner node.
LEAF, CHUNK, FAN = 16, 1024, 8
#: Chunks of one bucket held at a time, and pairs opened at a time.
CHUNKS, PAIRS = 64, 50_000

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_HIGH = np.uint64(1 << 63)


def fingerprint_bytes(text: str | None) -> bytes:
    """The fingerprint of one text, as eight bytes, highest bit first."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    if len(words) <= WORDS:
        return xxhash.xxh64_digest(joined, SEED)
    after = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[i : j - 1], SEED) for i, j in zip([0, *after], after[WORDS - 1 :], strict=False)])
    counts = np.zeros(64, np.int64)
    table = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    for at in range(0, len(table), 1 << 16):
        counts += np.unpackbits(table[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * counts > len(table)).tobytes()


@F.arrow_udf(LongType())
def fingerprint_of(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The fingerprints of a column of texts, as signed longs. A null text counts as empty."""
    for column in columns:
        found = [fingerprint_bytes(t) for at in range(0, len(column), SLICE) for t in column.slice(at, SLICE).to_pylist()]
        yield pa.array(np.frombuffer(b"".join(found), ">u8").astype(np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id (long) and bits, its fingerprint."""
    return docs.select(F.col(key).cast("long").alias("id"), fingerprint_of(docs[text]).alias("bits"))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each value in Gray order."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def _pieces(count: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of `count` pieces that make up 64 bits."""
    edges = [round(64 * i / count) for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _moves(count: int, bits: int) -> list[tuple[list[tuple[int, int]], int]]:
    """For each choice of agreeing pieces: all pieces, those first; and the width of those."""
    parts = _pieces(count)
    return [([*chosen, *(p for p in parts if p not in chosen)], sum(w for _, w in chosen)) for chosen in combinations(parts, count - bits)]


def _move(x: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros_like(x)
    for low, width in order:
        out = (out << np.uint64(width)) | ((x >> np.uint64(low)) & np.uint64((1 << width) - 1))
    return out


def _move_batches(moves: list[tuple[list[tuple[int, int]], int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy().view(np.uint64)
            for k, (order, _) in enumerate(moves):
                rank = gray_rank(_move(x, order)) ^ _HIGH  # in signed order
                yield pa.record_batch([pa.array(np.full(len(x), k, np.int32)), pa.array(rank.view(np.int64)), pa.array(x.view(np.int64))], ["move", "rank", "bits"])

    return run


def _levels(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Nodes over `x` from the leaves up: (bits all fingerprints below share, their values)."""
    starts = np.arange(0, len(x), LEAF)
    ones, any_ = np.bitwise_and.reduceat(x, starts), np.bitwise_or.reduceat(x, starts)
    levels = [(~(ones ^ any_), ones)]
    while len(ones) > 1:
        starts = np.arange(0, len(ones), FAN)
        ones, any_ = np.bitwise_and.reduceat(ones, starts), np.bitwise_or.reduceat(any_, starts)
        levels.append((~(ones ^ any_), ones))
    return levels


def _open(i: np.ndarray, j: np.ndarray, fans: tuple[int, int], sizes: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The children of each pair of nodes, and the place of the pair each comes from."""
    a, b = np.broadcast_arrays((i * fans[0])[:, None, None] + np.arange(fans[0])[:, None], (j * fans[1])[:, None, None] + np.arange(fans[1]))
    a, b = a.reshape(-1), b.reshape(-1)
    of, there = np.repeat(np.arange(len(i)), fans[0] * fans[1]), (a < sizes[0]) & (b < sizes[1])
    return a[there], b[there], of[there]


def index_join(x: np.ndarray, y: np.ndarray | None, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in `x` and `y`, both in Gray order, that differ in at most `bits` bits; without `y`, pairs i < j of `x`."""
    own = y is None
    y = x if own else y
    left, right = _levels(x), _levels(y)
    left += left[-1:] * (len(right) - len(left))
    right += right[-1:] * (len(left) - len(right))

    def down(level: int, i: np.ndarray, j: np.ndarray, spent: np.ndarray, known: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """`known`: the bits already compared in each pair; `spent`: the differences found in them."""
        if level:
            (ls, lp), (rs, rp) = left[level - 1], right[level - 1]
            fans = tuple(1 if side[level] is side[level - 1] else FAN for side in (left, right))
        else:
            lp, rp, fans = x, y, (LEAF, LEAF)
        step = PAIRS // (fans[0] * fans[1])
        for at in range(0, len(i), step):
            part = slice(at, at + step)
            a, b, of = _open(i[part], j[part], fans, (len(lp), len(rp)))
            if own:
                ahead = a <= b if level else a < b
                a, b, of = a[ahead], b[ahead], of[ahead]
            seen = known[part][of]
            new = (ls[a] & rs[b] & ~seen) if level else ~seen
            cost = spent[part][of] + np.bitwise_count((lp[a] ^ rp[b]) & new)
            stay = cost <= bits
            if level and stay.any():
                yield from down(level - 1, a[stay], b[stay], cost[stay], (seen | new)[stay])
            elif not level:
                yield a[stay], b[stay]

    root = np.zeros(1, np.int64)
    known = left[-1][0] & right[-1][0]
    spent = np.bitwise_count((left[-1][1] ^ right[-1][1]) & known).astype(np.int64)
    if spent[0] <= bits:
        yield from down(len(left) - 1, root, root, spent, known)


def forest(pairs: Iterator[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """For each of `size` places the smallest place that the pairs join it with."""
    root = np.arange(size)
    for i, j in pairs:
        while True:
            low = np.minimum(root[i], root[j])
            if (root[i] == low).all() and (root[j] == low).all():
                break
            np.minimum.at(root, root[i], low)
            np.minimum.at(root, root[j], low)
            while not (root == root[root]).all():
                root = root[root]
    return root


def _small_buckets(x: np.ndarray, bucket: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs in buckets of at most a leaf's size, which are leaves themselves."""
    for step in range(1, LEAF):
        same = np.flatnonzero(bucket[step:] == bucket[:-step]) if step < len(bucket) else np.array([], np.int64)
        if not len(same):
            return
        near = np.bitwise_count(x[same] ^ x[same + step]) <= bits
        yield same[near], same[near] + step


_FOUND = pa.schema([("move", pa.int32()), ("bucket", pa.int64()), ("chunk", pa.int64()), ("shared", pa.int64()), ("ones", pa.int64()), ("members", pa.binary()), ("a", pa.int64()), ("b", pa.int64())])
_FOUND_DDL = "move int, bucket long, chunk long, shared long, ones long, members binary, a long, b long"


def _edge_batch(x: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
    loose = np.flatnonzero(root != np.arange(len(root)))
    none = [pa.nulls(len(loose), f.type) for f in _FOUND][:6]
    return pa.record_batch([*none, pa.array(x[loose].view(np.int64)), pa.array(x[root[loose]].view(np.int64))], schema=_FOUND)


def _chunk_batch(move: int, bucket: int, x: np.ndarray) -> pa.RecordBatch:
    """Rows for the runs of a bucket that are to be compared in Spark."""
    rows = []
    for at in range(0, len(x), CHUNK):
        run = x[at : at + CHUNK]
        ones, any_ = np.bitwise_and.reduce(run), np.bitwise_or.reduce(run)
        shared = ~(ones ^ any_)
        rows.append((move, bucket, *(int(v.view(np.int64)) for v in (run[0], shared, ones)), run.tobytes(), None, None))
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FOUND, strict=True)], schema=_FOUND)


def _settle(x: np.ndarray, starts: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Edges within the buckets that begin at `starts`."""
    sizes = np.diff(np.r_[starts, len(x)])
    small = np.repeat(sizes <= LEAF, sizes)
    run, bucket = x[small], np.repeat(np.arange(len(sizes)), sizes)[small]
    yield _edge_batch(run, forest(_small_buckets(run, bucket, bits), len(run)))
    for k in np.flatnonzero(sizes > LEAF):
        run = x[starts[k] : starts[k] + sizes[k]]
        yield _edge_batch(run, forest(index_join(run, None, bits), len(run)))


def _bucket_batches(widths: list[int], bits: int):
    """Works through a sorted partition: edges of the buckets that lie inside it, chunks of the first, the last and long ones."""
    shifts = np.array([64 - w for w in widths], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = (np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.uint64))  # the bucket that may go on
        apart = True  # whether the first bucket in `open_` goes to chunks
        for batch in batches:
            move = batch.column(0).to_numpy()
            bucket = ((batch.column(1).to_numpy().view(np.uint64) ^ _HIGH) >> shifts[move]).astype(np.int64)
            move, bucket, x = map(np.concatenate, zip(open_, (move, bucket, batch.column(2).to_numpy().view(np.uint64)), strict=True))
            starts = np.flatnonzero(np.r_[True, (move[1:] != move[:-1]) | (bucket[1:] != bucket[:-1])])
            sizes = np.diff(starts)  # the last bucket stays open
            chunked = sizes > CHUNK
            chunked[:1] |= apart
            for k in np.flatnonzero(chunked):
                yield _chunk_batch(int(move[starts[k]]), int(bucket[starts[k]]), x[starts[k] : starts[k + 1]])
            inside = np.repeat(~chunked, sizes)
            if inside.any():
                yield from _settle(x[: starts[-1]][inside], np.r_[0, np.cumsum(sizes[~chunked])[:-1]], bits)
            apart &= len(starts) == 1
            last = starts[-1]
            if len(x) - last >= CHUNKS * CHUNK:  # a hot bucket leaves in parts
                yield _chunk_batch(int(move[last]), int(bucket[last]), x[last:-1])
                last, apart = len(x) - 1, True
            open_ = move[last:], bucket[last:], x[last:]
        if len(open_[0]):
            yield _chunk_batch(int(open_[0][0]), int(open_[1][0]), open_[2])

    return run


def _chunk_pair_batches(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, left, right in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(left, np.uint64)
                if own:
                    root = forest(index_join(x, None, bits), len(x))
                else:
                    y = np.frombuffer(right, np.uint64)
                    root = forest(((i, j + len(x)) for i, j in index_join(x, y, bits)), len(x) + len(y))
                    x = np.concatenate([x, y])
                loose = np.flatnonzero(root != np.arange(len(root)))
                yield pa.record_batch([pa.array(x[loose].view(np.int64)), pa.array(x[root[loose]].view(np.int64))], ["a", "b"])

    return run


def links(distinct: DataFrame, bits: int = 3, pieces: int | None = None) -> DataFrame:
    """Edges (a, b) that join exactly the fingerprints which links of at most `bits` bits join.

    `distinct` has one row per fingerprint, in the column bits. Each bucket gives a spanning forest of its links, so there
    are at most as many edges as moved fingerprints, however dense a group is. `pieces` (by default as many as keep
    the average bucket below 64) changes the cost, not the result.
    """
    if pieces is None:
        n = distinct.count()
        pieces = next((p for p in range(bits + 1, bits + 4) if n >> min(w for _, w in _moves(p, bits)) < 64), bits + 4)
    moves = _moves(pieces, bits)
    moved = distinct.select("bits").mapInArrow(_move_batches(moves), "move int, rank long, bits long")
    ordered = moved.repartitionByRange("move", "rank").sortWithinPartitions("move", "rank")
    found = kept(ordered.mapInArrow(_bucket_batches([w for _, w in moves], bits), _FOUND_DDL))
    chunks = found.where("chunk is not null")
    nodes = chunks.select("move", "bucket", "chunk", "shared", "ones")
    left, right = nodes.alias("l"), nodes.alias("r")
    apart = F.bit_count(F.col("l.ones").bitwiseXOR(F.col("r.ones")).bitwiseAND(F.col("l.shared")).bitwiseAND(F.col("r.shared")))
    near = left.join(right, (F.col("l.move") == F.col("r.move")) & (F.col("l.bucket") == F.col("r.bucket")) & (F.col("l.chunk") <= F.col("r.chunk")) & (apart <= bits))
    near = near.select(F.col("l.move").alias("move"), F.col("l.bucket").alias("bucket"), F.col("l.chunk").alias("l"), F.col("r.chunk").alias("r"))
    members = chunks.select("move", "bucket", "chunk", "members")
    pairs = near.join(members.toDF("move", "bucket", "l", "x"), ["move", "bucket", "l"]).join(members.toDF("move", "bucket", "r", "y"), ["move", "bucket", "r"])
    crossed = pairs.select(F.expr("l = r").alias("own"), "x", "y").repartition(F.xxhash64("x", "y")).mapInArrow(_chunk_pair_batches(bits), "a long, b long")
    return found.where("a is not null").select("a", "b").union(crossed)


def _classes(prints: DataFrame, bits: int) -> DataFrame:
    """The distinct fingerprints of `prints`: bits, least (their smallest id) and component, the fingerprint their group is named by."""
    distinct = kept(prints.groupBy("bits").agg(F.min("id").alias("least")))
    parts = components(links(distinct, bits))
    return distinct.join(parts.withColumnRenamed("node", "bits"), "bits", "left").withColumn("component", F.coalesce("component", "bits"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id and kept.

    component_id is the smallest id that links reach; kept is true for that document (the first of its rows, if ids
    repeat, cannot be told apart: all are kept). Empty and null texts have fingerprint zero and link like any other.
    A document with a null id takes part; its component is the smallest id reached, or null if none has one. Equal
    fingerprints are brought together first, so a large group of copies is one node of the index.
    """
    prints = kept(fingerprints(docs, key, text))
    classes = _classes(prints, bits)
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = kept(classes.join(least, "component").select("bits", "component_id"))
    return prints.join(named, "bits").select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.expr("id <=> component_id").alias("kept"),
    )


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 3) -> DataFrame:
    """The rows of `docs` with one row left of each group of near-duplicates; all columns stay, whatever they are called.

    A group's row is the one with the least id (a null id comes last), then the least fingerprint, then the least hash of the
    text. A group is its fingerprints, so rows without an id, or with one id and unrelated texts, are in groups of their own.
    """
    id_ = docs[key].cast("long")
    # Two hashes of the text, as a table may have so many rows without an id that one hash would repeat.
    marks = [id_.isNull().alias("_none"), F.coalesce(id_, F.lit(0)).alias("_id"), F.xxhash64(docs[text]).alias("_hash"), F.xxhash64(F.lit(1), docs[text]).alias("_hash2")]
    prints = kept(docs.select(id_.alias("id"), fingerprint_of(docs[text]).alias("bits"), *marks))
    named = kept(_classes(prints, bits).select("bits", "component"))
    least = F.min(F.struct("_none", "_id", "bits", "_hash", "_hash2")).alias("least")
    chosen = kept(prints.join(named, "bits").groupBy("component").agg(least).select("least._none", "least._id", "least._hash", "least._hash2"))
    plain = [docs[f.name] for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *marks, F.xxhash64(*plain).alias("_order"))
    # Rows with the same id and text: the first is chosen before the shuffle, so a hot one does not meet in a task.
    same = ["_none", "_id", "_hash", "_hash2"]
    first = F.row_number().over(Window.partitionBy(*same).orderBy("_order"))
    return rows.withColumn("_first", first).where("_first = 1").join(chosen, same, "left_semi").select("row.*")
