"""Hard negatives by inner product: a cover tree over norm-augmented candidates, descended best first.

Candidates are quantised to integers, so that every score is an exact integer. A component is added to each that makes all
norms of a tree equal to the largest, M. Then the inner product with an anchor depends on an angle alone, and the
distance to a node's centre bounds it: below a centre at angle t from the anchor, no point within the angle p of that
centre scores more than |anchor| M cos(t - p) or less than |anchor| M cos(t + p).

A tree is explicit: its points in farthest-first order, each at the level whose radius (half of the level's above) its distance
from all points before it exceeds, below the nearest point of the levels above. So levels are nested and separated, every node covers its
children, and for each node and level the farthest point below it is known. A node opens one level at a time. The scores of
the children, which bound what lies below them, are their own exact scores, so no score is worked out twice.

Anchors meet the trees in blocks. Nodes wait in a heap, the highest bound first, with the anchors that still need them. A node is
passed over when all that lies below it is outside an anchor's window of scores or below the last that the anchor has kept.

Candidates are packed into tiles, runs in the order of label and nearest centre, each with a tree for every label in it; Spark
joins blocks of anchors with tiles, and ranks what the tiles have found.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmetrics.llm.common import kept
from reelmetrics.llm.covertree import centres_of

#: Candidates in a tile, anchors in a block, blocks of which a task remembers what it has found.
TILE, BLOCK, HELD = 2_048, 512, 64
#: Different vectors that the centres are chosen from, and centres: they order the tiles, and so decide what can be passed over.
SAMPLE, CENTRES = 4_000, 64
#: Products of vectors whose norms multiply to less are exact in doubles.
EXACT = 2.0**53
#: What rounding may add to an angle's cosine, and to a distance between points of norm 1.
SLACK, ROUGH = 1e-7, 1e-7


@dataclass(frozen=True)
class Tree:
    """A cover tree of a label's candidates, which are points[first:first + len(level)] of a tile in farthest-first order."""

    label: int
    first: int
    norm: float  # M
    level: np.ndarray
    #: Children by node and level: runs of `kids`, and the angle to the farthest point below the node at the run's level and all further ones.
    begin: np.ndarray  # runs of node k are begin[k] .. begin[k + 1]
    starts: np.ndarray
    angles: np.ndarray
    kids: np.ndarray


def tree_of(points: np.ndarray, label: int, first: int) -> tuple[np.ndarray, Tree]:
    """The order of the points in the tree, and the tree."""
    n = len(points)
    scale = float(np.abs(points).max(initial=0)) or 1.0
    unit = points / scale
    square = np.einsum("ij,ij->i", unit, unit)
    most = float(square.max())
    if not most:  # all are zero: one node above copies
        level = np.r_[0, np.ones(n - 1, int)]
        return np.arange(n), Tree(label, first, 0.0, level, np.array([0, *[int(n > 1)] * n]), np.array([0, n - 1] if n > 1 else [0]), np.zeros(int(n > 1)), np.arange(1, n))
    added = np.sqrt(np.maximum(0, most - square))
    apart = np.sqrt(np.maximum(0, 2 * (most - unit @ unit.T - np.outer(added, added))))
    order, entry = [0], [0.0]
    near = apart[0].copy()
    top = float(near.max())
    while len(order) < n:
        far = int(near.argmax())
        if near[far] <= ROUGH * math.sqrt(most):
            break
        order.append(far)
        entry.append(float(near[far]))
        np.minimum(near, apart[far], out=near)
    level = np.array([0, *(math.floor(math.log2(top / e)) + 1 for e in entry[1:])], int)
    rest = np.setdiff1d(np.arange(n), order)  # as good as copies of what is there
    level = np.r_[level, np.full(len(rest), level.max() + 1)]
    order = np.r_[order, rest].astype(int)
    apart = apart[np.ix_(order, order)]
    parent = np.full(n, -1)
    for own in np.unique(level[1:]):
        here, above = np.flatnonzero(level == own), np.flatnonzero(level < own)
        parent[here] = above[apart[np.ix_(here, above)].argmin(axis=1)]
    reach = np.full((n, level.max() + 2), -1.0)
    below = np.arange(n)
    node = below.copy()
    while True:
        up = parent[node]
        below, node, up = below[up >= 0], node[up >= 0], up[up >= 0]
        if not len(up):
            break
        np.maximum.at(reach, (up, level[node]), apart[up, below])
        node = up
    reach = np.maximum.accumulate(reach[:, ::-1], axis=1)[:, ::-1]
    kids = np.lexsort((np.arange(1, n), level[1:], parent[1:])) + 1
    fresh = np.r_[True, (np.diff(parent[kids]) != 0) | (np.diff(level[kids]) != 0)] if len(kids) else np.empty(0, bool)
    runs = np.flatnonzero(fresh)
    radii = reach[parent[kids[runs]], level[kids[runs]]]
    angles = 2 * np.arcsin(np.minimum(1, radii / (2 * math.sqrt(most)) + ROUGH))
    begin = np.searchsorted(parent[kids[runs]], np.arange(n + 1))
    return order, Tree(label, first, math.sqrt(most) * scale, level, begin, np.r_[runs, len(kids)], angles, kids)


@dataclass
class Tile:
    """Candidates with their ids and, by label, their trees."""

    ids: np.ndarray
    values: np.ndarray
    trees: list[Tree]


def tile_of(labels: np.ndarray, ids: np.ndarray, values: np.ndarray) -> Tile:
    """`labels` is ascending."""
    order, trees = [], []
    for label in np.unique(labels):
        at = np.flatnonzero(labels == label)
        own, tree = tree_of(values[at], int(label), int(at[0]))
        order.append(at[own])
        trees.append(tree)
    places = np.concatenate(order)
    return Tile(ids[places], values[places], trees)


@dataclass
class Block:
    """Anchors, and for each the windows of scores that it looks for (least and most, in columns; unused ones are empty)."""

    keys: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    values: np.ndarray
    least: np.ndarray
    most: np.ndarray


class Search:
    """What a block's anchors have found so far: for each anchor and window the best candidates in it."""

    def __init__(self, block: Block, same: bool, keep: int) -> None:
        self.block, self.same, self.keep = block, same, keep
        self.need, self.most = block.least.astype(float), block.most.astype(float)
        self.norms = np.sqrt(np.einsum("ij,ij->i", block.values, block.values))
        self.found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.scored = 0

    def visit(self, tile: Tile) -> None:
        """Looks for the tile's candidates of the anchors' own label, or of the others."""
        for tree in tile.trees:
            wanted = (self.block.labels == tree.label) == self.same
            exact = self.norms * tree.norm < EXACT
            if (anchors := np.flatnonzero(wanted & exact)).size:
                self._descend(tile, tree, anchors)
            if (anchors := np.flatnonzero(wanted & ~exact)).size:
                self._all(tile, tree, anchors)

    def _open(self, anchors: np.ndarray, scores: np.ndarray, tree: Tree, angle: float) -> np.ndarray:
        """Which of the anchors may find something below a node that they have scored; and the highest bound of those, as a cosine."""
        size = self.norms[anchors] * tree.norm
        turn = np.arccos(np.clip(scores / np.where(size, size, 1), -1, 1))
        high = (np.cos(np.maximum(0, turn - angle)) + SLACK) * size + 1e-3
        low = (np.cos(np.minimum(math.pi, turn + angle)) - SLACK) * size - 1e-3
        return ((high[:, None] >= self.need[anchors]) & (low[:, None] <= self.most[anchors])).any(axis=1), high / np.where(size, size, 1)

    def _descend(self, tile: Tile, tree: Tree, anchors: np.ndarray) -> None:
        values = tile.values[tree.first : tree.first + len(tree.level)]
        root = self.block.values[anchors] @ values[0]
        self._offer(tile, tree, np.zeros(1, int), anchors, root[:, None])
        heap, turn = [], 0
        if tree.begin[1] > tree.begin[0]:
            heap.append((0.0, 0, 0, int(tree.begin[0]), anchors, root))
        while heap:
            _, _, node, run, anchors, scores = heapq.heappop(heap)
            some, _ = self._open(anchors, scores, tree, tree.angles[run])
            anchors, scores = anchors[some], scores[some]
            if not anchors.size:
                continue
            kids = tree.kids[tree.starts[run] : tree.starts[run + 1]]
            own = self.block.values[anchors] @ values[kids].T
            self.scored += own.size
            self._offer(tile, tree, kids, anchors, own)
            next_ = [(node, run + 1, scores)] if run + 1 < tree.begin[node + 1] else []
            next_ += [(int(kids[k]), int(tree.begin[kids[k]]), own[:, k]) for k in np.flatnonzero(tree.begin[kids + 1] > tree.begin[kids])]
            for child, at, score in next_:
                some, high = self._open(anchors, score, tree, tree.angles[at])
                if some.any():
                    turn += 1
                    heapq.heappush(heap, (-float(high[some].max()), turn, child, at, anchors[some], score[some]))

    def _offer(self, tile: Tile, tree: Tree, nodes: np.ndarray, anchors: np.ndarray, scores: np.ndarray) -> None:
        ids = tile.ids[tree.first + nodes]
        other = ids != self.block.ids[anchors][:, None] if self.same else True
        for w in range(self.need.shape[1]):
            fits = (scores >= self.need[anchors, w][:, None]) & (scores <= self.most[anchors, w][:, None]) & other
            if len(nodes) > self.keep:
                best = np.partition(np.where(fits, scores, -np.inf), len(nodes) - self.keep, axis=1)[:, len(nodes) - self.keep]
                fits &= scores >= best[:, None]
            row, column = np.nonzero(fits)
            new: dict[int, list[tuple[int, int]]] = {}
            for a, s, i in zip(anchors[row].tolist(), scores[row, column].tolist(), ids[column].tolist(), strict=True):
                new.setdefault(a, []).append((-int(s), i))
            self._keep(w, new)

    def _keep(self, w: int, new: dict[int, list[tuple[int, int]]]) -> None:
        for a, rows in new.items():
            best = self.found[a, w] = sorted([*self.found.get((a, w), []), *rows])[: self.keep]
            if len(best) == self.keep and abs(best[-1][0]) < EXACT:
                self.need[a, w] = max(self.need[a, w], -best[-1][0])

    def _all(self, tile: Tile, tree: Tree, anchors: np.ndarray) -> None:
        """Without bounds, in integers of any size."""
        at = slice(tree.first, tree.first + len(tree.level))
        points = [[int(x) for x in v] for v in tile.values[at]]
        for a in anchors.tolist():
            anchor = [int(x) for x in self.block.values[a]]
            rows = [(-sum(x * y for x, y in zip(anchor, p, strict=True)), i) for p, i in zip(points, tile.ids[at].tolist(), strict=True)]
            if self.same:
                rows = [r for r in rows if r[1] != self.block.ids[a]]
            for w, (least, most) in enumerate(zip(self.block.least[a].tolist(), self.block.most[a].tolist(), strict=True)):
                self._keep(w, {a: [r for r in rows if least <= -r[0] <= most]})

    def rows(self) -> pa.RecordBatch:
        flat = [(int(self.block.keys[a]), w, max(-(2**63), min(2**63 - 1, -s)), i) for (a, w), best in self.found.items() for s, i in best]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*flat, strict=True) if flat else [[]] * 4, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["akey", "window", "score", "id"])


_FOUND_DDL = "akey long, window int, score long, id long"
_TILE_DDL, _TILE = "part int, nth int, dims int, labels array<long>, data binary", pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("dims", pa.int32()), ("labels", pa.list_(pa.int64())), ("data", pa.binary())])
_BLOCK_DDL, _BLOCK = "block long, dims int, label long, data binary", pa.schema([("block", pa.int64()), ("dims", pa.int32()), ("label", pa.int64()), ("data", pa.binary())])


def _runs(batches: Iterator[pa.RecordBatch], keys: int, most: int) -> Iterator[list[tuple]]:
    """Runs of at most so many sorted rows that agree in the first `keys` columns."""
    held: list[tuple] = []
    for batch in batches:
        for at in range(0, batch.num_rows, 1_024):
            for row in zip(*(c.slice(at, 1_024).to_pylist() for c in batch.columns), strict=True):
                if held and (held[0][:keys] != row[:keys] or len(held) == most):
                    yield held
                    held = []
                held.append(row)
    if held:
        yield held


def _matrix(rows: list[tuple], column: int) -> np.ndarray:
    return np.array([r[column] for r in rows], np.float64).reshape(len(rows), -1)


def _tile_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for nth, rows in enumerate(_runs(batches, 1, size)):
            tile = tile_of(np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), _matrix(rows, 3))
            yield pa.RecordBatch.from_pylist([{"part": part, "nth": nth, "dims": rows[0][0], "labels": [t.label for t in tile.trees], "data": pickle.dumps(tile)}], schema=_TILE)

    return run


def _block_batches(keys: int, size: int):
    """Blocks of anchors that agree in the first `keys` of (dims, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for nth, rows in enumerate(_runs(batches, keys, size)):
            width = max(len(r[5]) for r in rows)
            windows = [r[5] + [[1, 0]] * (width - len(r[5])) for r in rows]
            least = np.array([[-math.inf if w[0] is None else w[0] for w in own] for own in windows], np.float64)
            most = np.array([[math.inf if w[1] is None else w[1] for w in own] for own in windows], np.float64)
            block = Block(*(np.array([r[c] for r in rows]) for c in (2, 3, 1)), _matrix(rows, 4), least, most)
            yield pa.RecordBatch.from_pylist([{"block": (part << 32) + nth, "dims": rows[0][0], "label": rows[0][1], "data": pickle.dumps(block)}], schema=_BLOCK)

    return run


def _search_batches(same: bool, keep: int):
    """Lets blocks meet tiles, which come tile by tile; a block's findings so far narrow its next search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, Search] = {}
        at, tile = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                part, nth, number = (batch.column(c)[k].as_py() for c in ("part", "nth", "block"))
                if at != (part, nth):
                    at, tile = (part, nth), pickle.loads(batch.column("tile")[k].as_py())
                if number not in open_:
                    if len(open_) == HELD:
                        yield open_.pop(next(iter(open_))).rows()
                    open_[number] = Search(pickle.loads(batch.column("data")[k].as_py()), same, keep)
                open_[number].visit(tile)
        for search in open_.values():
            yield search.rows()

    return run


def _cell_of(centres):
    """The centre whose direction a vector is nearest to, as a column; 0 where there is none with as many components."""

    @F.arrow_udf("int")
    def nearest(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            out = np.zeros(len(column), np.int32)
            dims = np.diff(column.offsets.to_numpy())
            for n in set(dims.tolist()) & centres.value.keys():
                rows = np.flatnonzero(dims == n)
                out[rows] = (column.take(pa.array(rows)).flatten().to_numpy().reshape(-1, n) @ centres.value[n].T).argmax(axis=1)
            yield pa.array(out)

    return nearest


def quantised(vector: Column) -> Column:
    """floor(256 x) of each component, as a double; null if the vector or a component is null or not finite, or 256 x is not."""
    scaled = F.transform(vector.cast("array<double>"), lambda x: x * 256)
    fine = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    # Doubles from 2^53 on are integers; adding 0.0 turns -0.0 into 0.0.
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(scaled, lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x) + 0.0))


def _meet(blocks: DataFrame, first: Column, last: Column, parts: DataFrame, tiles: DataFrame, same: bool, keep: int) -> DataFrame:
    """What the blocks find in the tiles of the partitions `first` to `last`, at most a few rows for each anchor, window and task."""
    spark = blocks.sparkSession
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tiles.count() // 4)
    pairs = blocks.select("block", "dims", "data", F.explode(F.sequence(first, last)).alias("part")).join(parts, "part").withColumn("nth", F.explode(F.sequence(F.lit(0), F.col("number") - 1)))
    pairs = pairs.select("part", "nth", "dims", "block", "data").repartition(width, "part", "nth")
    met = pairs.join(tiles.select("part", "nth", "dims", F.col("data").alias("tile")).repartition(width, "part", "nth"), ["part", "nth", "dims"])
    found = met.select("part", "nth", "block", "data", "tile").sortWithinPartitions("part", "nth", "block").mapInArrow(_search_batches(same, keep), _FOUND_DDL)
    order = Window.partitionBy("akey", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def mine(
    embeddings: DataFrame,
    every: int = 50,
    positives: int = 5,
    negatives: int = 3,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    tile: int = TILE,
    block: int = BLOCK,
) -> DataFrame:
    """Hard negatives for each anchor (a row whose id is divisible by `every`) and each of its positives, with their scores.

    Columns anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score. A score is the inner product
    of the quantised vectors. An anchor's positives are the `positives` other rows of its label that score highest; for each, the
    `negatives` rows of other labels that score highest among those with 50 positive_score <= 100 negative_score <= 95
    positive_score; ties by smaller id. `label` may be the name of a column of whole numbers.

    Rows with a null id, label or vector, or with a component that is null, not finite, or not finite after scaling take no
    part. Vectors are compared with those of as many components; the product of empty ones is 0. Rows that repeat an id stand for
    themselves, but those with the anchor's own id are not its positives. Of equal quantised vectors of a label only the rows with the least ids are
    carried along, as many as one anchor can use, so a large group of copies costs no more. Scores beyond 64 bits are cut to the
    largest. Without anchors, positives or negatives there are no rows.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), quantised(F.col(vector)).alias("v"))
    rows = rows.where("id is not null and label is not null and v is not null").withColumn("dims", F.size("v"))
    copies = Window.partitionBy("label", "v").orderBy("id")
    most = max(positives + 1, negatives)
    points = kept(rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= most))
    sample: dict[int, list] = {}
    for r in points.where("copy = 1 and exists(v, x -> x <> 0)").select("v").orderBy(F.xxhash64("v")).limit(SAMPLE).collect():
        sample.setdefault(len(r.v), []).append(r.v)
    scaled = lambda v: np.array(v) / np.abs(v).max(axis=1, keepdims=True)
    cell = _cell_of(spark.sparkContext.broadcast({n: centres_of(scaled(v), CENTRES) for n, v in sample.items() if n}))
    order = ["dims", "label", "cell", "id"]
    sorted_ = points.withColumn("cell", cell("v")).repartitionByRange(*order).sortWithinPartitions(*order)
    tiles = kept(sorted_.select("dims", "label", "id", "v").mapInArrow(_tile_batches(tile), _TILE_DDL))
    parts = kept(tiles.groupBy("part").agg((F.max("nth") + 1).alias("number")))
    anchors = kept(rows.where(F.col("id") % every == 0).withColumn("cell", cell("v")).withColumn("akey", F.monotonically_increasing_id()))

    def blocks(of: DataFrame, keys: int) -> DataFrame:
        by = [*["dims", "label"][:keys], "cell", "akey"]
        ranged = of.repartitionByRange(*by).sortWithinPartitions(*by)
        return ranged.select("dims", "label", "akey", "id", "v", "windows").mapInArrow(_block_batches(keys, block), _BLOCK_DDL)

    whole = F.array(F.array(F.lit(None).cast("long"), F.lit(None).cast("long")))
    labels = tiles.select("dims", "part", F.explode("labels").alias("label")).groupBy("dims", "label").agg(F.min("part").alias("first"), F.max("part").alias("last"))
    near = _meet(blocks(anchors.withColumn("windows", whole), 2).join(labels, ["dims", "label"]), F.col("first"), F.col("last"), parts, tiles, True, positives)
    near = kept(near.select("akey", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))

    # 50 p <= 100 n <= 95 p, in whole numbers.
    window = F.expr("struct(window, cast(ceil(cast(positive_score as decimal(20, 0)) / 2) as long) as least, cast(floor(cast(positive_score as decimal(20, 0)) * 95 / 100) as long) as most)")
    windows = near.groupBy("akey").agg(F.transform(F.array_sort(F.collect_list(window)), lambda w: F.array(w["least"], w["most"])).alias("windows"))  # at most `positives` of them
    spans = tiles.groupBy("dims").agg(F.min("part").alias("first"), F.max("part").alias("last"))
    far = _meet(blocks(anchors.join(windows, "akey"), 1).join(spans, "dims"), F.col("first"), F.col("last"), parts, tiles, False, negatives)
    named = far.join(near, ["akey", "window"]).join(anchors.select("akey", F.col("id").alias("anchor_id")), "akey")
    return named.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def check_sql(label: str = "label", every: int = 50, positives: int = 5, negatives: int = 3) -> str:
    """DuckDB SQL for `mine` on the table embeddings, by all products of anchors and rows."""
    return f"""
    WITH e AS (
        SELECT vec_id AS id, {label} AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
    s AS (
        SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.v::DOUBLE[], b.v::DOUBLE[]) AS BIGINT) AS score
        FROM e AS a JOIN e AS b ON len(a.v) = len(b.v) WHERE a.id % {every} = 0),
    p AS (
        SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same AND id <> anchor_id
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {positives}),
    n AS (
        SELECT p.*, s.id AS negative_id, s.score AS negative_score,
               CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
        FROM p JOIN s USING (anchor_id)
        WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {negatives}"""
