"""Pairs of embeddings with a cosine at or above a threshold, exactly, by dual traversal of cover trees.

On unit vectors the cosine is a distance: cos >= t means that two points are at most sqrt(2 - 2 t) apart. Points of one label
are sorted by the nearest of a few centres, the top of a tree in Spark, and cut into chunks. Pairs of
chunks whose covering radii keep all their points apart are dropped; the others meet in a task. There each chunk has a
cover tree: nested nodes, each level with half the reach of the one above. Two trees are descended together. A pair
of nodes is dropped when even the nearest points below them are too far apart, counted as a whole when even the farthest
are near enough, and opened otherwise; the pairs of points left are decided by their cosine.

Links are not listed: each point gets its number of links, and each pair of chunks gives a spanning forest of them.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmetrics.llm.common import components, kept

#: Points in a chunk, points that centres are chosen from, and centres.
CHUNK, SAMPLE, CENTRES = 1_024, 4_000, 64
#: Points in a leaf, node pairs looked at together, and pairs of children from which they are compared by one matrix product.
LEAF, PAIRS, BLOCK = 16, 20_000, 64
#: What rounding may add to a distance, and to one that is worked out from a cosine.
SLACK, ROUGH = 1e-9, 1e-6
_ARRAYS = ("order", "centres", "levels", "radii", "runs", "counts", "below")


class Tree:
    """A cover tree over unit vectors: for each node its level, centre (a point), radius (to the farthest point below), run of points and children.

    The root's level is 2, and each level is half of the one above; levels at which a node would have itself as its only child are left out.
    The children of a node are centres more than their level apart, the node's own centre the first of them, and every point is below the nearest
    of them, at most a level away. A node with more than LEAF points is opened, down to points that are equal but for rounding.
    """

    def __init__(self, points: np.ndarray, packed: bytes | None = None) -> None:
        """The tree over `points`; `packed` is what `packed()` returned for the same points."""
        self.points = points
        if packed is not None:
            with np.load(io.BytesIO(packed)) as held:
                self.order, self.centres, self.levels, self.radii, self.runs, self.counts, self.below = (held[n] for n in _ARRAYS)
        else:
            self._grow()
        self.sizes = self.runs[:, 1] - self.runs[:, 0]
        self.starts = np.cumsum(self.counts) - self.counts

    def _grow(self) -> None:
        self.order = np.arange(len(self.points))
        self.centre: list[int] = []
        self.level: list[float] = []
        self.radius: list[float] = []
        self.run: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        self._build(0, len(self.points), 0, 2.0, self.points @ self.points.T)
        self.centres, self.levels, self.radii, self.runs = (np.array(c) for c in (self.centre, self.level, self.radius, self.run))
        self.counts = np.array([len(c) for c in self.children])
        self.below = np.array([c for own in self.children for c in own], np.int64)
        del self.centre, self.level, self.radius, self.run, self.children

    def packed(self) -> bytes:
        held = io.BytesIO()
        np.savez(held, **dict(zip(_ARRAYS, (self.order, self.centres, self.levels, self.radii, self.runs, self.counts, self.below), strict=True)))
        return held.getvalue()

    def _add(self, start: int, stop: int, centre: int, level: float, radius: float) -> int:
        self.centre.append(centre)
        self.level.append(level)
        self.radius.append(radius)
        self.run.append((start, stop))
        self.children.append([])
        return len(self.centre) - 1

    def _build(self, start: int, stop: int, centre: int, level: float, cosines: np.ndarray) -> int:
        """A node for the points order[start:stop] around `centre`, the first of them. `cosines` has a row and a column for each of them, in that order."""
        if stop - start == 1:
            return self._add(start, stop, centre, level, 0.0)
        inside = self.order[start:stop]
        radius = float(np.linalg.norm(self.points[inside] - self.points[centre], axis=1).max())
        node = self._add(start, stop, centre, level, radius)
        if stop - start <= LEAF or radius <= ROUGH:
            return node
        while level >= radius:
            level /= 2
        while True:
            net = self._net(cosines, 1 - level * level / 2)
            if len(net) > 1:
                break
            level /= 2
        owner = cosines[:, net].argmax(axis=1)
        owner[net] = np.arange(len(net))
        by_owner = np.lexsort((np.arange(len(owner)) != np.array(net)[owner], owner))  # each centre before the points below it
        inside = inside[by_owner]
        self.order[start:stop] = inside
        ends = np.searchsorted(owner[by_owner], np.arange(len(net)), "right")
        for at, end in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
            own = cosines[np.ix_(by_owner[at:end], by_owner[at:end])] if end - at > LEAF else cosines[:0]
            self.children[node].append(self._build(start + at, start + end, int(inside[at]), level, own))
        return node

    @staticmethod
    def _net(cosines: np.ndarray, least: float) -> list[int]:
        """Places of centres, the first point first, of which no two have a cosine of `least` or more, while every point has that with one of them."""
        covered, net = np.zeros(len(cosines), bool), []
        for place in range(len(cosines)):
            if not covered[place]:
                net.append(place)
                covered |= cosines[place] >= least
                covered[place] = True
        return net

    def inside(self, node: int) -> np.ndarray:
        return self.order[slice(*self.runs[node])]

    def kids(self, node: int) -> np.ndarray:
        return self.below[self.starts[node] : self.starts[node] + self.counts[node]]

    def opened(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children of all `nodes`, and the place of the node that each belongs to."""
        counts = self.counts[nodes]
        of = np.repeat(np.arange(len(nodes)), counts)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        return self.below[self.starts[nodes][of] + nth], of


def dual_join(left: Tree, right: Tree | None, reach: float) -> Iterator[tuple]:
    """Pairs of nodes of two trees: ("all", x, y), all points below them are within `reach`; ("some", x, y), leaves of which pairs are still to
    be decided; ("points", i, j), two arrays of points, the same for leaves of one point each.

    Without `right`, pairs within `left`, each once; a node beside itself stands for the pairs among its own points.
    """
    own = right is None
    right = left if own else right
    open_ = [(np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while open_:
        a, b = open_.pop()
        if len(a) > PAIRS:
            open_.append((a[PAIRS:], b[PAIRS:]))
            a, b = a[:PAIRS], b[:PAIRS]
        apart = np.linalg.norm(left.points[left.centres[a]] - right.points[right.centres[b]], axis=1)
        spread = left.radii[a] + right.radii[b]
        same = (a == b) & own
        alone = (left.sizes[a] == 1) & (right.sizes[b] == 1)
        whole = ~alone & (np.where(same, 2 * left.radii[a], apart + spread) <= reach - SLACK)
        for x, y in zip(a[whole].tolist(), b[whole].tolist(), strict=True):
            yield "all", x, y
        stay = ~whole & ~(alone & same) & (apart - spread <= reach + SLACK)
        a, b, same, alone = a[stay], b[stay], same[stay], alone[stay]
        leaf_a, leaf_b = left.counts[a] == 0, right.counts[b] == 0
        both = leaf_a & leaf_b
        if alone.any():
            yield "points", left.centres[a[alone]], right.centres[b[alone]]
        for x, y in zip(a[both & ~alone].tolist(), b[both & ~alone].tolist(), strict=True):
            yield "some", x, y
        many = ~leaf_a & ~leaf_b & (left.counts[a] * right.counts[b] >= BLOCK)
        by_left = ~leaf_a & ~same & ~many & (leaf_b | (left.radii[a] >= right.radii[b]))
        by_right = ~leaf_b & ~same & ~many & ~by_left
        p, of = left.opened(a[by_left])
        q, to = right.opened(b[by_right])
        next_ = [(p, b[by_left][of]), (a[by_right][to], q)]
        for x, y, within in zip(a[many].tolist(), b[many].tolist(), same[many].tolist(), strict=True):
            next_.append(_near_children(left, right, x, y, within, reach))
        for x in a[same & ~many & ~leaf_a].tolist():
            children = left.kids(x)
            i, j = np.triu_indices(len(children))
            next_.append((children[i], children[j]))
        a, b = (np.concatenate(side) for side in zip(*next_, strict=True))
        if len(a):
            open_.append((a, b))


def _near_children(left: Tree, right: Tree, x: int, y: int, within: bool, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a child of `x` and a child of `y` that their radii do not keep apart; `within` one node, each pair once."""
    p, q = left.kids(x), right.kids(y)
    r, t = left.radii[p], right.radii[q]
    cosines = left.points[left.centres[p]] @ right.points[right.centres[q]].T
    i, j = np.nonzero(cosines >= 1 - (r.max() + t.max() + reach + ROUGH) ** 2 / 2)  # what the largest radii leave
    near = cosines[i, j] >= 1 - (r[i] + t[j] + reach + ROUGH) ** 2 / 2
    if within:
        near &= i <= j
    return p[i[near]], q[j[near]]


def scaled(x: np.ndarray) -> np.ndarray:
    """The vectors times powers of two that bring their largest components near 1: the same cosines, and norms that neither overflow nor vanish."""
    exponent = np.frexp(np.abs(x).max(axis=1, initial=0))[1]
    return np.ldexp(x, -exponent[:, None])


def linked(x: np.ndarray, y: np.ndarray | None, weight_x: np.ndarray, weight_y: np.ndarray | None, threshold: float, trees: tuple[bytes | None, bytes | None] = (None, None)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of the points linked with each point of `x` and of `y` (without `y`: of `x` alone), and for each point the least place that links join it with.

    The rows are vectors, not yet of unit length; `trees` are their cover trees as `Tree.packed` gives them, where there are any. Products of unit vectors find the pairs of two leaves that may link; whether
    one does is decided by its cosine in double precision.
    """
    own = y is None
    x = scaled(x)
    y, weight_y = (x, weight_x) if own else (scaled(y), weight_y)
    size_x, size_y = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    left = Tree(x / size_x[:, None], trees[0])
    right = left if own else Tree(y / size_y[:, None], trees[1])
    count_x = np.zeros(len(x), np.int64)
    count_y = count_x if own else np.zeros(len(y), np.int64)
    shift = 0 if own else len(x)
    root = np.arange(len(x) + (0 if own else len(y)))

    def join(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal root
        while True:
            low = np.minimum(root[i], root[j])
            if (root[i] == low).all() and (root[j] == low).all():
                return
            np.minimum.at(root, root[i], low)
            np.minimum.at(root, root[j], low)
            while not (root == root[root]).all():
                root = root[root]

    def decide(p: np.ndarray, q: np.ndarray) -> None:
        near = np.einsum("ij,ij->i", x[p], y[q]) / (size_x[p] * size_y[q]) >= threshold
        p, q = p[near], q[near]
        if len(p):
            np.add.at(count_x, p, weight_y[q])
            np.add.at(count_y, q, weight_x[p])
            join(p, q + shift)

    for kind, a, b in dual_join(left, None if own else right, math.sqrt(max(0.0, 2 - 2 * threshold))):
        if kind == "points":
            decide(a, b)
            continue
        i, j = left.inside(a), right.inside(b)
        same = own and a == b
        if kind == "all":
            count_x[i] += weight_y[j].sum() - (weight_x[i] if same else 0)
            if not same:
                count_y[j] += weight_x[i].sum()
            join(np.r_[i, np.full(len(j), i[0])], np.r_[np.full(len(i), i[0]), j + shift])
            continue
        p, q = np.nonzero(left.points[i] @ right.points[j].T >= threshold - SLACK)
        if same:
            p, q = p[p < q], q[p < q]
        decide(i[p], j[q])
    return count_x, count_y, root


_LINK = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("to", pa.int64())])
_LINK_DDL = "id long, links long, to long"


def _vectors(data: bytes) -> np.ndarray:
    """Vectors packed as their length and doubles."""
    return np.frombuffer(data, np.float64, offset=8).reshape(-1, int(np.frombuffer(data, np.int64, 1)[0]))


def _pair_batches(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids_x, ids_y, w_x, w_y = (np.frombuffer(batch.column(n)[k].as_py() or b"", np.int64) for n in ("ids_x", "ids_y", "weights_x", "weights_y"))
                x = _vectors(batch.column("vectors_x")[k].as_py())
                own = batch.column("own")[k].as_py()
                y = None if own else _vectors(batch.column("vectors_y")[k].as_py())
                trees = tuple(batch.column(n)[k].as_py() for n in ("tree_x", "tree_y"))
                count_x, count_y, root = linked(x, y, w_x, None if own else w_y, threshold, trees)
                ids = ids_x if own else np.r_[ids_x, ids_y]
                links = count_x if own else np.r_[count_x, count_y]
                some = links > 0
                yield pa.record_batch([pa.array(ids[some]), pa.array(links[some]), pa.array(ids[root[some]])], schema=_LINK)

    return run


_CHUNK_DDL = "label string, dims int, chunk long, centre array<double>, radius double, ids binary, weights binary, vectors binary, tree binary"
_CHUNK = pa.schema([("label", pa.string()), ("dims", pa.int32()), ("chunk", pa.int64()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), ("ids", pa.binary()), ("weights", pa.binary()), ("vectors", pa.binary()), ("tree", pa.binary())])


def _chunk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of a partition sorted by label, dims and cell: runs of at most CHUNK points of a label."""
    held: list[tuple] = []

    def close() -> pa.RecordBatch:
        ids, weights = (np.array([r[n] for r in held], np.int64) for n in (3, 4))
        vectors = scaled(np.array([r[5] for r in held], np.float64))
        unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
        centre = unit.mean(axis=0)
        radius = float(np.linalg.norm(unit - centre, axis=1).max()) + SLACK
        packed = np.int64(vectors.shape[1]).tobytes() + vectors.tobytes()
        return pa.RecordBatch.from_pylist([{"label": held[0][0], "dims": held[0][1], "chunk": int(ids[0]), "centre": centre.tolist(), "radius": radius, "ids": ids.tobytes(), "weights": weights.tobytes(), "vectors": packed, "tree": Tree(unit).packed()}], schema=_CHUNK)

    for batch in batches:
        for at in range(0, batch.num_rows, 1_024):
            for row in zip(*(c.slice(at, 1_024).to_pylist() for c in batch.columns), strict=True):
                if held and (held[0][:2] != row[:2] or len(held) == CHUNK):
                    yield close()
                    held = []
                held.append(row)
    if held:
        yield close()


def _cell_of(centres):
    """The nearest centre of a vector, as a column; 0 where there is none with as many components."""

    @F.arrow_udf("int")
    def nearest(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            out = np.zeros(len(column), np.int32)
            dims = np.diff(column.offsets.to_numpy())
            for n in set(dims.tolist()) & centres.value.keys():
                rows = np.flatnonzero(dims == n)
                points = scaled(column.take(pa.array(rows)).flatten().to_numpy().reshape(-1, n))
                points = points / np.linalg.norm(points, axis=1)[:, None]
                out[rows] = (points @ centres.value[n].T).argmax(axis=1)
            yield pa.array(out)

    return nearest


def centres_of(points: np.ndarray, count: int = CENTRES) -> np.ndarray:
    """Up to `count` of the points, as unit vectors, that are far from each other."""
    points = scaled(points)
    points = points / np.linalg.norm(points, axis=1)[:, None]
    chosen, nearest = [0], np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < min(count, len(points)) and nearest.max() > SLACK:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, np.linalg.norm(points - points[chosen[-1]], axis=1))
    return points[chosen]


def usable(vector: Column) -> Column:
    """Whether a vector can link: no null, not empty, all components finite, not all zero."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def near_duplicates(embeddings: DataFrame, threshold: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per row of `embeddings`: vec_id, n_links, component_id and kept.

    Vectors are compared when their labels are equal and not null and they have as many components. n_links is the number
    of other rows linked directly, component_id the least id reachable by links, itself included, and kept whether that
    is the row's own. Vectors that are null, empty, zero or hold null or non-finite components link with nothing. Equal
    vectors of a label are one point with a weight, so a large group of copies costs as much as one. Repeated rows link
    with each other. A null id takes part but is no component's name unless there is no other. The centres are chosen from
    the `SAMPLE` different vectors with the least hash; they decide how well pairs are pruned, not which are found.
    """
    rows = embeddings.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.withColumn("able", usable(F.col("v")) & F.col("label").isNotNull())
    # -0.0 and 0.0 are one value to a grouping, as to a cosine.
    points = rows.where("able").groupBy("label", "v").agg(F.count("*").alias("weight"), F.min("id").alias("least"))
    points = kept(points.withColumn("point", F.xxhash64("label", "v")).withColumn("dims", F.size("v")))
    sample: dict[int, list] = {}
    for r in points.select("point", "v").orderBy("point").limit(SAMPLE).collect():
        sample.setdefault(len(r.v), []).append(r.v)
    centres = embeddings.sparkSession.sparkContext.broadcast({n: centres_of(np.array(v, np.float64)) for n, v in sample.items()})
    named = points.withColumn("cell", _cell_of(centres)("v"))
    ordered = named.select("label", "dims", "cell", "point", "weight", "v").repartitionByRange("label", "dims", "cell", "point").sortWithinPartitions("label", "dims", "cell", "point")
    chunks = kept(ordered.mapInArrow(_chunk_batches, _CHUNK_DDL))
    heads = chunks.select("label", "dims", "chunk", "centre", "radius")
    l, r = heads.alias("l"), heads.alias("r")
    apart = F.sqrt(F.aggregate(F.zip_with("l.centre", "r.centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b))
    reach = F.lit(math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK)
    near = l.join(r, (F.col("l.label") == F.col("r.label")) & (F.col("l.dims") == F.col("r.dims")) & (F.col("l.chunk") <= F.col("r.chunk")) & (apart <= F.col("l.radius") + F.col("r.radius") + reach))
    near = near.select(F.col("l.label").alias("label"), F.col("l.dims").alias("dims"), F.col("l.chunk").alias("chunk_x"), F.col("r.chunk").alias("chunk_y"))
    side = lambda s: chunks.select("label", "dims", *[F.col(c).alias(f"{c}_{s}") for c in ("chunk", "ids", "weights", "vectors", "tree")])
    pairs = near.join(side("x"), ["label", "dims", "chunk_x"]).join(side("y"), ["label", "dims", "chunk_y"])
    pairs = pairs.withColumn("own", F.col("chunk_x") == F.col("chunk_y")).repartition("label", "chunk_x", "chunk_y")
    found = kept(pairs.select("own", "ids_x", "weights_x", "vectors_x", "tree_x", "ids_y", "weights_y", "vectors_y", "tree_y").mapInArrow(_pair_batches(threshold), _LINK_DDL))
    counts = found.groupBy(F.col("id").alias("point")).agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")))
    classes = points.select("label", "v", "point", "weight", "least").join(counts, "point", "left").join(parts.withColumnRenamed("node", "point"), "point", "left")
    classes = classes.withColumn("component", F.coalesce("component", "point"))
    names = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    done = kept(classes.join(names, "component").select("point", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"))
    out = rows.select("id", F.when(F.col("able"), F.xxhash64("label", "v")).alias("point")).join(done, "point", "left")
    component = F.when(F.col("point").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.expr("vec_id <=> component_id"))
