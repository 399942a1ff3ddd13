import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from reelmetrics.llm import covertree


def clouds(seed, count=300, dims=8):
    """Points around a few centres, some of them very close, with copies and multiples."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    points = centres[rng.integers(0, 12, count)] + rng.normal(size=(count, dims)) * rng.choice([0.001, 0.05, 0.2, 1.0], count)[:, None]
    points[1], points[2], points[3] = points[0], points[0] * 3, -points[0]
    return points


def brute(x, y, threshold):
    return (x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)) >= threshold


def groups(near):
    root = np.arange(len(near))
    while True:
        new = np.array([min(root[i], root[near[i]].min(initial=i)) for i in range(len(near))])
        if (new == root).all():
            return root
        root = new


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("threshold", [0.98, 0.7])
def test_linked_against_all_pairs(seed, threshold):
    x, y = clouds(seed), clouds(seed, 120)
    wx, wy = np.arange(1, len(x) + 1), np.arange(1, len(y) + 1)
    near = brute(x, x, threshold)
    np.fill_diagonal(near, False)
    count, _, root = covertree.linked(x, None, wx, None, threshold)
    assert (count == near @ wx).all() and (root == groups(near)).all()
    cross = brute(x, y, threshold)
    count_x, count_y, root = covertree.linked(x, y, wx, wy, threshold)
    assert (count_x == cross @ wy).all() and (count_y == cross.T @ wx).all()
    both = np.block([[np.zeros((len(x),) * 2, bool), cross], [cross.T, np.zeros((len(y),) * 2, bool)]])
    assert (root == groups(both)).all()


def unit(points):
    return points / np.linalg.norm(points, axis=1)[:, None]


def check_tree(tree):
    """Covering, nesting, separation, halving levels and small leaves, and that every point lies below the root once."""
    apart = lambda a, b: np.linalg.norm(tree.points[a] - tree.points[b], axis=-1)
    assert sorted(tree.order) == list(range(len(tree.points)))
    for node in range(len(tree.centres)):
        children = tree.kids(node)
        below = tree.inside(node)
        assert tree.radii[node] == pytest.approx(apart(below, tree.centres[node]).max(), abs=1e-9)
        assert below[0] == tree.centres[node] and (not node or tree.radii[node] <= tree.levels[node] + 1e-6)
        if not len(children):
            assert len(below) <= covertree.LEAF or tree.radii[node] <= covertree.ROUGH
            continue
        assert np.array_equal(np.concatenate([tree.inside(c) for c in children]), below)
        (level,) = {tree.levels[c] for c in children}
        assert level <= tree.levels[node] / 2 and math.log2(level).is_integer()
        centres = np.array([tree.centres[c] for c in children])
        between = apart(centres[:, None], centres[None])
        assert tree.centres[node] == centres[0] and (between[~np.eye(len(centres), dtype=bool)] > level - 1e-6).all()
        assert (apart(below[:, None], centres[None]).min(axis=1) >= np.concatenate([apart(tree.inside(c), tree.centres[c]) for c in children]) - 1e-6).all()


@pytest.mark.parametrize("dims", [2, 8, 64])
def test_tree_covers_and_halves(dims):
    tree = covertree.Tree(unit(clouds(5, dims=dims)))
    check_tree(tree)
    assert len(set(tree.levels)) > 4
    again = covertree.Tree(tree.points, tree.packed())
    check_tree(again)
    assert np.array_equal(again.order, tree.order)


def test_tree_on_given_vectors():
    """Every label of the given vectors has a tree of more than one level; its bounds leave few pairs, and all that link are among them."""
    table = pq.read_table("/root/testdata/sf0.01/embeddings.parquet").to_pylist()
    reach = math.sqrt(2 - 2 * 0.98)
    for label in {r["label"] for r in table if r["label"] is not None}:
        points = np.array([r["embedding"] for r in table if r["label"] == label and r["embedding"]], np.float64)
        tree = covertree.Tree(unit(points))
        check_tree(tree)
        assert len(set(tree.levels)) > 1
        left = set()
        for kind, a, b in covertree.dual_join(tree, None, reach):
            if kind == "points":
                left |= {frozenset(p) for p in zip(a.tolist(), b.tolist(), strict=True)}
            else:
                left |= {frozenset((i, j)) for i in tree.inside(a).tolist() for j in tree.inside(b).tolist() if i != j}
        near = np.triu(brute(points, points, 0.98), 1)
        assert {frozenset(p) for p in np.argwhere(near).tolist()} <= left
        assert len(left) <= near.sum() + 0.1 * len(points) * (len(points) - 1) / 2


def test_far_clusters_are_pruned():
    rng = np.random.default_rng(1)
    points = np.repeat(np.eye(20), 30, axis=0) + rng.normal(size=(600, 20)) * 0.01
    tree = covertree.Tree(points / np.linalg.norm(points, axis=1)[:, None])
    size = lambda node: len(tree.inside(node))
    decided = sum(len(a) if kind == "points" else size(a) * size(b) for kind, a, b in covertree.dual_join(tree, None, math.sqrt(0.04)) if kind != "all")
    assert decided < 600 * 30


@pytest.mark.parametrize("chunk", [16, 1_024])
def test_rows_against_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(covertree, "CHUNK", chunk)
    points = clouds(7, 200)
    rows = [(i, p.tolist(), i % 3 if i > 5 else 0, "x") for i, p in enumerate(points)]
    odd = [None, [], [0.0] * 8, [float("nan")] + [1.0] * 7, [float("inf")] * 8, [None] + [1.0] * 7, [1.0] * 3, [2.0] * 3]
    rows += [(1000 + k, v, 0, "x") for k, v in enumerate(odd)] + [(2000, points[9].tolist(), None, "x"), (None, points[9].tolist(), 0, "x"), (9, points[9].tolist(), 0, "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, kept string")
    got = covertree.near_duplicates(table).collect()
    fine = [v is not None and len(v) and None not in v and np.isfinite(v).all() and any(v) and label is not None for _, v, label, _ in rows]
    near = np.zeros((len(rows),) * 2, bool)
    for a in range(len(rows)):
        for b in range(len(rows)):
            (_, v, lv, _), (_, w, lw, _) = rows[a], rows[b]
            if a != b and fine[a] and fine[b] and lv == lw and len(v) == len(w):
                near[a, b] = np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.98
    root = groups(near)
    least = {r: min((rows[i][0] for i in np.flatnonzero(root == r) if rows[i][0] is not None), default=None) for r in set(root.tolist())}
    want = [(key, int(near[i].sum()), least[root[i]], key == least[root[i]]) for i, (key, *_) in enumerate(rows)]
    order = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert covertree.near_duplicates(table.where("false")).count() == 0


def test_vectors_of_very_different_sizes(spark):
    """Links do not depend on a vector's size, and no vector takes the links of others along."""
    base = np.array([[1.0, 0.1], [1.0, 0.11], [1.0, 0.12], [1.0, 0.09]])
    sizes = [1.0, 1e-200, 1e200, 5e-320, 1e300, 3.0]
    vectors = [(base[k % 4] * s).tolist() for k, s in enumerate(sizes)] + [[0.0, 1.0], [0.0, 1e-310], [0.0, -1e308]]
    df = spark.createDataFrame([(k, v, 1) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in covertree.near_duplicates(df).collect()}
    assert got == {**{k: (5, 0) for k in range(6)}, 6: (1, 6), 7: (1, 6), 8: (0, 8)}
