import math
from collections import Counter

import numpy as np
import pytest

from reelmetrics.llm import hard_negatives
from reelmetrics.llm.hard_negatives import Block, Search, mine, tile_of, tree_of

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every=50, positives=5, negatives=3):
    """All rows of the result, in integers, by comparing every anchor with every row."""
    usable = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, q, own in usable:
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(q, v, strict=True)), i, label) for i, v, label in usable if len(v) == len(q)]
        for p, positive, _ in sorted(s for s in scored if s[2] == own and s[1] != a)[:positives]:
            fits = sorted(s for s in scored if s[2] != own and 50 * -p <= 100 * -s[0] <= 95 * -p)[:negatives]
            out += [(a, positive, k + 1, i, -p, -n) for k, (n, i, _) in enumerate(fits)]
    return Counter(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA) if isinstance(rows, list) else rows
    return Counter(map(tuple, mine(df, **options).collect()))


def clustered(count, dims, seed, families=12):
    """Vectors around a few directions, of different norms, with copies."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(families, dims))
    rows = centres[rng.integers(0, families, count)] * rng.uniform(0.2, 2, (count, 1)) + rng.normal(size=(count, dims)) * 0.05
    rows[: count // 5] = rows[0]
    return rows


@pytest.mark.parametrize("points", [clustered(300, 8, 1), np.random.default_rng(2).normal(size=(200, 32)), np.zeros((5, 4)), np.ones((7, 3)), np.ones((1, 3)), np.eye(6), np.empty((4, 0))])
def test_tree_is_a_cover_tree(points):
    """Every point once; children nearer to their parent than the radius of the level above; points of a level apart; radii cover."""
    points = np.floor(points * 256)
    order, tree = tree_of(points, 0, 0)
    assert sorted(order.tolist()) == list(range(len(points)))
    values = points[order]
    scale = tree.norm or 1
    full = np.c_[values, np.sqrt(np.maximum(0, tree.norm**2 - (values**2).sum(axis=1)))] / scale
    apart = np.linalg.norm(full[:, None] - full[None], axis=2)
    top = apart[0].max()
    seen = [0]
    below = {k: [k] for k in range(len(points))}

    def descendants(node):
        return [node, *(x for r in range(tree.begin[node], tree.begin[node + 1]) for c in tree.kids[tree.starts[r] : tree.starts[r + 1]] for x in descendants(c))]

    for node in range(len(points)):
        runs = range(tree.begin[node], tree.begin[node + 1])
        levels = [tree.level[tree.kids[tree.starts[r]]] for r in runs]
        assert levels == sorted(set(levels)) and all(x > tree.level[node] for x in levels)
        for r in runs:
            kids = tree.kids[tree.starts[r] : tree.starts[r + 1]]
            seen += kids.tolist()
            assert (apart[node, kids] <= top / 2 ** (tree.level[kids[0]] - 1) + 1e-6).all()
            deep = [x for q in range(r, tree.begin[node + 1]) for c in tree.kids[tree.starts[q] : tree.starts[q + 1]] for x in descendants(c)]
            angles = 2 * np.arcsin(np.minimum(1, apart[node, deep] / 2))
            assert (angles <= tree.angles[r] + 1e-6).all() and tree.angles[r] <= angles.max() + 1e-4
    assert sorted(seen) == list(range(len(points))) and below
    for level in range(1, tree.level.max() + 1):
        net = np.flatnonzero(tree.level <= level)
        near = apart[np.ix_(net, net)][np.triu_indices(len(net), 1)]
        assert level == tree.level.max() or not len(near) or near.min() > top / 2**level - 1e-6


def test_tree_of_the_given_vectors(spark, small):
    """Every vector is a node of its own. These have random directions, about as far from each other, so most lie below the root."""
    rows = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    order, tree = tree_of(np.floor(256 * np.array([r.embedding for r in rows], float)), 0, 0)
    assert len(set(order.tolist())) == len(tree.level) == len(rows) and tree.level.max() >= 1
    assert np.diff(tree.starts).sum() == len(rows) - 1


def test_search_passes_over_nodes():
    """On vectors in families far fewer products are worked out than there are pairs, and the best are found."""
    values = np.floor(256 * clustered(2_000, 16, 3, 40))
    ids, labels = np.arange(len(values)), np.zeros(len(values), int)
    anchors = np.arange(0, len(values), 50)
    block = Block(anchors, anchors, labels[anchors], values[anchors], np.full((len(anchors), 1), -np.inf), np.full((len(anchors), 1), np.inf))
    search = Search(block, True, 5)
    search.visit(tile_of(labels, ids, values))
    scores = values[anchors] @ values.T
    for a in range(len(anchors)):
        want = sorted((-int(s), i) for i, s in enumerate(scores[a]) if i != anchors[a])[:5]
        assert search.found[a, 0] == want
    assert search.scored < 0.5 * scores.size


@pytest.mark.parametrize("seed", range(2))
def test_against_all_pairs(spark, seed):
    rng = np.random.default_rng(seed)
    vectors = clustered(240, 6, seed, 5) if seed else rng.normal(size=(240, 6)) / 2
    rows = [(int(i) * 10, v.tolist(), int(rng.integers(0, 3))) for i, v in enumerate(vectors)]
    for options in ({}, {"tile": 16, "block": 3}):
        assert mined(spark, rows, **options) == brute(rows)


def test_odd_rows(spark):
    """Nulls, other lengths, zeros, copies, repeated ids, negative ids, huge and tiny components."""
    near = [(k, [1.0 + k / 1000, 0.5], k % 2) for k in range(-100, 101, 5)]
    odd = [
        (None, [1.0, 0.5], 0), (50, None, 0), (50, [1.0, None], 0), (50, [1.0, float("nan")], 0), (50, [float("inf"), 1.0], 1), (100, [1.0, 0.5], None),
        (150, [], 0), (151, [], 0), (152, [], 1), (200, [0.0, 0.0], 0), (201, [0.0, -0.0], 1), (202, [1e-300, -1e-300], 0),
        (250, [1.0], 0), (251, [1.0], 0), (252, [0.9], 1), (300, [1.0, 0.5, 2.0], 1), (350, [1.0, 0.5], 0), (350, [1.0, 0.5], 0), (351, [0.9, 0.5], 1),
    ]
    assert mined(spark, near + odd) == brute(near + odd)
    huge = [(k, [1e9 * (1 + k / 100), 3.0], k % 2) for k in range(0, 60, 4)]
    assert mined(spark, huge + near) == Counter(
        {(a, p, r, n, min(x, 2**63 - 1), min(y, 2**63 - 1)): c for (a, p, r, n, x, y), c in brute(huge + near).items()}
    )
    assert mined(spark, [(50, [1e200, 1.0], 0), (51, [1e200, 1.0], 0), (52, [7e305, 1.0], 1)]) == Counter()


def test_copies_in_number(spark):
    """A third of all rows are one vector; ties go to the smaller ids."""
    rows = [(k, [0.5, 0.25, 0.1] if k % 3 == 0 else [0.4 + k % 7 / 50, 0.2, k % 11 / 40], k % 2) for k in range(600)]
    assert mined(spark, rows, tile=32, block=4) == brute(rows)


def test_without_rows(spark):
    assert mined(spark, []) == Counter()
    assert mined(spark, [(50, [1.0], 0)]) == Counter()
    assert mined(spark, [(1, [1.0], 0), (2, [1.0], 0), (3, [0.8], 1)]) == Counter()
    assert mined(spark, [(50, [1.0], 0), (2, [1.0], 0)]) == Counter()


def test_clashing_columns(spark):
    rows = [(k, [1.0 + k / 500, 0.5], k % 2, k, "x", 0.1, k, b"y") for k in range(120)]
    df = spark.createDataFrame(rows, SCHEMA + ", id long, v string, cell double, akey long, data binary")
    assert mined(spark, df) == brute([r[:3] for r in rows])


def test_scores_of_numbers_without_bounds():
    assert hard_negatives.EXACT == 2.0**53
