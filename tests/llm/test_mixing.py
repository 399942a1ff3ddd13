import random
from collections import Counter
from fractions import Fraction

import pytest

from reelmetrics.llm import mixing


@pytest.mark.parametrize("seed", range(8))
def test_windows_and_lag(seed):
    rng = random.Random(seed)
    share = mixing.shares([rng.random() ** 3 + 0.001 for _ in range(rng.randint(1, 30))], 256)
    slots = mixing.pfair_slots(share, 256)
    assert sum(share) == 256
    order = sorted((s, i) for i, own in enumerate(slots) for s in own)
    assert [s for s, _ in order] == list(range(256))
    given = Counter()
    for t, i in order:
        given[i] += 1
        assert all(abs(Fraction(a * (t + 1), 256) - given[k]) < 1 for k, a in enumerate(share))


def simulate(blocks, weights, period):
    """Slot of every block, one slot after another."""
    left, done, place, t = list(blocks), [0] * len(blocks), {}, 0
    while any(left):
        active = [i for i, n in enumerate(left) if n]
        share = dict(zip(active, mixing.shares([weights[i] for i in active], period), strict=True))
        given, base = Counter(), t
        while True:
            ready = [(-(-(given[i] + 1) * period // a), i) for i, a in share.items() if given[i] * period // a <= t - base]
            i = min(ready)[1]
            if not left[i]:
                break
            place[i, done[i]] = t
            given[i], done[i], left[i], t = given[i] + 1, done[i] + 1, left[i] - 1, t + 1
    return place


@pytest.mark.parametrize("seed", range(6))
def test_phases_equal_the_simulation(seed):
    rng = random.Random(seed)
    blocks = [rng.choice([0, 1, 3, 40, 200]) for _ in range(7)]
    weights = [rng.random() + 0.05 for _ in blocks]
    got = {}
    for r in mixing.phases(blocks, weights, 64):
        for k in range(r.count):
            got[r.source, r.first + k] = r.base + k // r.share * 64 + r.slots[k % r.share]
    assert got == simulate(blocks, weights, 64)
    assert sorted(got.values()) == list(range(sum(blocks)))


def test_mix_of_documents(spark):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randint(0, 60), rng.choice(["a", "a", "a", "b", None]), "kept", i) for i in range(400)]
    rows += [(7, None, "c", "kept", 1), (None, "", "a", "kept", 2), (7, "y" * 900, "a", "kept", 3), (7, "y" * 900, "a", "kept", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, slot string, block int")
    got = mixing.mix(docs, block=100, period=64, slices=8).collect()
    assert len(got) == len(rows)
    assert Counter(r.row.doc_id for r in got) == Counter(r[0] for r in rows)
    assert {r.row.slot for r in got} == {"kept"}
    streams = {}
    for r in got:
        assert r.release <= r.slot < r.deadline
        assert streams.setdefault((r.source_group, r.block), r.slot) == r.slot
    assert len(set(streams.values())) == len(streams)
    for group in {r.source_group for r in got}:
        at = 0
        for r in sorted((r for r in got if r.source_group == group), key=lambda r: (r.start, len(r.row.text or ""))):
            assert r.start == at
            at += len(r.row.text or "")
    assert {r.phase == 0 for r in got if r.in_mix} >= {True}


def test_named_weights_pool_the_rest(spark):
    docs = spark.createDataFrame([(i, "x" * 10, s) for i, s in enumerate("abcd" * 20)], "doc_id long, text string, source string")
    got = mixing.mix(docs, weights={"a": 3.0, "b": 1.0, ...: 0.5}, block=10, period=16).collect()
    assert len({r.source_group for r in got}) == 3
    first = sorted((r.slot, r.row.source) for r in got if r.phase == 0)[:9]
    assert Counter(s for _, s in first)["a"] in (6, 7)
    assert mixing.mix(docs.where("false")).count() == 0
