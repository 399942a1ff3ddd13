import numpy as np
import pytest
import xxhash

from reelmetrics.llm import simhash


def reference_bits(text):
    words = [w for w in (text or "").encode().lower().split()] if (text or "").isascii() else None
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def roots(values, bits):
    """Smallest value reachable by links, by comparing all pairs."""
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= bits:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {v: find(v) for v in values}


def mixed_values(count, seed, flips=3):
    """Random values, and families that wander away from a few of them."""
    rng = np.random.default_rng(seed)
    values = [int(v) for v in rng.integers(0, 2**64, count, dtype=np.uint64)]
    for start in values[: count // 8]:
        v = start
        for _ in range(20):
            for k in rng.integers(0, 64, rng.integers(0, flips + 2)):
                v ^= 1 << int(k)
            values.append(v)
    return sorted(set(values))


@pytest.mark.parametrize("text", ["", "one", "one two", "a b c", "A b C d e f g", "\x1cx y\x0bz w", "the cat sat on the mat " * 40])
def test_fingerprint_of_a_text(text):
    assert int.from_bytes(simhash.fingerprint_bytes(text), "big") == reference_bits(text)


def test_index_join_finds_every_pair():
    x = np.array(mixed_values(150, 1), np.uint64)
    x = x[np.argsort(simhash.gray_rank(x))]
    found = {(int(x[i]), int(x[j])) for a, b in simhash.index_join(x, None, 3) for i, j in zip(a, b, strict=True)}
    assert found == {(int(x[i]), int(x[j])) for i in range(len(x)) for j in range(i + 1, len(x)) if (int(x[i]) ^ int(x[j])).bit_count() <= 3}
    y = x[::7]
    crossed = sum(len(a) for a, _ in simhash.index_join(x, y, 3))
    assert crossed == sum((int(a) ^ int(b)).bit_count() <= 3 for a in x for b in y)


@pytest.mark.parametrize("pieces", [4, 5, 6])
def test_links_join_what_brute_force_joins(spark, pieces, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 32)
    values = mixed_values(60, pieces) + [v for v in range(1 << 9)]  # the last ones fill one bucket
    values = sorted(set(values))
    signed = [(int(np.uint64(v).view(np.int64)),) for v in values]
    edges = simhash.links(spark.createDataFrame(signed, "bits long"), 3, pieces)
    got = simhash.components(edges).collect()
    as_unsigned = lambda v: v & (2**64 - 1)
    want = roots(values, 3)
    groups = {}
    for r in got:
        groups.setdefault(r.component, set()).add(as_unsigned(r.node))
    expected = {}
    for v, r in want.items():
        expected.setdefault(r, set()).add(v)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in expected.values() if len(g) > 1}


def test_documents_with_odd_rows(spark):
    words = " ".join(f"w{i}" for i in range(300))
    rows = [(5, words, None, 1), (3, words.upper(), "en", 2), (None, words, "en", 3), (9, None, "en", 4), (8, "", "en", 5), (7, "alone in here", "en", 6), (7, "alone in here", "en", 6), (2, "x" * 200_000, "en", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string, bits int")
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in simhash.near_duplicates(docs).collect())
    assert got == sorted([(5, 3, False), (3, 3, True), (-1, 3, False), (9, 8, False), (8, 8, True), (7, 7, True), (7, 7, True), (2, 2, True)])
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_one_row_of_each_group_stays(spark):
    def words(k):
        return " ".join(f"w{k}x{i}" for i in range(300))

    rows = [(None, words(1), "a"), (None, words(2), "b"), (None, words(2), "b"), (None, words(3), "c"), (4, words(3).upper(), "c")]
    rows += [(5, words(4), "d"), (5, words(5), "e"), (9, words(5).upper(), "e"), (6, words(6), "f"), (6, words(6), "f"), (None, None, "g"), (8, "", "g")]
    docs = spark.createDataFrame(rows, "row_id long, text string, _id string").withColumnRenamed("row_id", "doc_id")
    got = simhash.deduplicate(docs)
    assert got.columns == docs.columns
    want = [(None, "a"), (None, "b"), (4, "c"), (5, "d"), (5, "e"), (6, "f"), (8, "g")]
    assert sorted(((r.doc_id, r["_id"]) for r in got.collect()), key=lambda r: r[1]) == want
    assert simhash.deduplicate(docs.where("false")).count() == 0
