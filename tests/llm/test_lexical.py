import math
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reelmetrics.llm import lexical

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms_of(text):
    plain = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(lexical.TERM, plain)


def brute(docs, items, keep=50):
    """The ranking by the formula, with a full index of terms."""
    counts = [(i, Counter(terms_of(t))) for i, t in docs]
    some = [c for _, c in counts if c]
    number, length = len(some), sum(c.total() for c in some)
    df = Counter(t for c in some for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms_of(t))
    out = []
    for item, terms in wanted.items():
        scored = []
        for doc, c in counts:
            if not c:
                continue
            m = 50 + 50 * c.total() * number // length
            s = sum(math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        out += [(item, k + 1, doc, -s) for k, (s, _, _, doc) in enumerate(sorted(scored, key=lambda x: x[:3])[:keep])]
    return Counter(out)


def searched(spark, docs, items, keep=50):
    return Counter(map(tuple, lexical.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), keep).collect()))


LETTERS = "aAbZ09 \t\n-_[{~\x7f\x00\x80éİKß漢😀"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(LETTERS, max_size=30)), max_size=6), st.lists(st.text(LETTERS, max_size=6), max_size=6))
def test_scan_counts_every_term(texts, queries):
    terms = sorted({t.encode() for q in queries for t in terms_of(q)})
    lengths, text, term, tf = lexical.scan(texts, lexical.automaton_of(terms) if terms else None, len(terms))
    want = [Counter(terms_of(t)) for t in texts]
    assert lengths.tolist() == [c.total() for c in want]
    got = {(a, terms[b].decode()): c for a, b, c in zip(text.tolist(), term.tolist(), tf.tolist(), strict=True)}
    assert got == {(k, t): n for k, c in enumerate(want) for t, n in c.items() if t.encode() in terms}


def test_terms_inside_others_are_not_found():
    terms = [b"a", b"ab", b"b"]
    _, _, term, tf = lexical.scan(["ab a b ab-a,ab"], lexical.automaton_of(terms), 3)
    assert dict(zip(term.tolist(), tf.tolist(), strict=True)) == {0: 2, 1: 3, 2: 1}


def test_ranking(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    want = brute(docs, items)
    assert len(want) > 1_000
    assert searched(spark, docs, items) == want
    assert searched(spark, docs, items[:5], keep=3) == brute(docs, items[:5], 3)


def test_odd_rows(spark):
    """Null and empty texts, null and repeated ids, ties, a long text, and items that repeat or have no terms."""
    docs = [(1, "apple pear"), (2, "apple pear"), (None, "apple pear"), (3, "Apple APPLE plum"), (3, "pear fig"), (4, None), (5, ""), (6, " .,! "), (7, "kiwi " * 50_000 + "apple"), (None, None), (8, "melon grape"), (9, "melon")]
    items = [(1, "apple"), (1, "fig apple"), (2, "--"), (3, None), (None, "PEAR"), (4, "nowhere"), (5, "melon Melon melon"), (5, "melon Melon melon")]
    for keep in (1, 2, 50):
        assert searched(spark, docs, items, keep) == brute(docs, items, keep)


def test_without_rows(spark):
    assert searched(spark, [], [(1, "a")]) == Counter()
    assert searched(spark, [(1, "a")], []) == Counter()
    assert searched(spark, [(1, None), (2, "...")], [(1, "a")]) == Counter()


def test_blocks_of_items(spark, monkeypatch):
    """Items that do not fit into one automaton are searched block by block, with the same result."""
    docs = [(k, f"word{k % 7} word{k % 5} common x{k}") for k in range(60)]
    items = [(k, f"word{k} common x{k}") for k in range(9)] + [(99, " ".join(f"x{k}" for k in range(40)))]
    want = brute(docs, items)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 300)
    assert searched(spark, docs, items) == want


def test_best_is_pruned_in_between(spark):
    docs = [(k, "a " * (k % 9 + 1) + f"b{k % 4}") for k in range(3_000)]
    assert searched(spark, docs, [(0, "a b1"), (1, "b2 b3")], keep=2) == brute(docs, [(0, "a b1"), (1, "b2 b3")], 2)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 6, 7), (2, "a", 5, 6, 7)], DOCS + ", item_id long, rank long, score long")
    items = spark.createDataFrame([(1, "b", "x", 3)], ITEMS + ", terms string, doc_id long")
    assert Counter(map(tuple, lexical.search(docs, items).collect())) == brute([(1, "a b"), (2, "a")], [(1, "b")])


@pytest.mark.parametrize(("docs", "holding"), [(0, 0), (1, 1), (10, 3), (10**9, 1)])
def test_weight(docs, holding):
    assert lexical.weight(docs, holding) == math.floor(1000 * math.log((2 * docs + 2) / (2 * holding + 1)))
