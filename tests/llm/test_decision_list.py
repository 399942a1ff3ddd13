import random
import re
from collections import Counter

import pytest

from reelmetrics.llm import decision_list, registry


def plain(text):
    """Base statistics by plain code."""
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [s for s in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


RNG = random.Random(4)
TEXTS = [
    None,
    "",
    " \t\n\r\x0b\x0c ",
    "one",
    "a b c d e a b c d e",
    "a a a a a a a",
    "x y\x1cz w v",
    "line one\nline one\n \nline  one\r\nline one\n",
    "## **bold** <b>|</b> 5% & $3 \U0001f642\U0001f642",
    " ".join(RNG.choice("ab") for _ in range(300)),
    " ".join(RNG.choice("abcdef") for _ in range(60)),
    ("p q r s t u v w x y " * 3).strip(),
    "word " * 30_000,
    " ".join(str(i) for i in range(40_000)),
]


def test_statistics_against_plain_code(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id int, text string, n_words int")
    got = {r.doc_id: tuple(r[c] for c in decision_list.BASE) for r in decision_list.describe(docs).collect()}
    assert got == {i: plain(t) for i, t in enumerate(TEXTS)}


def test_covering_finds_planted_rules():
    rng = random.Random(2)
    cells = {}
    for _ in range(3_000):
        cell = tuple(rng.randrange(4) for _ in decision_list.FEATURES)
        bad = cell[2] >= 2 or (cell[3] == 3 and cell[5] < 1)
        n = list(cells.get(cell, (0, 0, 0, 0)))
        n[2 * (rng.random() < 0.3) + (not bad)] += 1
        cells[cell] = tuple(n)
    rules = decision_list.cover(cells, [[10.0, 20.0, 30.0]] * len(decision_list.FEATURES))
    assert str(rules[0]) == "symbols_a_word >= 20"
    assert {str(c) for c in rules[1].conditions} == {"dup_line_share >= 30", "capital_share < 10"}
    assert all(r.good == 0 for r in rules[:2]) and sum(r.bad for r in rules) == sum(n[0] + n[2] for n in cells.values())


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, " ".join(f"w{RNG.randrange(10**5):05d}{'abc' if i % 4 else '***'}" for _ in range(30)), 1) for i in range(200)]
    labels = [(i, int(i % 4 != 0), 1) for i in range(160)] + [(None, 0, 1), (1, None, 1), (2, 5, 1), (4, 0, 1), (10**6, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, rule int"), spark.createDataFrame(labels, "doc_id long, quality int, text int")


def test_learned_verdict(spark, tables):
    docs, labels = tables
    stats = decision_list.describe(docs)
    rules = decision_list.learn(stats, labels)
    got = {r.doc_id: r for r in decision_list.judge(stats, rules).collect()}
    assert {k for k, r in got.items() if r.kept} == {i for i in range(200) if i % 4}
    assert all(r.rule == 1 and not r.base_failed for r in got.values() if not r.kept)


def test_odd_rows_and_missing_labels(spark, tables):
    docs = spark.createDataFrame([(None, "a b c d e f g h i j k", 1), (5, None, 1), (5, None, 1), (6, "a b c d e " * 3, 1)], "doc_id long, text string, kept int")
    stats = decision_list.describe(docs)
    assert decision_list.learn(stats, tables[1].where("false")) == []
    assert decision_list.learn(stats, tables[1].where("quality = 1")) == []
    got = sorted((r.doc_id or 0, r.base_failed, r.kept) for r in decision_list.judge(stats, []).collect())
    assert got == [(0, False, True), (5, True, False), (5, True, False), (6, True, False)]
    assert decision_list.judge(decision_list.describe(docs.where("false")), []).count() == 0


def test_no_python_in_the_plan(spark, small):
    plan = registry.QUERIES["op7_quality"](spark, small)._jdf.queryExecution().executedPlan().toString()
    stats = spark.read.parquet(f"{small}/documents.parquet").select(decision_list.statistics(registry.F.col("text")))
    plan += stats._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
