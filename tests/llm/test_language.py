import math
import zlib
from collections import Counter

import numpy as np
import pytest

from reelmetrics.llm import language, registry

EN = "the cat sat on the mat and then the other thing was there with that"
DE = "der hund und die katze sind nicht auf dem dach sondern unter einer brücke"


def reference_mixture(chances, rounds):
    """Expectation-maximisation over one document's words, word by word."""
    count = len(chances[0])
    share = [1 / count] * count
    for _ in range(rounds):
        added = [0.0] * count
        for word in chances:
            total = sum(s * p for s, p in zip(share, word, strict=True))
            for k, p in enumerate(word):
                added[k] += share[k] * p / total
        share = [a / len(chances) for a in added]
    return share, sum(np.log(sum(s * p for s, p in zip(share, word, strict=True))) for word in chances)


@pytest.mark.parametrize("seed", range(4))
def test_mixture_and_sets_against_plain_code(seed):
    rng = np.random.default_rng(seed)
    sizes = np.array([1, 7, 30, 3])
    chance = rng.random((sizes.sum(), 3)) ** 4
    chance /= chance.max(axis=1, keepdims=True)
    full, chosen = language._sets(chance, sizes)
    for d, (at, n) in enumerate(zip(np.cumsum(sizes) - sizes, sizes, strict=True)):
        words = chance[at : at + n].tolist()
        share, _ = reference_mixture(words, language.ROUNDS)
        assert np.allclose(full[d], share, atol=1e-5)
        order = np.argsort(-full[d], kind="stable")
        value = {}
        for k in range(1, 4):
            _, reached = reference_mixture([[w[i] for i in order[:k]] for w in words], 1 if k == 1 else language.ROUNDS)
            value[k] = reached - k * np.log(max(n, 2)) / 2
        assert (chosen[d] > 0).sum() == max(value, key=value.get)


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, " ".join(np.random.default_rng(i).permutation((EN if i % 2 else DE).split())), "en" if i % 2 else "de") for i in range(40)]
    rows += [(100, None, "en"), (101, "loose text", None)]
    return language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_odd_texts(spark, model):
    texts = {1: EN, 2: DE, 3: None, 4: "", 5: "12 !! 3", 6: f"{EN}. {DE}.", 7: EN.upper() + "!!", 8: "der " * 100_000, 9: "汉字", None: DE}
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in texts.items()] + [(2, DE, "x", 1)], "doc_id long, text string, score string, lang_pred int")
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert language.identify(docs, model).count() == len(texts) + 1
    assert {k: r.lang_pred for k, r in got.items()} == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und", 6: got[6].lang_pred, 7: "en", 8: "de", 9: got[9].lang_pred, None: "de"}
    assert {x.lang for x in got[6].languages} == {"en", "de"} and sum(x.share for x in got[6].languages) == pytest.approx(1)
    assert got[1].fits and got[8].fits and not got[3].fits and not got[9].fits
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.identify(docs.where("false"), model).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    empty = language.learn(docs)
    assert [tuple(r) for r in language.identify(docs, empty).collect()] == [(1, "und", 0.0, [], False)]


def test_held_out_documents(spark, small):
    got = {r.doc_id: r for r in registry.QUERIES["op10_language"](spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang").collect()
    assert len(docs) == len(got)
    held = [r for r in docs if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert {r.doc_id for r in held} == {k for k, r in got.items() if r.held_out}
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.95 * len(held)


def plain_words(text, classes):
    """Words of a text as classes of letters, with two edges before and one after, and how often each occurs."""
    words = Counter("".join(c if c.isalpha() else " " for c in (text or "").lower()).split())
    return [([0, 0, *(classes.get(c, 1) for c in word), 0], n) for word, n in words.items()]


def plain_proportions(words, allowed, rounds):
    """Expectation-maximisation over different words with their numbers, and the log-likelihood it reaches."""
    share = {k: 1 / len(allowed) for k in allowed}
    for _ in range(rounds):
        added = dict.fromkeys(allowed, 0.0)
        for chance, n in words:
            total = sum(share[k] * chance[k] for k in allowed) + 1e-30
            for k in allowed:
                added[k] += n * share[k] * chance[k] / total
        share = {k: v / sum(n for _, n in words) for k, v in added.items()}
    return share, sum(n * math.log(sum(share[k] * chance[k] for k in allowed) + 1e-30) for chance, n in words)


def test_whole_query_against_plain_code(spark, small):
    """Learning, mixtures and chosen sets of all documents, from dictionaries of counts."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang").collect()
    learned = [r for r in docs if zlib.crc32(str(r.doc_id).encode()) % 5 and r.text is not None and r.lang is not None]
    languages = sorted({r.lang for r in learned})
    assert max(Counter(r.lang for r in learned).values()) <= 1_000  # so that all of them are taken
    letters = Counter(c for r in learned for c in r.text.lower() if c.isalpha())
    classes = {c: i for i, (c, _) in enumerate(sorted(letters.items(), key=lambda x: (-x[1], x[0]))[: language.CLASSES - 2], 2)}
    counts = {name: [Counter(), Counter(), Counter(), Counter(), Counter()] for name in languages}
    total = Counter()
    for r in learned:
        three, after_two, two, after_one, one = counts[r.lang]
        for word, n in plain_words(r.text, classes):
            for a, b, c in zip(word, word[1:], word[2:]):
                three[a, b, c] += n
                after_two[a, b] += n
                two[b, c] += n
                after_one[b] += n
                one[c] += n
                total[r.lang] += n

    def chance(name, a, b, c):
        three, after_two, two, after_one, one = counts[name]
        known = language.TRI * three[a, b, c] / max(1, after_two[a, b]) + language.BI * two[b, c] / max(1, after_one[b]) + language.UNI * one[c] / max(1, total[name])
        return known + (1 - language.TRI - language.BI - language.UNI) / language.CLASSES

    got = {r.doc_id: r for r in registry.QUERIES["op10_language"](spark, small).collect()}
    assert len(got) == len(docs)
    for r in docs:
        words, above, steps = [], 0.0, 0
        for word, n in plain_words(r.text, classes):
            logs = [sum(math.log(chance(name, *step)) for step in zip(word, word[1:], word[2:])) for name in languages]
            words.append(([math.exp(x - max(logs)) for x in logs], n))
            above, steps = above + n * max(logs), steps + n * (len(word) - 2)
        if not words:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score, got[r.doc_id].fits) == ("und", 0, False)
            continue
        full, _ = plain_proportions(words, range(len(languages)), language.ROUNDS)
        order = sorted(full, key=lambda k: (-full[k], k))
        penalty = math.log(max(2, sum(n for _, n in words))) / 2
        sets = [plain_proportions(words, order[:k], 1 if k == 1 else language.ROUNDS) for k in range(1, len(languages) + 1)]
        best = max(range(len(sets)), key=lambda k: (sets[k][1] - (k + 1) * penalty, -k))
        first = max(sets[best][0], key=lambda k: (sets[best][0][k], -k))
        assert got[r.doc_id].lang_pred == languages[first]
        assert {x.lang for x in got[r.doc_id].languages} == {languages[k] for k in order[: best + 1]}
        assert got[r.doc_id].score == pytest.approx(full[first], abs=1e-3)
        assert got[r.doc_id].fits == (above > -math.log(language.CLASSES) * steps)
