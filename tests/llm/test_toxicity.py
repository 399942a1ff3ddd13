import itertools
import zlib

import numpy as np
import pytest

from reelmetrics.llm import registry, toxicity
from reelmetrics.llm.toxicity import ABSTAIN, CLEAN, TOXIC


def test_features_count_different_words_of_a_stem():
    got = toxicity.features_of("Stupid, stupidly; STUPID! stu élan")
    assert {b"stupid", b"stupidly", b"1^stup", b"2^stup", b"2^stupid", b"1^stupidly"} <= got
    assert b"3^stup" not in got and b"2^stupidly" not in got
    assert toxicity.features_of("stupid élan", {b"stup"}) == {b"stupid", "élan".encode(), b"1^stup", b"1^stupi", b"1^stupid"}
    assert toxicity.features_of(None) == toxicity.features_of("!! ??") == set()


def made_votes(rows=4_000, seed=1):
    """Votes of six voters with known accuracies; the last repeats the fifth."""
    rng = np.random.default_rng(seed)
    truth = rng.random(rows) < 0.3
    votes = []
    for right in (0.9, 0.85, 0.85, 0.8, 0.6):
        said = np.where(rng.random(rows) < right, truth, ~truth)
        votes.append(np.where(rng.random(rows) < 0.8, np.where(said, TOXIC, CLEAN), ABSTAIN))
    votes.append(votes[4])
    return truth, np.column_stack(votes)


def test_label_model_finds_accuracies_and_the_repeated_voter():
    truth, votes = made_votes()
    said = votes[:, :4]
    start = np.clip((said == TOXIC).sum(axis=1) / np.maximum((said != ABSTAIN).sum(axis=1), 1), 0.05, 0.95)
    model, chance = toxicity.fit_labels(votes, start)
    assert model.accuracy == pytest.approx([0.9, 0.85, 0.85, 0.8, 0.6, 0.6], abs=0.12)
    assert model.correlation[0][:2] in ((4, 5), (5, 4))
    assert ((chance > 0.5) == truth).mean() > 0.9
    assert model.share == pytest.approx(0.3, abs=0.1)


def test_posterior_against_the_product_of_chances():
    _, votes = made_votes(500)
    model, _ = toxicity.fit_labels(votes, np.full(500, 0.4), rounds=2)
    for row in itertools.islice({tuple(v) for v in votes.tolist()}, 20):
        mass = [1 - model.share, model.share]
        for y in (0, 1):
            for j, parent in enumerate(model.parents):
                mass[y] *= model.chance[j][y, row[parent] if parent >= 0 else 0, row[j]]
        assert model.posterior(np.array([row]))[0] == pytest.approx(mass[1] / sum(mass))


def test_classifier_is_sparse_and_right():
    rng = np.random.default_rng(0)
    rows = [np.flatnonzero(rng.random(50) < 0.2) for _ in range(1_000)]
    target = np.array([0.95 if 7 in r or 9 in r else 0.03 for r in rows])
    weight, offset = toxicity.fit_linear(rows, target, 50, penalty=3e-3)
    score = np.array([offset + weight[r].sum() for r in rows])
    assert ((score > 0) == (target > 0.5)).all()
    assert set(np.argsort(-weight)[:2]) == {7, 9} and (weight == 0).sum() > 10


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, f"some words here number{i % 7} " + ("you vile creature" if i % 5 == 0 else "kind regards"), 1) for i in range(200)]
    labels = [(i, int(i % 5 == 0), 9) for i in range(150)] + [(None, 1, 9), (3, None, 9), (4, 7, 9), (9_999, 1, 9), (5, 1, 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, score int"), spark.createDataFrame(labels, "doc_id long, toxic int, text int")


def test_odd_rows(spark, tables):
    classifier = toxicity.learn(*tables)
    texts = {1: "a VILE one", 2: "a kind one", 3: None, 4: "", 5: "kind " * 100_000 + "vile", None: "vile creature!!!"}
    docs = spark.createDataFrame([(k, t, 1) for k, t in texts.items()] + [(2, "a kind one", 1)], "doc_id long, text string, score int")
    got = [(r.doc_id, r.s) for r in docs.select("doc_id", toxicity.score_of(docs.text, classifier, spark).alias("s")).collect()]
    assert len(got) == 7
    assert {k for k, s in got if s >= 0.5} == {1, 5, None}
    assert classifier.voters[-1] == "human label" and len(classifier.labels.accuracy) == len(classifier.voters)


def test_rows_learned_from_are_bounded(spark, tables, monkeypatch):
    """A labelled document that occurs a thousand times adds no more rows than the sample has."""
    docs, labels = tables
    many = docs.unionByName(docs.where("doc_id = 0").crossJoin(spark.range(1_000)).select(docs.columns))
    seen = []
    fit = toxicity.fit_labels
    monkeypatch.setattr(toxicity, "fit_labels", lambda votes, start: seen.append(len(votes)) or fit(votes, start))
    classifier = toxicity.learn(many, labels, sample=120)
    toxicity.learn(docs, labels, sample=120)
    assert seen[0] == 120 and seen[1] <= 120 and classifier.offset is not None


def test_no_or_one_kind_of_labels(spark, tables):
    docs, labels = tables
    none = toxicity.learn(docs, labels.where("false"))
    assert [r.s for r in docs.limit(3).select(toxicity.score_of(docs.text, none, spark).alias("s")).collect()] == [0.0] * 3
    assert toxicity.learn(docs, labels.where("toxic = 0")).score("vile creature") < 0.1
    assert toxicity.learn(docs.where("false"), labels).offset is None


def test_held_out_documents(spark, small):
    got = {r.doc_id: r for r in registry.QUERIES["op9_toxicity"](spark, small).collect()}
    assert len(got) == spark.read.parquet(f"{small}/documents.parquet").count()
    assert {k for k, r in got.items() if r.held_out} == {k for k in got if zlib.crc32(str(k).encode()) % 4 == 2}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    marked = [(r.toxic, got[r.doc_id].predicted) for r in spark.read.parquet(f"{small}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert sum(a == b for a, b in marked) >= 0.85 * len(marked)
