"""Toxicity by weak supervision.

Voters look at a text and vote toxic, clean or not at all: one for each word of a lexicon, a few for patterns, and the
human labels of the learning rows as one more. A generative model explains the votes by a hidden class: in a tree over the
voters each vote depends on the class and on one other vote, so that voters which repeat each other do not count twice.
Expectation-maximisation estimates it, giving each voter's accuracy, the strongest correlations, and for every learning row
the chance that it is toxic. A sparse linear classifier over words is trained on these chances and scores all texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmetrics.llm.common import kept

#: Rows worked on together.
SLICE = 256
#: A word or stem is kept in the lexicon if it is in so many toxic learning rows, and so much of its rows are toxic.
LEAST_ROWS, LEAST_SHARE = 5, 0.6
#: Rounds of expectation-maximisation and of the classifier, weight of its penalty, and what is added to every count.
EM_ROUNDS, FIT_ROUNDS, PENALTY, PRIOR = 8, 300, 5e-5, 0.5

_TO_SPACE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_SHOUT = re.compile(r"!{2,}")
_MASKED = re.compile(r"[A-Za-z][*#$%&@]{2,}")
PATTERNS = ("shouts", "masks words", "is in capitals", "has nothing of the lexicon")
ABSTAIN, CLEAN, TOXIC = 0, 1, 2
#: Bytes of the stems that words are also known by, and how many different words of a stem are told apart.
SHORTEST, STEMS, MANY = 4, range(4, 10), 3


def words_of(text: str | None) -> set[bytes]:
    """The different words of a text in lower case, without ASCII punctuation."""
    return set((text or "").lower().encode().translate(_TO_SPACE).split())


def features_of(text: str | None, starts: set[bytes] | None = None) -> set[bytes]:
    """Words of a text, and `n^stem` where at least n of its different words begin with the stem. `starts` limits the stems."""
    words = words_of(text)
    begin = words if starts is None else [w for w in words if w[:SHORTEST] in starts]
    stems = Counter([w[:n] for w in begin for n in STEMS if len(w) >= n])
    return words.union([b"%d^%b" % (k, stem) for stem, n in stems.items() for k in range(1, min(n, MANY) + 1)])


def starts_of(features: set[bytes]) -> set[bytes]:
    return {f[2 : 2 + SHORTEST] for f in features if f[1:2] == b"^"}


def pattern_votes(text: str | None, in_lexicon: bool) -> list[int]:
    """Votes of the voters in PATTERNS."""
    text = text or ""
    capitals = sum(map(str.isupper, text))
    return [
        TOXIC if _SHOUT.search(text) else ABSTAIN,
        TOXIC if _MASKED.search(text) else ABSTAIN,
        TOXIC if capitals >= 20 and 2 * capitals > sum(map(str.isalpha, text)) else ABSTAIN,
        ABSTAIN if in_lexicon else CLEAN,
    ]


@dataclass
class LabelModel:
    """Chances of each vote given the class and the vote of the voter's parent (-1: none): chance[j][class, parent's vote, vote]."""

    parents: list[int]
    chance: list[np.ndarray]
    share: float  # of toxic rows
    accuracy: list[float] = field(default_factory=list)  # of the votes that are cast
    correlation: list[tuple[int, int, float]] = field(default_factory=list)  # parent, voter, information in nats

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        logs = np.zeros((len(votes), 2)) + np.log([1 - self.share, self.share])
        for j, (parent, chance) in enumerate(zip(self.parents, self.chance, strict=True)):
            above = votes[:, parent] if parent >= 0 else np.zeros(len(votes), int)
            logs += np.log(chance[:, above, votes[:, j]]).T
        return 1 / (1 + np.exp(logs[:, 0] - logs[:, 1]))


def _tree(votes: np.ndarray, chance: np.ndarray) -> tuple[list[int], list[tuple[int, int, float]]]:
    """Parents of a spanning tree over the voters with the most mutual information given the class."""
    count = votes.shape[1]
    weight = np.stack([1 - chance, chance], axis=1)
    hot = np.eye(3)[votes]  # row, voter, vote
    joint = np.stack([np.einsum("n,nia,njb->ijab", weight[:, y], hot, hot, optimize=True) for y in (0, 1)]) + 1e-9
    joint /= joint.sum(axis=(0, 3, 4), keepdims=True)
    given = joint.sum(axis=(3, 4), keepdims=True)
    ratio = joint * given / (joint.sum(axis=4, keepdims=True) * joint.sum(axis=3, keepdims=True))
    information = (joint * np.log(ratio)).sum(axis=(0, 3, 4))
    parents, edges, inside = [-1] * count, [], {0}
    while len(inside) < count:
        gain, i, j = max((information[i, j], -i, -j) for i in inside for j in range(count) if j not in inside)
        parents[-j] = -i
        edges.append((-i, -j, float(gain)))
        inside.add(-j)
    return parents, sorted(edges, key=lambda e: -e[2])


def fit_labels(votes: np.ndarray, start: np.ndarray, rounds: int = EM_ROUNDS) -> tuple[LabelModel, np.ndarray]:
    """The label model of `votes` (row x voter), and each row's chance of being toxic. `start` is a first guess of the chances."""
    chance = start
    for _ in range(rounds):
        parents, edges = _tree(votes, chance)
        tables = []
        for j, parent in enumerate(parents):
            above = votes[:, parent] if parent >= 0 else np.zeros(len(votes), int)
            cells = above * 3 + votes[:, j]
            table = np.stack([np.bincount(cells, w, 9).reshape(3, 3) for w in (1 - chance, chance)]) + PRIOR
            tables.append(table / table.sum(axis=2, keepdims=True))
        model = LabelModel(parents, tables, float((chance.sum() + PRIOR) / (len(chance) + 2 * PRIOR)))
        chance = model.posterior(votes)
    toxic, clean = votes == TOXIC, votes == CLEAN
    right = (toxic * chance[:, None] + clean * (1 - chance)[:, None]).sum(axis=0)
    model.accuracy = list((right + PRIOR) / ((toxic | clean).sum(axis=0) + 2 * PRIOR))
    model.correlation = edges
    return model, chance


def fit_linear(rows: list[np.ndarray], target: np.ndarray, size: int, rounds: int = FIT_ROUNDS, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic classifier with a penalty on the weights' absolute sum, by accelerated proximal steps.

    `rows` has the places of each row's features; `target` is the chance of class 1.
    """
    lengths = np.array([len(r) for r in rows])
    flat = np.concatenate(rows) if len(rows) else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), lengths)
    weight, offset = np.zeros(size), float(np.log((target.sum() + PRIOR) / ((1 - target).sum() + PRIOR)))
    ahead, ahead_offset, speed = weight, offset, 1.0
    step = 4.0 / max(1.0, 1 + lengths.mean() if len(rows) else 1.0)
    for _ in range(rounds):
        error = (1 / (1 + np.exp(-(np.bincount(owner, ahead[flat], len(rows)) + ahead_offset))) - target) / len(rows)
        moved = ahead - step * np.bincount(flat, error[owner], size)
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        new_offset = ahead_offset - step * error.sum()
        faster = (1 + (1 + 4 * speed * speed) ** 0.5) / 2
        ahead, ahead_offset = new + (speed - 1) / faster * (new - weight), new_offset + (speed - 1) / faster * (new_offset - offset)
        weight, offset, speed = new, new_offset, faster
    return weight, offset


@dataclass
class Classifier:
    weights: dict[bytes, float]
    offset: float | None  # None: nothing was learned
    labels: LabelModel | None = None
    voters: tuple[str, ...] = ()

    @cached_property
    def starts(self) -> set[bytes]:
        return starts_of(set(self.weights))

    def score(self, text: str | None) -> float:
        if self.offset is None:
            return 0.0
        total = self.offset + sum(self.weights[f] for f in self.weights.keys() & features_of(text, self.starts))
        return float(1 / (1 + np.exp(-np.clip(total, -500, 500))))


def _count_batches(wanted: set[bytes] | None):
    """Rows with each feature, or with each wanted one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        starts = None if wanted is None else starts_of(wanted)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = features_of(text, starts)
                counts.update(found if wanted is None else found & wanted)
        yield pa.record_batch([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["feature", "n"])

    return run


def _counted(rows: DataFrame, wanted: set[bytes] | None = None) -> DataFrame:
    return rows.select("text").mapInArrow(_count_batches(wanted), "feature binary, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def _row_batches(lexicon: list[bytes], features: dict[bytes, int]):
    starts = starts_of({*lexicon, *features})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes, places = [], []
            for text in batch.column(0).to_pylist():
                words = features_of(text, starts)
                own = [TOXIC if w in words else ABSTAIN for w in lexicon]
                votes.append(bytes(own + pattern_votes(text, TOXIC in own)))
                places.append(np.array(sorted(features[w] for w in features.keys() & words), np.int32).tobytes())
            yield pa.record_batch([batch.column(1), pa.array(votes, pa.binary()), pa.array(places, pa.binary())], ["toxic", "votes", "places"])

    return run


def learn(docs: DataFrame, labels: DataFrame, sample: int = 20_000, terms: int = 40, features: int = 2_000, candidates: int = 50_000) -> Classifier:
    """A classifier learned from the texts of `docs` (doc_id, text) that `labels` (doc_id, toxic) marks.

    Of the labelled ids, the `sample` with the least hash take part. Of the `candidates` words and stems in most toxic rows,
    the `features` that stand out most are the classifier's vocabulary, and the first `terms` of these that are mostly in
    toxic rows the lexicon. Labels that are null or neither 0 nor 1 are left out; an id with several takes part with each.
    Where ids repeat in `docs`, the first `sample` rows by the same hash take part, so learning is bounded in rows too.
    """
    marked = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` ids, of which some may repeat
    rows = kept(found.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic", F.xxhash64("text")).limit(sample).select("text", "toxic"))
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean + toxic:
        return Classifier({}, None)
    # Only what several toxic rows have can tell them from clean ones.
    common = _counted(rows.where("toxic = 1")).where(f"n >= {LEAST_ROWS}").orderBy(F.desc("n"), "feature").limit(candidates)
    in_toxic = {bytes(r.feature): r.n for r in common.collect()}
    in_clean = {bytes(r.feature): r.n for r in _counted(rows.where("toxic = 0"), set(in_toxic)).collect()} if in_toxic else {}

    def apart(feature: bytes) -> float:
        """How far the toxic rows are above what they would be by chance."""
        n = in_toxic[feature] + in_clean.get(feature, 0)
        return (in_toxic[feature] - n * toxic / (clean + toxic)) / (n * toxic / (clean + toxic) + 1) ** 0.5

    # Of features that one word has in the same rows, as far as counts tell, the longest stem stands for all.
    one: dict[tuple, bytes] = {}
    for f in sorted(in_toxic, key=lambda f: (-len(f), f)):
        one.setdefault((in_toxic[f], in_clean.get(f, 0), (f[2:] if f[1:2] == b"^" else f)[:SHORTEST]), f)
    vocabulary = sorted(one.values(), key=lambda f: (-apart(f), f))[:features]
    lexicon = [f for f in vocabulary if in_toxic[f] >= LEAST_SHARE * (in_toxic[f] + in_clean.get(f, 0))][:terms]
    found = rows.mapInArrow(_row_batches(lexicon, {w: i for i, w in enumerate(vocabulary)}), "toxic int, votes binary, places binary").collect()
    human = np.array([r.toxic for r in found])
    votes = np.array([list(r.votes) for r in found], int).reshape(len(found), -1)
    votes = np.column_stack([votes, np.where(human == 1, TOXIC, CLEAN)])
    model, chance = fit_labels(votes, np.where(human == 1, 0.9, 0.1))
    weight, offset = fit_linear([np.frombuffer(r.places, np.int32) for r in found], chance, len(vocabulary))
    voters = (*(w.decode(errors="replace") for w in lexicon), *PATTERNS, "human label")
    return Classifier({w: float(v) for w, v in zip(vocabulary, weight, strict=True) if v}, float(offset), model, voters)


def score_of(text: Column, classifier: Classifier, spark: SparkSession) -> Column:
    """The score of a column of texts, from 0 to 1; a null text counts as empty. Whole texts are used. If nothing was learned it is 0."""
    shared = spark.sparkContext.broadcast(Classifier(classifier.weights, classifier.offset))  # at most as many weights as features

    @F.arrow_udf("double")
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([shared.value.score(t) for at in range(0, len(column), SLICE) for t in column.slice(at, SLICE).to_pylist()], pa.float64())

    return score(text)
