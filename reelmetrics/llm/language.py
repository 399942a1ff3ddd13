"""Languages of a document, as a mixture inferred by expectation-maximisation.

Each language has a letter model: the chance of a letter, or of the end of the word, after the two before it. A word's
likelihood under a language is the product of these. A document is a mixture of languages that each of its words is
drawn from; expectation-maximisation finds the proportions. The language set is the one with the best likelihood after a
penalty for every further language, so that a few shared or odd words do not add a language.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelmetrics.llm.common import kept

UNDETERMINED = "und"
_SIGN = -(1 << 63)
#: Rows and characters worked on together, and rounds of expectation-maximisation.
SLICE, CHARS, ROUNDS = 128, 1 << 20, 12
#: Weights of the three-, two- and one-letter estimates; the rest is even over all letters.
TRI, BI, UNI = 0.75, 0.18, 0.06
#: Letter classes: 0 is the edge of a word, 1 any letter that is not listed.
CLASSES = 64

OUTPUT = "lang_pred string, score double, languages array<struct<lang:string,share:double>>, fits boolean"
_KINDS = {"lang_pred": pa.string(), "score": pa.float64(), "languages": pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])), "fits": pa.bool_()}


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    letters: str  # those with a class of their own
    language: np.ndarray  # for each count: the language,
    step: np.ndarray  # (class, class, class)
    n: np.ndarray  # and how often the third follows the first two


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _classes(letters: str) -> np.ndarray:
    found = _letters().astype(np.uint8)
    found[[ord(c) for c in letters]] = np.arange(2, 2 + len(letters))
    return found


def _coded(texts: list[str], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all texts, each with an edge before and after, and where each text begins."""
    parts = [np.frombuffer(t.lower().encode("utf-32-le"), np.uint32) for t in texts]
    sizes = np.array([len(p) + 3 for p in parts])
    starts = np.cumsum(sizes) - sizes
    codes = np.zeros(int(sizes.sum()), np.uint8)
    for at, part in zip(starts, parts, strict=True):
        codes[at + 2 : at + 2 + len(part)] = classes[part]
    return codes, starts


def _steps(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of letters and of the edges that end words; (class, class, class) there; whether a word begins there."""
    letter = codes > 0
    here = np.flatnonzero(letter[2:] | letter[1:-1]) + 2
    before, last = codes[here - 2].astype(np.int64), codes[here - 1].astype(np.int64)
    before = np.where(last == 0, 0, before)
    return here, (before * CLASSES + last) * CLASSES + codes[here], last == 0


def _count_batches(languages: list[str], letters: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, number = _classes(letters), {name: i for i, name in enumerate(languages)}
        counts = np.zeros((len(languages), CLASSES**3), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                names, texts = (batch.column(i).slice(at, SLICE).to_pylist() for i in (0, 1))
                for name, text in zip(names, texts, strict=True):
                    counts[number[name]] += np.bincount(_steps(_coded([text], classes)[0])[1], minlength=CLASSES**3)
        where, step = np.nonzero(counts)
        yield pa.record_batch([pa.array(where.astype(np.int32)), pa.array(step.astype(np.int32)), pa.array(counts[where, step])], ["language", "step", "n"])

    return run


def learn(rows: DataFrame, sample: int = 1_000, most: int = 64) -> Model:
    """Letter models from `rows` (doc_id, text, lang), of the `sample` documents of each language with the least hash.

    At most the `most` languages with the most documents are learned. Rows without a language or text teach nothing. The documents
    of a language are counted by how many bits their hashes have, at most 65 counts; only those up to the number of bits at which `sample` are
    reached are ranked, about `sample` to twice as many however many there are (and all rows of a doc_id that repeats).
    """
    rows = rows.where("lang is not null and text is not null").select("doc_id", "text", "lang", F.xxhash64("doc_id").alias("hash"))
    languages = sorted(r.lang for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect())
    if not languages:
        return Model((), "", *(np.zeros(0, np.int64),) * 3)
    # Above the least possible value, in bits, which keeps the order of the hashes.
    sized = rows.where(F.col("lang").isin(languages)).select("lang", "hash", "doc_id", F.length(F.ltrim(F.bin(F.col("hash").bitwiseXOR(F.lit(_SIGN))), F.lit("0"))).alias("bits"))
    before = Window.partitionBy("lang").orderBy("bits").rowsBetween(Window.unboundedPreceding, -1)
    few = sized.groupBy("lang", "bits").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).where(F.col("before") < sample)
    least = few.groupBy("lang").agg(F.max("bits").alias("most"))  # one row per language
    near = sized.join(F.broadcast(least), "lang").where("bits <= most")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "doc_id"))
    chosen = near.select("lang", "hash", "doc_id").withColumn("rank", rank).where(F.col("rank") <= sample)
    edges = chosen.groupBy("lang").agg(F.max(F.struct("hash", "doc_id")).alias("edge"))  # one row per language
    sampled = kept(rows.join(F.broadcast(edges), "lang").where(F.struct("hash", "doc_id") <= F.col("edge")).select("lang", "text"))
    singles = sampled.select(F.explode(F.split(F.lower("text"), "")).alias("letter")).where(F.col("letter").rlike(r"^\p{L}$"))
    common = [r.letter for r in singles.groupBy("letter").count().orderBy(F.desc("count"), "letter").limit(CLASSES - 2).collect()]
    letters = "".join(c for c in common if len(c) == 1)
    found = sampled.mapInArrow(_count_batches(languages, letters), "language int, step int, n long").groupBy("language", "step").agg(F.sum("n").alias("n"))
    counts = np.array(found.collect(), np.int64).reshape(-1, 3)  # from a sample of bounded size
    return Model(tuple(languages), letters, *counts.T)


def log_chances(model: Model) -> np.ndarray:
    """Per (class, class, class) and language, the logarithm of the chance of the last class after the first two."""
    out = np.empty((CLASSES**3, len(model.languages)), np.float32)
    for i in range(len(model.languages)):
        own = model.language == i
        tri = np.bincount(model.step[own], model.n[own], CLASSES**3).reshape(CLASSES, CLASSES, CLASSES)
        bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
        share = lambda n: n / np.maximum(n.sum(axis=-1, keepdims=True), 1)
        chance = TRI * share(tri) + BI * share(bi)[None] + UNI * share(uni)[None, None] + (1 - TRI - BI - UNI) / CLASSES
        out[:, i] = np.log(chance).reshape(-1)
    return out


def _mixture(chance: np.ndarray, doc: np.ndarray, starts: np.ndarray, allowed: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the allowed languages in each document, and the log-likelihood that they reach.

    `chance` is word x language, scaled so that each word's largest is 1; `starts` is where each document's words begin.
    """
    share = allowed / allowed.sum(axis=1, keepdims=True)
    words = np.diff(np.r_[starts, len(doc)])[:, None]
    for _ in range(rounds):
        part = chance * share[doc]
        part /= part.sum(axis=1, keepdims=True) + np.float32(1e-30)
        share = np.add.reduceat(part, starts) / words
    reached = np.log((chance * share[doc]).sum(axis=1) + np.float32(1e-30))
    return share, np.add.reduceat(reached.astype(np.float64), starts)


def _sets(chance: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For documents with `sizes` words each: proportions of all languages, and of the chosen set.

    Candidates are the first, the first two, ... languages by proportion. A set of k pays k ln(words) / 2. As the mixture
    of all languages reaches the highest likelihood of any set, a document where that is no more than one penalty
    above the first language alone needs no further search.
    """
    starts, doc = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
    count = chance.shape[1]
    full, limit = _mixture(chance, doc, starts, np.ones((len(sizes), count), np.float32))
    order = np.argsort(-full, axis=1, kind="stable")
    place = np.argsort(order, axis=1, kind="stable")
    penalty = np.log(np.maximum(sizes, 2)) / 2
    chosen, best = np.zeros_like(full), np.full(len(sizes), -np.inf)
    open_ = np.arange(len(sizes))
    for k in range(1, count + 1):
        rows = np.isin(doc, open_)
        renumbered = np.repeat(np.arange(len(open_)), sizes[open_])
        ends = np.cumsum(sizes[open_])
        share, reached = _mixture(chance[rows], renumbered, ends - sizes[open_], (place[open_] < k).astype(np.float32), 1 if k == 1 else ROUNDS)
        value = reached - k * penalty[open_]
        better = value > best[open_]
        chosen[open_[better]], best[open_[better]] = share[better], value[better]
        open_ = open_[limit[open_] - (k + 1) * penalty[open_] > best[open_]]
        if not len(open_):
            break
    return full, chosen


def mixtures(texts: list[str | None], model: Model, chances: np.ndarray, classes: np.ndarray) -> list[tuple[str, float, list[dict], bool]]:
    """(lang_pred, score, languages, fits) of each text."""
    out: list[tuple[str, float, list[dict], bool]] = [(UNDETERMINED, 0.0, [], False)] * len(texts)
    if not model.languages:
        return out
    codes, begins = _coded([t or "" for t in texts], classes)
    here, step, first = _steps(codes)
    if not len(here):
        return out
    heads = np.flatnonzero(first)
    logs = np.add.reduceat(chances[step], heads)  # per word
    owner = np.searchsorted(begins, here[heads], "right") - 1
    with_words, sizes = np.unique(owner, return_counts=True)
    top = logs.max(axis=1)
    full, chosen = _sets(np.exp(logs - top[:, None]), sizes)
    letters = np.diff(np.r_[heads, len(here)])
    starts = np.cumsum(sizes) - sizes
    even = -math.log(CLASSES) * np.add.reduceat(letters, starts)
    fits = np.add.reduceat(top.astype(np.float64), starts) > even
    for row, i in enumerate(with_words):
        order = np.argsort(-chosen[row], kind="stable")
        found = [{"lang": model.languages[k], "share": float(chosen[row, k])} for k in order if chosen[row, k] > 0]
        out[i] = (found[0]["lang"], min(1.0, float(full[row, order[0]])), found, bool(fits[row]))
    return out


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts that are short enough together; a text longer than that is a run of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text or "") > CHARS:
            yield start, i
            start, size = i, 0
        size += len(text or "")
    if start < len(texts):
        yield start, len(texts)


def mixture_of(text: Column, model: Model, spark: SparkSession) -> Column:
    """A struct of lang_pred, score, languages and fits for a column of texts.

    lang_pred is the chosen set's language with the largest share; `languages` has the set with shares that add up to 1, the
    largest first. score is the share of lang_pred in the mixture of all languages, from 0 to 1. fits tells whether the
    models explain the text better than letters drawn evenly. A text that is null or has no letters is `und` with score 0,
    no languages and fits false, and so is every text if no language was learned. Whole texts are used.
    """
    shared = spark.sparkContext.broadcast(model)  # at most CLASSES^3 counts per language

    @F.arrow_udf(OUTPUT)
    def infer(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shared.value
        chances, classes = log_chances(known), _classes(known.letters)
        for column in columns:
            found = []
            for at in range(0, len(column), SLICE):
                texts = column.slice(at, SLICE).to_pylist()
                found += [r for a, b in _slices(texts) for r in mixtures(texts[a:b], known, chances, classes)]
            parts = zip(*found, strict=True) if found else [()] * 4
            yield pa.StructArray.from_arrays([pa.array(p, t) for p, t in zip(parts, _KINDS.values(), strict=True)], list(_KINDS))

    return infer(text)


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score, languages and fits, as `mixture_of` has them."""
    return docs.select(F.col(key).alias("doc_id"), mixture_of(docs[text], model, docs.sparkSession).alias("found")).select("doc_id", "found.*")
