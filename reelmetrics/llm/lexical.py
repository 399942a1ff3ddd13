"""Ranked lexical search without an index of the documents: an Aho-Corasick automaton of all items' terms reads the texts.

Texts become bytes in which every separator is a blank. Each term is a pattern with a blank on both sides, so it is found
only between boundaries, and neighbouring terms share the blank between them. One run of the automaton over a text gives the
frequency of every term of every item; a table leads from terms to the items that hold them.

The documents are read twice. The first reading adds up, within each task, how many documents hold a term and how long they
are; the second scores every document and keeps, for each task and item, only what may still be among the best. No posting
list, and no row for each document, is ever shuffled or stored. Items are taken in blocks of bounded size, each with an automaton of its own.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What a term is made of: ASCII digits and letters, and everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PLAIN = bytes((b + 32 if 65 <= b <= 90 else b) if b > 127 or chr(b).isalnum() else 32 for b in range(256))
#: Most bytes of item terms in a block (beyond that, an item has its own block), bytes of text read at once, and scores held at once.
BLOCK_BYTES, SLICE_BYTES, SLICE_SCORES = 16 << 20, 2 << 20, 1 << 22
#: Parts that an item's candidates are dealt into before the last ranking.
PARTS = 64

_COUNT_DDL, _COUNT = "term int, n long", pa.schema([("term", pa.int32()), ("n", pa.int64())])
_TOP_DDL = "item_id long, doc_id long, score long"
#: Numbers under which the documents with terms, and all their terms, are counted.
_DOCS, _LENGTH = -1, -2


@dataclass(frozen=True)
class Items:
    """A block of items: their ids, all their terms in order, and which items hold each term (`items[starts[t]:starts[t + 1]]`)."""

    ids: list[int | None]
    terms: list[bytes]
    starts: np.ndarray
    items: np.ndarray
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


def items_of(rows: list[tuple[int | None, list[str]]]) -> Items:
    holders: dict[bytes, list[int]] = {}
    for k, (_, terms) in enumerate(rows):
        for term in set(terms):
            holders.setdefault(term.encode(), []).append(k)
    terms = sorted(holders)
    starts = np.cumsum([0, *(len(holders[t]) for t in terms)])
    return Items([i for i, _ in rows], terms, starts, np.array([k for t in terms for k in holders[t]], np.int64))


def automaton_of(terms: list[bytes]) -> ahocorasick.Automaton:
    """The automaton of the terms with their guards; a byte is a letter of it."""
    found = ahocorasick.Automaton()
    for k, term in enumerate(terms):
        found.add_word(f" {term.decode('latin-1')} ", k)
    found.make_automaton()
    return found


_built: dict[str, ahocorasick.Automaton] = {}


def _automaton(items: Items) -> ahocorasick.Automaton:
    """A worker builds the automaton of a block once."""
    if items.name not in _built:
        _built.clear()
        _built[items.name] = automaton_of(items.terms)
    return _built[items.name]


def scan(texts: list[str | None], automaton: ahocorasick.Automaton, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' lengths in terms, and by text and term of the automaton how often it occurs: text (place), term, tf."""
    parts = [b" " + t.encode().translate(_PLAIN) if t else b" " for t in texts]
    joined = b"".join(parts) + b" "
    ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
    blank = np.frombuffer(joined, np.uint8) == 32
    begins = np.cumsum(np.r_[0, ~blank[1:] & blank[:-1]])  # terms begun up to a place
    lengths = np.diff(np.r_[0, begins[ends - 1]])
    if not terms:
        return lengths, *[np.empty(0, np.int64)] * 3
    hits = np.fromiter(chain.from_iterable(automaton.iter(joined.decode("latin-1"))), np.int64).reshape(-1, 2)
    # A hit ends at the blank after the term, which may be the first byte of the next text.
    key, tf = np.unique(np.searchsorted(ends, hits[:, 0] - 1, "right") * terms + hits[:, 1], return_counts=True)
    return lengths, key // terms, key % terms, tf.astype(np.int64)


def _slices(batch: pa.RecordBatch, column: int, rows: int) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of at most so many texts and, beyond one, SLICE_BYTES; with the place of the first."""
    for at in range(0, batch.num_rows, min(rows, 1_024)):
        texts, begin, held = batch.column(column).slice(at, min(rows, 1_024)).to_pylist(), 0, 0
        for k, text in enumerate(texts):
            held += len(text or "") + 1
            if held > SLICE_BYTES or k == len(texts) - 1:
                yield at + begin, texts[begin : k + 1]
                begin, held = k + 1, 0


def _count_batches(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        automaton, number = _automaton(items), len(items.terms)
        holding, docs, length = np.zeros(number, np.int64), 0, 0
        for batch in batches:
            for _, texts in _slices(batch, 0, 1_024):
                lengths, _, term, _ = scan(texts, automaton, number)
                holding += np.bincount(term, minlength=number)
                docs, length = docs + int((lengths > 0).sum()), length + int(lengths.sum())
        some = np.flatnonzero(holding)
        yield pa.record_batch([pa.array(np.r_[_DOCS, _LENGTH, some], pa.int32()), pa.array(np.r_[docs, length, holding[some]], pa.int64())], schema=_COUNT)

    return run


def weight(docs: int, holding: int) -> int:
    """The weight of a term that `holding` of `docs` documents hold."""
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * holding + 1)))


class _Best:
    """For each item of a block the `keep` best documents so far; equal scores by ascending id, a null id last."""

    def __init__(self, items: int, keep: int) -> None:
        self.items, self.keep = items, keep
        self.least = np.ones(items, np.int64)
        self.held = [tuple(np.empty(0, np.int64) for _ in range(4))]
        self.number = 0

    def offer(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        """`scores` has a row for each document and a column for each item."""
        doc, item = np.nonzero(scores >= self.least)
        self.held.append((item, scores[doc, item], missing[doc], ids[doc]))
        self.number += len(doc)
        if self.number > 4 * self.items * self.keep:
            self.best()

    def best(self) -> tuple[np.ndarray, ...]:
        item, score, missing, ids = (np.concatenate(c) for c in zip(*self.held, strict=True))
        order = np.lexsort((ids, missing, -score, item))
        item, score, missing, ids = item[order], score[order], missing[order], ids[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        full = rank == self.keep - 1
        self.least[item[full]] = score[full]
        keep = rank < self.keep
        self.held = [(item[keep], score[keep], missing[keep], ids[keep])]
        self.number = int(keep.sum())
        return self.held[0]


def scores_of(lengths: np.ndarray, text: np.ndarray, term: np.ndarray, tf: np.ndarray, items: Items, weights: np.ndarray, docs: int, length: int) -> np.ndarray:
    """Scores of texts (rows) for all items (columns)."""
    scores = np.zeros((len(lengths), len(items.ids)), np.int64)
    if not len(text):
        return scores
    m = np.array([100 - 50 + 50 * n * docs // length for n in lengths.tolist()], np.int64)
    gain = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[text]))
    holders = np.diff(items.starts)[term]
    of = np.repeat(np.arange(len(term)), holders)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(holders) - holders, holders)
    np.add.at(scores, (text[of], items.items[items.starts[term][of] + nth]), gain[of])
    return scores


def _score_batches(shared: Broadcast, weights: np.ndarray, docs: int, length: int, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        automaton, best = _automaton(items), _Best(len(items.ids), keep)
        for batch in batches:
            missing = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            for at, texts in _slices(batch, 1, max(1, SLICE_SCORES // len(items.ids))):
                found = scan(texts, automaton, len(items.terms))
                best.offer(scores_of(*found, items, weights, docs, length), ids[at : at + len(texts)], missing[at : at + len(texts)])
        item, score, missing, ids = best.best()
        names = pa.array(items.ids, pa.int64())
        yield pa.record_batch([names.take(pa.array(item)), pa.array(ids, pa.int64(), mask=missing.astype(bool)), pa.array(score)], ["item_id", "doc_id", "score"])

    return run


def _best_rows(found: DataFrame, keep: int) -> DataFrame:
    """The `keep` best rows of each item with their rank; an item's rows are cut down in parts before they come together."""
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = F.pmod(F.xxhash64("doc_id", "score"), F.lit(PARTS))
    for keys in (["item_id", part], ["item_id"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).where(F.col("rank") <= keep)
    return found


def _blocks(items: DataFrame) -> Iterator[list[tuple[int | None, list[str]]]]:
    """The items with their terms, in blocks dealt by hash so that each is within BLOCK_BYTES or one item."""
    spark = items.sparkSession
    sizes = items.select("item_id", F.expr("aggregate(terms, 0L, (n, t) -> n + octet_length(t) + 3)").alias("size"))
    number = 1 + (sizes.agg(F.sum("size")).first()[0] or 0) // BLOCK_BYTES
    while True:
        block = F.pmod(F.xxhash64("item_id"), F.lit(number))
        most = sizes.groupBy(block.alias("block")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).where((F.col("size") > BLOCK_BYTES) & (F.col("n") > 1))
        if number == 1 or most.isEmpty():
            break
        number *= 2
    for k in range(number):
        spark.sparkContext.setJobDescription(f"items, block {k + 1} of {number}")
        if rows := [tuple(r) for r in items.where(block == k).orderBy("item_id").collect()]:
            yield rows
    spark.sparkContext.setJobDescription(None)


def search(docs: DataFrame, items: DataFrame, keep: int = 50, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The `keep` documents with the highest scores for each item: item_id, rank (from 1), doc_id, score.

    Terms are the maximal runs of ASCII digits, ASCII letters (A-Z lower-cased) and characters beyond ASCII. With N documents
    that have terms, L terms in all, n in a document, and df documents holding a term, the term's weight is floor(1000 ln((2 N + 2) /
    (2 df + 1))); the document's m is 50 + 50 n N div L, and it scores weight (10^9 tf div (1000 tf + 20 m)) for each different
    term of the item. Only scores above 0 are ranked, equal ones by ascending doc_id.

    A null or empty text has no terms. Rows of `docs` count one by one, also when ids repeat or are null (ranked after equal
    scores with ids). Rows of `items` with one id, null included, are one item with the terms of all; an item without terms has no
    result. Other columns are ignored. If either table is empty, so is the result.
    """
    terms = F.regexp_extract_all(F.translate(F.col(item_text), UPPER, LOWER), F.lit(TERM), F.lit(0))
    held = items.select(F.col(item_key).cast("long").alias("item_id"), F.coalesce(terms, F.array().cast("array<string>")).alias("terms"))
    held = held.groupBy("item_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms")).where(F.size("terms") > 0)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    spark = docs.sparkSession
    ranked = None
    for block in _blocks(held):
        own = items_of(block)
        shared = spark.sparkContext.broadcast(own)  # at most BLOCK_BYTES of terms, or one item's
        counted = rows.select("text").mapInArrow(_count_batches(shared), _COUNT_DDL)
        counts = {r.term: r.n for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # one row a term
        number, length = counts.get(_DOCS, 0), counts.get(_LENGTH, 0)
        weights = np.array([weight(number, counts.get(t, 0)) for t in range(len(own.terms))], np.int64)
        found = _best_rows(rows.mapInArrow(_score_batches(shared, weights, number, length, keep), _TOP_DDL), keep)
        ranked = found if ranked is None else ranked.unionByName(found)
    if ranked is None:
        ranked = spark.createDataFrame([], f"{_TOP_DDL}, rank int")
    return ranked.select("item_id", "rank", "doc_id", "score")


def check_sql(keep: int = 50) -> str:
    """DuckDB SQL for `search` of all documents for the benchmark's items."""
    terms = lambda: f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms()} AS ts FROM documents),
    sizes AS (SELECT r, doc_id, len(ts) AS n FROM d WHERE len(ts) > 0),
    whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM sizes),
    t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY r, term),
    i AS (SELECT DISTINCT item_id, unnest({terms()}) AS term FROM benchmark),
    w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, whole GROUP BY term),
    s AS (
        SELECT item_id, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // length)))) AS BIGINT) AS score
        FROM i JOIN t USING (term) JOIN w USING (term) JOIN sizes USING (r), whole GROUP BY item_id, doc_id, r)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
    FROM s WHERE score > 0 QUALIFY rank <= {keep}"""
