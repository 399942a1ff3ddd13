"""Quality rules as a learned decision list.

Labelled documents are described by a few numbers. Each number is cut at quantiles of the good and of the bad rows, and the
rows are counted by cell and label: these statistics, whose size depends on the cuts and not on the rows, are all that learning
sees. Sequential covering takes one rule after another: conditions are added while they gain information, cut back by how
the rule does on rows that it was not grown on, and what it covers is set aside. The list becomes one ordered conditional
expression, so that a rule says why a document is dropped.

Counting repeated five-word windows and everything else runs in column expressions over one row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmetrics.functions.once import let
from reelmetrics.llm.common import kept

SPACES = r"[\x20\x09-\x0D]+"
WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What rules are about, from the base statistics and the letters.
FEATURES = ["n_words", "mean_word", "symbols_a_word", "dup_line_share", "repeat_share", "capital_share", "marks_a_word"]
#: Shares of the good and of the bad rows at which a number is cut; of every ten rows so many grow rules, the rest prune them.
QUANTILES, GROW = [0.02, 0.1, 0.5, 0.9, 0.98], 7
#: A rule must cover so many bad rows, so much of what it covers must be bad, and it has so many conditions at most.
LEAST_BAD, LEAST_SHARE, MOST_CONDITIONS, MOST_RULES = 5, 0.8, 4, 12


def _repeated(hashes: Column) -> Column:
    """Words in windows that occur at least twice, from the words' hashes. Windows are told apart by 64-bit hashes of their words'."""
    last = F.size(hashes) - (WINDOW - 1)
    windows = F.transform(F.slice(hashes, F.lit(1), F.greatest(last, F.lit(0))), lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, WINDOW)]))
    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_covered(w)))


def _covered(windows: Column) -> Column:
    """Places that windows with an equal cover. Sorted with their places, equal ones are neighbours."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
        twice = F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def total(p: Column) -> Column:
        reach = F.transform(p, lambda i, k: F.least(F.coalesce(F.get(p, k + 1) - i, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(reach, F.lit(0), lambda a, b: a + b)

    return let(let(placed, starts), total)


def statistics(text: Column) -> Column:
    """A struct of the base statistics, n_lines and the numbers in FEATURES for a text. Null counts as empty; of a text without words all are zero."""
    text = F.coalesce(text, F.lit(""))
    count = lambda kept_: F.length(F.regexp_replace(text, f"[^{kept_}]+", ""))
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    by_words = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.struct(F.size(h).alias("n"), _repeated(h).alias("repeat")))
    by_lines = let(lines, lambda s: F.struct(F.size(s).alias("n"), (F.size(s) - F.size(F.array_distinct(s))).alias("dup")))
    parts = F.struct(
        by_words.alias("words"),
        by_lines.alias("lines"),
        F.length(F.regexp_replace(text, SPACES, "")).alias("chars"),
        count(r"#*$%&|<>").alias("symbols"),
        count(r"\p{Lu}").alias("capitals"),
        count(r"!?").alias("marks"),
    )

    def finish(p: Column) -> Column:
        share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0)).cast("double")
        n = p["words"]["n"]
        base = [n, p["chars"], p["symbols"], p["lines"]["dup"], p["words"]["repeat"]]
        return F.struct(
            *[c.cast("long").alias(name) for c, name in zip(base, BASE, strict=True)],
            share(p["chars"], n).alias("mean_word"),
            share(p["symbols"], n).alias("symbols_a_word"),
            share(p["lines"]["dup"], p["lines"]["n"]).alias("dup_line_share"),
            share(p["words"]["repeat"], n).alias("repeat_share"),
            share(p["capitals"], p["chars"]).alias("capital_share"),
            share(p["marks"], n).alias("marks_a_word"),
        )

    return let(parts, finish)


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < LEAST_WORDS) | (100 * stats["n_repeat_words"] > MOST_REPEATED * stats["n_words"])


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # feature >= value, else feature < value
    value: float

    def column(self, stats: Column) -> Column:
        return stats[self.feature] >= self.value if self.above else stats[self.feature] < self.value

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.value:g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    bad: int  # labelled rows that the rule is the first to cover
    good: int

    def column(self, stats: Column) -> Column:
        return reduce(lambda a, b: a & b, [c.column(stats) for c in self.conditions])

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


#: Counts of a cell: (bad to grow on, good, bad to prune on, good).
Cells = dict[tuple[int, ...], tuple[int, int, int, int]]


def _sums(cells: Cells, tests: list[tuple[int, bool, int]]) -> tuple[int, ...]:
    covered = [n for cell, n in cells.items() if _covers(cell, tests)]
    return tuple(map(sum, zip(*covered, strict=True))) if covered else (0, 0, 0, 0)


def _covers(cell: tuple[int, ...], tests: list[tuple[int, bool, int]]) -> bool:
    return all((cell[f] >= bin_) == above for f, above, bin_ in tests)


def _grow(cells: Cells, bins: list[int]) -> list[tuple[int, bool, int]]:
    """Adds the condition with the most information gain over the bad rows that stay, until no good row is covered or nothing gains."""
    tests: list[tuple[int, bool, int]] = []
    while len(tests) < MOST_CONDITIONS:
        inside = {c: n for c, n in cells.items() if _covers(c, tests)}
        bad, good = _sums(inside, [])[:2]
        if not bad or not good:
            break
        best = (1e-9, None)
        for f, count in enumerate(bins):
            per = [[0, 0] for _ in range(count)]
            for cell, n in inside.items():
                per[cell[f]][0] += n[0]
                per[cell[f]][1] += n[1]
            low = [0, 0]
            for b in range(1, count):
                low = [low[0] + per[b - 1][0], low[1] + per[b - 1][1]]
                for above, (p, q) in ((False, low), (True, [bad - low[0], good - low[1]])):
                    if p and (gain := p * (math.log(p / (p + q)) - math.log(bad / (bad + good)))) > best[0]:
                        best = (gain, (f, above, b))
        if best[1] is None:
            break
        tests.append(best[1])
    return tests


def _prune(cells: Cells, tests: list[tuple[int, bool, int]]) -> list[tuple[int, bool, int]]:
    """The first conditions that do best on the rows kept apart: bad less good of those covered, the fewest of equals."""

    def worth(k: int) -> float:
        bad, good = _sums(cells, tests[:k])[2:]
        return (bad - good) / (bad + good) if bad + good else -1.0

    return tests[: max(range(1, len(tests) + 1), key=lambda k: (worth(k), -k))]


def cover(cells: Cells, cuts: list[list[float]]) -> list[Rule]:
    """The decision list of the counted cells; `cuts` has the ascending cuts of each feature, one less than its bins."""
    rules, left = [], dict(cells)
    while len(rules) < MOST_RULES and (tests := _grow(left, [len(c) + 1 for c in cuts])):
        tests = _prune(left, tests)
        grown_bad, grown_good, bad, good = _sums(left, tests)
        if grown_bad + bad < LEAST_BAD or grown_bad + bad < LEAST_SHARE * (grown_bad + grown_good + bad + good):
            break
        conditions = tuple(Condition(FEATURES[f], above, cuts[f][b - 1]) for f, above, b in tests)
        rules.append(Rule(conditions, grown_bad + bad, grown_good + good))
        left = {c: n for c, n in left.items() if not _covers(c, tests)}
    return rules


def describe(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id and, in columns, what `statistics` has. Computed once, to learn from and to judge."""
    stats = docs.select(F.col(key).alias("doc_id"), F.explode(F.array(statistics(docs[text]))).alias("s"))
    return kept(stats.select("doc_id", "s.*"))


def _struct() -> Column:
    return F.struct(*dict.fromkeys(BASE + FEATURES))


def learn(stats: DataFrame, labels: DataFrame) -> list[Rule]:
    """Rules for documents of low quality, from all rows of `stats` that `labels` (doc_id, quality) marks 0 or 1.

    Rows that fail the base rules teach nothing, as they are dropped anyway. An id with several labels counts with each.
    Without labels of both kinds the list is empty.
    """
    marked = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
    joined = stats.where(~base_failed(_struct())).join(marked, "doc_id")
    rows = kept(joined.select("doc_id", "quality", *[F.col(f).cast("double").alias(f) for f in FEATURES]))
    found = rows.groupBy("quality").agg(*[F.percentile_approx(f, QUANTILES, 10_000).alias(f) for f in FEATURES]).collect()
    if len(found) < 2:
        return []
    cuts = [sorted({v for r in found for v in r[f]}) for f in FEATURES]
    bins = [sum(((F.col(f) >= c).cast("int") for c in own), F.lit(0)).alias(f) for f, own in zip(FEATURES, cuts, strict=True)]
    grow = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(10)) < GROW
    kinds = [F.count_if(grow & (F.col("quality") == 0)), F.count_if(grow & (F.col("quality") == 1)), F.count_if(~grow & (F.col("quality") == 0)), F.count_if(~grow & (F.col("quality") == 1))]
    counted = rows.select("doc_id", "quality", *bins).groupBy(*FEATURES).agg(*[k.alias(f"n{i}") for i, k in enumerate(kinds)])
    # At most the product of the bins, however many rows there are.
    return cover({tuple(r[: len(FEATURES)]): tuple(r[len(FEATURES) :]) for r in counted.collect()}, cuts)


def judge(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per row of `stats`: doc_id, the base statistics, base_failed, rule (the number of the first rule that covers it, from 1, or 0) and kept."""
    rule = F.lit(0)
    for k, r in reversed(list(enumerate(rules, 1))):
        rule = F.when(r.column(_struct()), F.lit(k)).otherwise(rule)
    judged = stats.select("doc_id", *BASE, base_failed(_struct()).alias("base_failed"), rule.alias("rule"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
