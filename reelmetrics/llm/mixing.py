"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a hashed order, are a stream of text that is cut into blocks of equal volume. With integer
shares `a` that add up to a period of H slots, block j of a source (from 0) may be placed from its release, floor(j H / a), and
must be placed by its deadline, ceil((j + 1) H / a). Taking the released block with the earliest deadline in each slot meets
every deadline, so that at any slot each source is less than one block from its target.

The schedule repeats with the period, so it is worked out once for H slots; where a block goes follows from its number by
arithmetic, for any number of blocks. When a source has given all its blocks a new phase begins: the rest go on with
their weights scaled up. Nothing is dropped and nothing repeated.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slots in a period: weights are kept to this precision.
PERIOD = 4096


def shares(weights: list[float], period: int = PERIOD) -> list[int]:
    """Integer shares of at least 1 that add up to `period`, by largest remainder."""
    if len(weights) > period:
        raise ValueError(f"{len(weights)} sources do not fit into a period of {period} slots")
    total = sum(weights)
    exact = [w / total * period for w in weights]
    found = [max(1, int(x)) for x in exact]
    order = sorted(range(len(weights)), key=lambda i: (found[i] - exact[i], i))
    while sum(found) < period:
        for i in order[: period - sum(found)]:
            found[i] += 1
    while sum(found) > period:
        found[max(range(len(found)), key=lambda i: (found[i] - exact[i] if found[i] > 1 else -period, -i))] -= 1
    return found


def pfair_slots(share: list[int], period: int = PERIOD) -> list[list[int]]:
    """For each source the slots of its blocks in one period, by earliest deadline first among the released blocks."""
    waiting = [(0, i, 0) for i in range(len(share))]
    ready: list[tuple[int, int, int]] = []
    found: list[list[int]] = [[] for _ in share]
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // share[i]), i, j))
        _, i, j = heapq.heappop(ready)
        found[i].append(slot)
        if j + 1 < share[i]:
            heapq.heappush(waiting, ((j + 1) * period // share[i], i, j + 1))
    return found


@dataclass(frozen=True)
class Run:
    """The blocks first .. first + count - 1 of a source, placed in a phase that begins at slot `base`."""

    source: int
    phase: int
    first: int
    count: int
    share: int
    base: int
    slots: list[int]
    weight: float  # of the sources that are still in the phase


def phases(blocks: list[int], weights: list[float], period: int = PERIOD) -> list[Run]:
    """The runs of all phases, for sources with so many blocks and weights. At most one phase for each source."""
    left, done, base, runs, phase = list(blocks), [0] * len(blocks), 0, [], 0
    whole = sum(w for w, n in zip(weights, blocks, strict=True) if n) or 1
    while active := [i for i, n in enumerate(left) if n]:
        weight = sum(weights[i] for i in active) / whole
        share = shares([weights[i] for i in active], period)
        slots = pfair_slots(share, period)
        # The phase ends at the first slot that would go to a source with nothing left.
        end = min(left[i] // a * period + s[left[i] % a] for i, a, s in zip(active, share, slots, strict=True))
        for i, a, s in zip(active, share, slots, strict=True):
            count = end // period * a + sum(x < end % period for x in s)
            runs.append(Run(i, phase, done[i], count, a, base, s, weight))
            left[i] -= count
            done[i] += count
        base, phase = base + end, phase + 1
    return runs


def temperature(volumes: list[int], alpha: float = 0.7) -> list[float]:
    """Weights by volume to the power `alpha`: below 1, large sources are held back."""
    return [max(v, 1) ** alpha for v in volumes]


def mix(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    alpha: float = 0.7,
    block: int = 65_536,
    seed: int = 42,
    size: Column | None = None,
    max_sources: int = 256,
    slices: int = 4096,
    enough: float = 0.5,
    period: int = PERIOD,
) -> DataFrame:
    """Where each document goes in a mix of the sources: all rows of `docs`, as a struct `row`, with the schedule's columns.

    source_group (int), block (long, from 0 in each source), start (long, the text volume before the document in its source's
    stream), slot, release and deadline (long), phase (int) and in_mix (boolean). (slot, start) is the order of the mix.

    `weights` has target weights by source; without it they are the volumes to the power `alpha`. Sources that it does not
    name, and without it all but the `max_sources` - 1 largest, are one group with the weight `weights[...]` (by default
    their volume's). A null source is a source. `size` is a document's volume, by default the characters of text; null
    counts as 0. A document belongs to the block it begins in; a document longer than a block leaves blocks without a
    beginning, which keep their slots. in_mix is true in the phases in which sources with at least `enough` of the weight
    take part; before the first source ends, each is less than one block from its target at any slot.

    Documents of a source stand in the order of a hash, cut into `slices`, so a source with most of the rows is ordered by many tasks.
    An empty table gives an empty result.
    """
    size = F.coalesce(F.length("text") if size is None else size, F.lit(0)).cast("long")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("source").alias("source"), size.alias("size"), F.xxhash64(F.lit(seed), "doc_id").alias("hash"))
    volumes = rows.groupBy("source").agg(F.sum("size").alias("volume"))
    if weights is None:
        named = [(r.source, r.volume) for r in volumes.orderBy(F.desc("volume"), "source").limit(max_sources - 1).collect()]
    else:
        wanted = F.col("source").isin([s for s in weights if isinstance(s, str)]) | (F.col("source").isNull() if None in weights else F.lit(False))
        named = [(r.source, r.volume) for r in volumes.where(wanted).orderBy(F.desc("volume"), "source").collect()]
    groups = docs.sparkSession.createDataFrame([(s, i) for i, (s, _) in enumerate(named)], "name string, source_group int")
    all_ = volumes.agg(F.sum("volume")).first()[0] or 0
    volume = [v for _, v in named] + [all_ - sum(v for _, v in named)]
    weight = temperature(volume, alpha) if weights is None else [weights[s] for s, _ in named] + [weights.get(..., volume[-1] / max(1, all_))]

    rest = len(named)
    shift = 64 - (slices - 1).bit_length()
    rows = rows.join(F.broadcast(groups), F.col("source").eqNullSafe(F.col("name")), "left").withColumn("source_group", F.coalesce("source_group", F.lit(rest)))
    rows = rows.select("row", "size", "hash", "source_group", F.shiftright("hash", shift).alias("slice"))
    before = Window.partitionBy("source_group").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("source_group", "slice").agg(F.sum("size").alias("sum")).select("source_group", "slice", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source_group", "slice").orderBy("hash", "row.doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets, ["source_group", "slice"])
    blocks = [max(1, -(-v // block)) for v in volume]
    counts = F.array(*[F.lit(n) for n in blocks])
    placed = placed.withColumn("start", F.col("offset") + F.col("ahead")).withColumn("block", F.least(F.floor(F.col("start") / block), F.element_at(counts, F.col("source_group") + 1) - 1))

    if not volume[-1] and all_:  # without this, a group of no documents would take part
        blocks[-1] = int(bool(rows.where(F.col("source_group") == rest).take(1)))
    plan = [(r.source, r.phase, r.first, r.first + r.count, r.share, r.base, r.slots, r.weight >= enough) for r in phases(blocks, weight, period) if r.count]
    runs = docs.sparkSession.createDataFrame(plan, "source_group int, phase int, begin long, after long, share long, base long, slots array<int>, in_mix boolean")
    # At most max_sources phases of `period` slots in all: a few MB.
    placed = placed.join(F.broadcast(runs), (placed["source_group"] == runs["source_group"]) & (placed["block"] >= runs["begin"]) & (placed["block"] < runs["after"])).drop(runs["source_group"])
    return placed.withColumn("nth", F.col("block") - F.col("begin")).select(
        "row",
        "source_group",
        "block",
        "start",
        F.expr(f"base + nth div share * {period} + element_at(slots, cast(nth % share + 1 as int))").alias("slot"),
        F.expr(f"base + nth * {period} div share").alias("release"),
        F.expr(f"base + ((nth + 1) * {period} + share - 1) div share").alias("deadline"),
        "phase",
        "in_mix",
    )
