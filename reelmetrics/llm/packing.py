"""Best-fit packing of token sequences by bin completion.

Pieces of equal length are alike, so the whole problem is a histogram of lengths: at most `capacity` numbers, whatever the
size of the corpus. The histogram is packed on the driver, giving recipes (which lengths share a sequence, how often).
Spark numbers the pieces of each length and looks up what recipe a number falls to.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmetrics.llm.common import kept

END = 1
#: Rows tokenised together.
SLICE = 256
#: Words and parts of words remembered, and the most bytes of each.
WORDS, PARTS, LONGEST = 400_000, 400_000, 64
_WORD = re.compile(rb"([A-Za-z\x80-\xff]+)([!-/:-@\[-`{-~]*)")
#: Letters below the first have no marks to compose and, but for the second, one letter as their lower case.
_LATIN, _DOTTED = "\u0250", "\u0130"
#: Pieces of one length that are numbered in one group, about.
SLICE_ROWS = 50_000
#: Branches tried in search of a plan that is better than the greedy one: the problem is NP-hard.
STEPS = 200_000

_PIECE_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it can be seen, else the next from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b if b in seen else next(others)) for b in range(256)]


class _Memo(dict):
    """Remembers what `make` gives for keys that are not long."""

    def __init__(self, make: Callable[[bytes], bytes], most: int) -> None:
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key: bytes) -> bytes:
        value = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


class _Encoder:
    """Token ids of texts as little-endian bytes.

    The tokenizer splits at white space first, and then between letters and what is neither letter nor digit. So words are
    encoded one by one and remembered, those made of letters and punctuation as the ids of both parts. Latin letters,
    which it only puts into lower case, can go to its merges at once.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = _tokenizer(path)
        self.merges, self.letters = self.tokenizer.model.tokenize, _byte_letters()
        self.words, self.parts = _Memo(self._word, WORDS), _Memo(self._part, PARTS)

    def _part(self, part: bytes) -> bytes:
        text = part.decode()
        if text.isalpha() and max(text) < _LATIN and _DOTTED not in text:
            mapped = text if text.isascii() else "".join([self.letters[b] for b in part])
            ids = [t.id for t in self.merges(mapped)]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: bytes) -> bytes:
        match = _WORD.fullmatch(word)
        if not match:
            return self.parts[word]
        head, tail = match.groups()
        if head.isalpha():  # of ASCII letters
            head = head.lower()
        else:
            text = head.decode()
            if not text.isalpha() or _DOTTED in text:  # the mark that its lower case ends in may join what follows
                return self.parts[word]
            if max(text) < _LATIN:
                head = text.lower().encode()
        return self.parts[head] + self.parts[tail] if tail else self.parts[head]

    def text(self, text: str | None) -> bytes:
        return b"".join(map(self.words.__getitem__, (text or "").encode().split()))


def _piece_batches(path: str, capacity: int, with_ids: bool, placed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(path)
        end = END.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                columns, rows = [c.slice(at, SLICE).to_pylist() for c in batch.columns], []
                for key, text, *place in zip(*columns, strict=True):
                    ids = encoder.text(text) + end
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[start : start + 4 * capacity]
                        rows.append((key, piece, start // 4, len(part) // 4, zlib.crc32(part), *[part] * with_ids, *place))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * with_ids, *[pa.int64()] * placed]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, *["place"] * placed]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, with_ids: bool = False, key: str = "doc_id", text: str = "text", place: Column | None = None) -> DataFrame:
    """The documents' token ids with an end mark, cut into pieces of at most `capacity`.

    Columns doc_id, piece (from 0), start, length, ids_crc32 and, on request, ids (little-endian unsigned 32-bit) and place,
    a long by which the documents are in order. A null or empty text is the end mark alone. Repeated rows give repeated pieces.
    """
    placed = place is not None
    ddl = _PIECE_DDL + ", ids binary" * with_ids + ", place long" * placed
    needed = [F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *([place.cast("long").alias("place")] if placed else [])]
    return docs.select(*needed).mapInArrow(_piece_batches(tokenizer_path, capacity, with_ids, placed), ddl)


@dataclass(frozen=True)
class Recipe:
    """`times` sequences that hold `uses` pieces of each length."""

    parts: tuple[tuple[int, int], ...]  # (length, uses), longest first
    times: int


def completion(lengths: list[int], counts: dict[int, int], room: int, nodes: int) -> list[tuple[int, int]]:
    """The undominated filling of `room` with the least waste, as (length, uses), longest first.

    `lengths` ascends and `counts` has how many of each are left. Fillings are tried longest piece first, so that the best
    fit is the first incumbent and, of equal waste, the one with the longest pieces stays; a branch ends where what is
    short enough to follow cannot bring the waste below the incumbent's. After `nodes` branches the incumbent is taken.
    """
    short: list[int] = []  # the volume of all pieces up to a length, as far as it is below the room
    for length in lengths:
        volume = (short[-1] if short else 0) + length * counts[length]
        if volume >= room:
            break
        short.append(volume)
    best: list[tuple[int, int]] = []
    waste, left = room, nodes

    def fill(room: int, top: int, chosen: list[tuple[int, int]]) -> None:
        nonlocal best, waste, left
        if room < waste:
            best, waste = list(chosen), room
        at = min(top, bisect_right(lengths, room)) - 1
        while at >= 0 and waste and left > 0 and (at >= len(short) or room - short[at] < waste):
            left -= 1
            length = lengths[at]
            uses = min(counts[length], room // length)
            for n in range(uses, 0, -1):
                fill(room - n * length, at, [*chosen, (length, n)])
                if not waste or left <= 0:
                    return
            at -= 1

    fill(room, len(lengths), [])
    return best


def recipes(counts: dict[int, int], capacity: int, nodes: int = 300, steps: int = STEPS) -> list[Recipe]:
    """How to pack `counts` pieces of each length into as few sequences as the search finds.

    The greedy plan is the first incumbent. Where it needs more than `least_sequences`, a branch-and-bound over completions looks
    for a better one, until the bound is met, all is searched, or `steps` branches are tried.
    """
    plan = _greedy(counts, capacity, nodes)
    least = least_sequences(counts, capacity)
    for amounts in (lambda most: [most], _amounts):  # at first each filling as often as it can be had, which is a far smaller search
        if sum(r.times for r in plan) > least:
            plan = _search(counts, capacity, plan, least, steps // 2, amounts)
    return plan


def _fillings(lengths: list[int], left: dict[int, int], room: int, most: int, steps: int) -> tuple[list[tuple[int, tuple[tuple[int, int], ...]]], int]:
    """The fillings of `room` with a waste of at most `most` that no other filling is known to dominate, as (waste, parts), the
    least waste first; and the branches tried, `steps` at most. A filling is dominated if a piece that is left fits beside it, or
    in place of a shorter one.
    """
    volume = [0]
    for n in lengths:
        volume.append(volume[-1] + n * left[n])
    found, tried = [], 0

    def dominated(room: int, used: dict[int, int]) -> bool:
        free = lambda n: left[n] > used.get(n, 0)
        if (n := next(filter(free, lengths), None)) is not None and n <= room:
            return True
        for n in used:
            longer = next((m for m in lengths[bisect_right(lengths, n) : bisect_right(lengths, n + room)] if free(m)), None)
            if longer is not None:
                return True
        return False

    def fill(room: int, top: int, chosen: tuple[tuple[int, int], ...]) -> None:
        nonlocal tried
        if room <= most and not dominated(room, dict(chosen)):
            found.append((room, chosen))
        for at in range(min(top, bisect_right(lengths, room)) - 1, -1, -1):
            if room - volume[at + 1] > most:
                return
            n = lengths[at]
            for uses in range(min(left[n], room // n), 0, -1):
                if tried >= steps:
                    return
                tried += 1
                fill(room - uses * n, at, (*chosen, (n, uses)))

    fill(room, len(lengths), ())
    return sorted(found, key=_order), tried


def _order(filling: tuple[int, tuple[tuple[int, int], ...]]) -> tuple:
    return filling[0], [(-n, -u) for n, u in filling[1]]


def _amounts(most: int) -> list[int]:
    """How often a filling may be taken at a time: any number is a sum of these, and few are tried where there are many."""
    return list(range(most, 0, -1)) if most <= 8 else [most, *(1 << k for k in range(most.bit_length() - 1, -1, -1) if 1 << k < most)]


def _search(counts: dict[int, int], capacity: int, plan: list[Recipe], least: int, steps: int, amounts: Callable[[int], list[int]]) -> list[Recipe]:
    """The best plan by branch-and-bound: around the longest piece left every undominated filling, in each of `amounts`.

    A branch ends where its waste, or the bound for what is left, cannot lead below the incumbent. While the longest stays the
    same, fillings follow in order, so that no plan is tried twice.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    total, best = sum(n * c for n, c in left.items()), sum(r.times for r in plan)
    path: list[tuple[Recipe, int]] = []
    used = wasted = 0

    def branches(last: tuple | None) -> Iterator[tuple[int, int, dict[int, int], tuple]]:
        nonlocal steps
        lengths = sorted(n for n, c in left.items() if c)
        longest = lengths[-1]
        left[longest] -= 1
        # No single branching takes all steps, so that a plan is always completed.
        found, tried = _fillings(lengths, left, capacity - longest, (best - 1) * capacity - total - wasted, max(50, steps // 16))
        left[longest] += 1
        steps -= tried + 1 + len(lengths) // 16  # what the bounds cost too
        for filling in found:
            order = (-longest, *_order(filling))
            if last is not None and last[0] == order[0] and order < last:
                continue
            uses = dict(filling[1])
            uses[longest] = uses.get(longest, 0) + 1
            for times in amounts(min(left[n] // u for n, u in uses.items())):
                yield times, filling[0], uses, order

    stack = [branches(None)]
    while stack and steps > 0 and best > least:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if path:
                recipe, waste = path.pop()
                used, wasted = used - recipe.times, wasted - waste
                for n, u in recipe.parts:
                    left[n] += u * recipe.times
            continue
        times, waste, uses, order = step
        steps -= 1
        if wasted + times * waste > (best - 1) * capacity - total:
            continue
        recipe = Recipe(tuple(sorted(uses.items(), reverse=True)), times)
        path.append((recipe, times * waste))
        used, wasted = used + times, wasted + times * waste
        for n, u in recipe.parts:
            left[n] -= u * times
        rest = {n: c for n, c in left.items() if c}
        if not rest and used < best:
            plan, best = [r for r, _ in path], used
        stack.append(branches(order) if rest and used + least_sequences(rest, capacity) < best else iter(()))
    return plan


def _greedy(counts: dict[int, int], capacity: int, nodes: int) -> list[Recipe]:
    """Around the longest left, the best completion, as often as it can be had.

    The number of recipes does not depend on how many pieces there are: each uses up a length, or leaves fewer of one than it
    takes at a time.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    lengths, found = sorted(left), []
    while lengths:
        longest = lengths[-1]
        left[longest] -= 1
        rest = completion(lengths, left, capacity - longest, nodes)
        left[longest] += 1
        uses = dict(rest)
        uses[longest] = uses.get(longest, 0) + 1
        times = min(left[n] // u for n, u in uses.items())
        found.append(Recipe(tuple(sorted(uses.items(), reverse=True)), times))
        for n, u in uses.items():
            left[n] -= u * times
            if not left[n]:
                del lengths[bisect_left(lengths, n)]
    return found


def least_sequences(counts: dict[int, int], capacity: int) -> int:
    """A bound that no packing can beat: by volume, or by pieces too long to share with each other."""
    n = np.array(sorted(counts), np.int64)
    c = np.array([counts[k] for k in n.tolist()], np.int64)
    number, volume = np.r_[0, np.cumsum(c)], np.r_[0, np.cumsum(n * c)]
    half = np.searchsorted(n, capacity // 2, "right")
    low = np.r_[0, n[:half]]
    large, small = np.searchsorted(n, capacity - low, "right"), np.searchsorted(n, low)
    middle = number[large] - number[half]
    free = middle * capacity - (volume[large] - volume[half])
    over = np.maximum(0, -((free - (volume[half] - volume[small])) // capacity))
    return max(int(-(-volume[-1] // capacity)), int((number[-1] - number[large] + middle + over).max()))


def _places(plan: list[Recipe]) -> tuple[np.ndarray, ...]:
    """Per length and run of numbers: key (length, first number), uses, first sequence, offset in it."""
    rows, number, sequence = [], {}, 0
    for recipe in plan:
        offset = 0
        for length, uses in recipe.parts:
            first = number.get(length, 0)
            rows.append(((length << 44) | first, uses, sequence, offset))
            number[length] = first + uses * recipe.times
            offset += length * uses
        sequence += recipe.times
    return tuple(np.array(c, np.int64) for c in zip(*sorted(rows), strict=True)) if rows else (np.empty(0, np.int64),) * 4


def _place_batches(places: tuple[np.ndarray, ...], columns: list[str]):
    keys, uses, first, offsets = places

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            at = np.searchsorted(keys, (length << 44) | number, "right") - 1
            nth = number - (keys[at] & ((1 << 44) - 1))
            sequence, offset = first[at] + nth // uses[at], offsets[at] + nth % uses[at] * length
            yield pa.record_batch([*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    return run


def pack(cut: DataFrame, capacity: int = 4096, nodes: int = 300) -> DataFrame:
    """The pieces with sequence_id (from 0) and offset, gapless from 0 in each sequence.

    `cut` is what `pieces` returns. No piece is dropped, and no sequence holds more than `capacity` ids. Which of several
    pieces of one length takes which place follows a hash of doc_id and piece. An empty table gives an empty result.
    """
    cut = kept(cut)
    columns = cut.columns
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    slices = 1 + sum(counts.values()) // SLICE_ROWS
    sliced = cut.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slices)).cast("int"))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sliced.groupBy("length", "slice").agg(F.count("*").alias("n")).select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32")
    numbered = sliced.withColumn("nth", F.row_number().over(within) - 1).join(starts, ["length", "slice"])
    numbered = numbered.select(*columns, (F.col("first") + F.col("nth")).alias("number"))
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    return numbered.mapInArrow(_place_batches(_places(recipes(counts, capacity, nodes)), columns), f"{ddl}, sequence_id long, offset long")


def _window_packer(capacity: int, nodes: int, steps: int):
    """Packs the pieces of one window; its sequences are numbered by their first piece in order."""

    def run(window: pa.Table) -> pa.Table:
        window = window.sort_by("ahead")
        length = window.column("length").to_numpy()
        kinds, of, counts = np.unique(length, return_inverse=True, return_counts=True)
        by_length = np.argsort(of, kind="stable")
        number = np.empty(len(of), np.int64)
        number[by_length] = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        keys, uses, first, offsets = _places(recipes(dict(zip(kinds.tolist(), counts.tolist(), strict=True)), capacity, nodes, steps))
        at = np.searchsorted(keys, (length << 44) | number, "right") - 1
        nth = number - (keys[at] & ((1 << 44) - 1))
        _, earliest, sequence = np.unique(first[at] + nth // uses[at], return_index=True, return_inverse=True)
        rank = np.argsort(np.argsort(earliest))
        ids = (window.column("window").to_numpy() << 32) | rank[sequence]
        out = window.drop_columns(["window", "ahead", "place"])
        return out.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets[at] + nth % uses[at] * length))

    return run


def pack_in_order(cut: DataFrame, capacity: int = 4096, window: int = 512, nodes: int = 300, steps: int = 2_000) -> DataFrame:
    """The pieces with sequence_id and offset, gapless from 0 in each sequence; sequences follow the order of the pieces.

    `cut` is what `pieces` returns with `place`. In the order of (place, doc_id, start) the pieces are cut into windows of as many ids as
    `window` sequences hold, and each window is packed by itself in a task, the greedy plan first and then `steps` branches where it
    misses the bound. sequence_id ascends from window to window, with gaps between them, and in a window by the first piece in order.
    So the pieces of the first sequences are the first pieces in order, but for those of one window, and each window needs at
    most the sequences of its own plan: a table takes at most about one sequence a window more than if it were packed as a whole.

    A piece is in the window that its first id falls into, so a window has at most `window` * `capacity` pieces, however the
    rows are spread. Repeated rows and equal places are kept; which of them comes first makes no difference to what a sequence holds.
    An empty table gives an empty result.
    """
    cut = kept(cut)
    columns = [c for c in cut.columns if c != "place"]
    sliced = cut.withColumn("slice", F.shiftright("place", 16))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # over one row a slice
    offsets = sliced.groupBy("slice").agg(F.sum("length").alias("sum")).select("slice", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("slice").orderBy("place", "doc_id", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("offset") + F.coalesce(F.sum("length").over(within), F.lit(0))
    placed = sliced.join(offsets, "slice").withColumn("ahead", ahead).select(*cut.columns, "ahead", F.expr(f"ahead div {window * capacity}").alias("window"))
    kinds = {f.name: f.dataType.simpleString() for f in cut.schema}
    ddl = ", ".join(f"{c} {kinds[c]}" for c in columns)
    return placed.groupBy("window").applyInArrow(_window_packer(capacity, nodes, steps), f"{ddl}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces with ids: sequence_id, length, ids (binary). A group is one sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    ids = F.aggregate(parts, F.lit(b"").cast("binary"), lambda all_, p: F.concat(all_, p["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), ids.alias("ids"))
