import random
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from reelmetrics.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def fewest(items, capacity):
    """The least number of bins, by trying every assignment."""
    items, best = sorted(items, reverse=True), len(items)

    def go(at, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if at == len(items):
            best = len(bins)
            return
        for k, b in enumerate(bins):
            if b + items[at] <= capacity and b not in bins[:k]:
                go(at + 1, [*bins[:k], b + items[at], *bins[k + 1 :]])
        go(at + 1, [*bins, items[at]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(30))
def test_recipes_against_the_optimum(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 20, 40])
    items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 10))]
    plan = packing.recipes(Counter(items), capacity)
    used = Counter()
    for r in plan:
        assert sum(n * u for n, u in r.parts) <= capacity
        for n, u in r.parts:
            used[n] += u * r.times
    assert used == Counter(items)
    assert sum(r.times for r in plan) == fewest(items, capacity) >= packing.least_sequences(Counter(items), capacity)


def test_number_of_recipes_does_not_follow_the_counts():
    counts = {n: 1 + n % 7 for n in range(1, 400)}
    few = len(packing.recipes(counts, 512))
    assert len(packing.recipes({n: c * 1_000_000 for n, c in counts.items()}, 512)) <= 4 * few


def test_words_encode_like_whole_texts():
    texts = ["THAN, Than. than's than'S it''s don't, '' '' x<|ENDOFTEXT|> ÀÉ, J\u030c I\u0307 ǅ. naïve… …a éa,b", "", None, "Hello, world's  end\n\tÄÖß 12345 !!!", "a b c d\x1ce <|endoftext|>x ΑΣ ΣΑΣ.", "x" * 5000, "é é ́a", "'ll it's o'clock", "汉字 テスト 🙂🙂"]
    tokenizer = Tokenizer.from_file(PATH)
    encoder = packing._Encoder(PATH)
    got = [list(struct.unpack(f"<{len(b) // 4}I", b)) for b in map(encoder.text, texts)]
    assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_packed_documents(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["alpha", "be", "gammas", "99"]) for _ in range(rng.randint(0, 90))), "x") for i in range(150)]
    rows += [(7, None, "x"), (None, "", "x"), (500, "word " * 700, "x"), (500, "word " * 700, "x"), (3, rows[3][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string")
    cut = packing.pieces(docs, PATH, 64, with_ids=True)
    got = packing.pack(cut, 64).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = Counter()
    for key, text, _ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, start in enumerate(range(0, len(ids), 64)):
            part = ids[start : start + 64]
            want[key, piece, start, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) == packing.least_sequences(Counter(r.length for r in got), 64)
    whole = {r.sequence_id: r for r in packing.sequences(packing.pack(cut, 64)).collect()}
    assert len(whole) == len(bins) and all(len(r.ids) == 4 * r.length for r in whole.values())
    assert packing.pack(packing.pieces(docs.where("false"), PATH, 64), 64).count() == 0


def checked(counts, capacity):
    """The number of sequences, after a look at whether the plan holds every piece."""
    plan, used = packing.recipes(counts, capacity), Counter()
    for r in plan:
        assert r.times > 0 and sum(n * u for n, u in r.parts) <= capacity
        used.update({n: u * r.times for n, u in r.parts})
    assert used == Counter(counts)
    return sum(r.times for r in plan), len(plan)


def test_other_fillings_are_tried():
    assert checked(Counter([11, 10, 7, 7, 7, 6, 4, 4, 3]), 20)[0] == 3
    greedy = sum(r.times for r in packing._greedy({2200: 1000, 2000: 1000, 1200: 1000, 600: 1000, 800: 2000, 1400: 3000}, 4096, 300))
    for k in (1, 1000):
        number, few = checked({2200: 1000 * k, 2000: 1000 * k, 1200: 1000 * k, 600: 1000 * k, 800: 2000 * k, 1400: 3000 * k}, 4096)
        assert greedy == 3333 and number == 3000 * k and few < 40


@pytest.mark.parametrize("seed", range(40))
def test_search_against_the_optimum(seed):
    rng = random.Random(1000 + seed)
    capacity = rng.choice([20, 30, 50])
    items = [rng.randint(2, capacity * 2 // 3) for _ in range(rng.randint(8, 12))]
    assert checked(Counter(items), capacity)[0] == fewest(items, capacity)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "İ", "İ.", "TEŞEKKÜRLERİ!", "Bİ", "é", "É", "ß", "ſ", "́", "ʼ", "ñ", "漢", ".", "!", "-", "'s", " ", "\n", "1", "½"]), max_size=12).map("".join))
def test_odd_letters_encode_like_the_tokenizer(text):
    ids = packing._tokenizer(PATH).encode(text, add_special_tokens=False).ids
    assert packing._Encoder(PATH).text(text) == struct.pack(f"<{len(ids)}I", *ids)
