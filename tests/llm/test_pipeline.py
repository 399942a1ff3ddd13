from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from tokenizers import Tokenizer

from reelmetrics.llm import mixing, packing, pseudonyms, simhash
from reelmetrics.llm.registry import PSEUDONYM_KEY, tokenizer_path


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    """The rows before and after each stage, on the smallest documents and some odd ones."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    first = docs.orderBy("doc_id").first()
    odd = [(10**6, None, "en", "src1", 0), (10**6 + 1, "12 34", None, None, 5), (None, "The and of the that was", "en", None, None), (10**6 + 2, "", "en", "src1", 0), tuple(first), tuple(first)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    out = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, small).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def test_columns(stages):
    assert all(r.__fields__ == ["doc_id", "text", "lang", "source", "n_chars"] for rows in stages[:-1] for r in rows[:1])


def test_language_stage_drops_what_has_no_letters(stages):
    assert Counter(stages[1]) == Counter(r for r in stages[0] if r.text and any(c.isalpha() for c in r.text))


def test_one_of_each_group_stays(stages):
    rows = sorted(stages[1], key=lambda r: (r.doc_id is None, r.doc_id))
    prints = [int.from_bytes(simhash.fingerprint_bytes(r.text), "big") for r in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3 and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    assert Counter(r.doc_id for r in stages[2]) == Counter(rows[g].doc_id for g in set(group))
    assert set(stages[2]) <= set(stages[1])


def test_personal_data_is_replaced(stages):
    permute = pseudonyms.Permutation(PSEUDONYM_KEY.encode())
    want = Counter((r.doc_id, pseudonyms.replace(r.text, permute)[0], *r[2:]) for r in stages[2])
    assert Counter(map(tuple, stages[3])) == want
    assert sum(a.text != b.text for a, b in zip(sorted(stages[2], key=lambda r: r.doc_id or 0), sorted(stages[3], key=lambda r: r.doc_id or 0), strict=True)) > 3


def test_mix_follows_the_schedule(spark, small, stages, tmp_path):
    """The stage keeps every row, and its files hold them in the order of their blocks' slots."""
    assert Counter(stages[4]) == Counter(stages[3])
    docs = spark.createDataFrame(stages[3], spark.read.parquet(f"{small}/documents.parquet").schema)
    slots = {}
    for r in mixing.mix(docs).select("row.doc_id", "row.text", "slot", "start").collect():
        slots.setdefault((r.doc_id, r.text), []).append((r.slot, r.start))
    corpus_pipeline.mix(spark, docs, small).write.parquet(f"{tmp_path}/mixed")
    rows = spark.read.parquet(f"{tmp_path}/mixed").select("doc_id", "text", "_metadata.file_name", "_metadata.row_index").collect()
    order = [slots[r.doc_id, r.text].pop() for r in sorted(rows, key=lambda r: (r.file_name, r.row_index))]
    assert order == sorted(order)


def test_packed_pieces(stages):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for r in stages[4]:
        n = len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1
        want.update((r.doc_id, k, s, min(4096, n - s)) for k, s in enumerate(range(0, n, 4096)))
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in stages[5]) == want
    bins = defaultdict(list)
    for r in stages[5]:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        ends = [0] + [o + n for o, n in sorted(parts)]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 4096
    assert len(bins) == packing.least_sequences(Counter(r.length for r in stages[5]), 4096)


def test_empty_documents(spark, small, tmp_path):
    spark.read.parquet(f"{small}/documents.parquet").where("false").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_mix_leaves_out_no_document(spark, small):
    """One source has a third of the text, 20 others share the rest; what the hot source has beyond its weight stays too."""
    rows = [(i, f"{i} " * 5_000, "en", "hot" if i % 3 == 0 else f"s{i % 20}", 0) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    assert not mixing.mix(docs).where("not in_mix").isEmpty()
    assert Counter(r.doc_id for r in corpus_pipeline.mix(spark, docs, small).collect()) == Counter(range(400))


@pytest.fixture(scope="module")
def mixed(spark, small, tmp_path_factory):
    """Packed sequences of 300 documents of three sources, mixed with two sets of weights, in windows of four sequences."""
    rows = [(i, f"{'abc'[i % 3]} word{i} " * (300 + 37 * i % 200), "en", "abc"[i % 3], 0) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    out = []
    for weights in ({"a": 0.6, "b": 0.3, "c": 0.1}, {"a": 0.1, "b": 0.3, "c": 0.6}):
        path = str(tmp_path_factory.mktemp("mixed") / "docs")
        corpus_pipeline.mix(spark, docs, small, weights).write.parquet(path)
        files = spark.read.parquet(path).select("doc_id", "_metadata.file_name", "_metadata.row_index").collect()
        order = [r.doc_id for r in sorted(files, key=lambda r: (r.file_name, r.row_index))]
        out.append((order, corpus_pipeline.pack(spark, spark.read.parquet(path), small, 4).collect()))
    return out


def test_sequences_follow_the_mix(mixed):
    """After any number of sequences each source has the ids it has in as much of the mix's order, but for one window."""
    for order, packed in mixed:
        assert Counter((r.doc_id, r.piece) for r in packed).most_common(1)[0][1] == 1 and {r.doc_id for r in packed} == set(order)
        tokens = Counter()
        for r in packed:
            tokens[r.doc_id] += r.length
        bins = defaultdict(list)
        for r in packed:
            bins[r.sequence_id].append(r)
        done, at, so_far, wanted = Counter(), 0, 0, Counter()
        for _, parts in sorted(bins.items()):
            for r in parts:
                done[r.doc_id % 3] += r.length
            so_far += sum(r.length for r in parts)
            while at < len(order) and sum(wanted.values()) < so_far:
                wanted[order[at] % 3] += tokens[order[at]]
                at += 1
            assert all(abs(done[s] - wanted[s]) <= 4 * 4096 + 2 * 4096 for s in range(3))
            ends = sorted((r.offset, r.length) for r in parts)
            assert all(o + n == p for (o, n), (p, _) in zip(ends, ends[1:])) and ends[0][0] == 0 and sum(ends[-1]) <= 4096
        windows = {i >> 32 for i in bins}
        assert len(bins) <= packing.least_sequences(Counter(r.length for r in packed), 4096) + 2 * len(windows) and len(windows) > 10


def test_other_weights_give_another_order(mixed):
    first = []
    for _, packed in mixed:
        count = Counter()
        for r in sorted(packed, key=lambda r: r.sequence_id):
            if sum(count.values()) < 40 * 4096:
                count[r.doc_id % 3] += r.length
        first.append(count)
    assert first[0][0] > 2 * first[0][2] and first[1][2] > 2 * first[1][0]


def test_documents_that_are_in_no_file_are_packed(spark, small):
    docs = spark.createDataFrame([(1, "one two", "en", "s", 7), (None, None, None, None, None), (1, "one two", "en", "s", 7)], "doc_id long, text string, lang string, source string, n_chars int")
    assert Counter(r.doc_id for r in corpus_pipeline.pack(spark, docs, small).collect()) == Counter({1: 2, None: 1})
