"""The queries of the text operators, over whole tables, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmetrics.llm import (
    covertree,
    decision_list,
    hard_negatives,
    language,
    lexical,
    licenses,
    mixing,
    packing,
    pseudonyms,
    simhash,
    token_store,
    toxicity,
    warc,
)
from reelmetrics.llm.common import fold, scratch, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary, by default that which packing counts tokens with."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document in a mix of the sources, weighted by their volume to the power 0.7."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("chars"))
    mixed = mixing.mix(docs, size=F.col("chars"))
    return mixed.select("row.doc_id", "row.source", "block", "start", "release", "slot", "deadline", "phase", "in_mix")


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and near-duplicate group of every embedding."""
    return covertree.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named in every document, and the sentences that tell."""
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.array_join(c, " ") for c in ("sentences", "licenses")})


CHECKS["op4_licenses"] = licenses.check_sql()


#: Stands for a secret where the session names none.
PSEUDONYM_KEY = "not a secret"


def pseudonym_key(spark: SparkSession) -> str:
    """The key of the pseudonyms: `spark.reelmetrics.pseudonymKey`, without which they can be undone by anyone."""
    return spark.conf.get("spark.reelmetrics.pseudonymKey", PSEUDONYM_KEY)


@query
def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with pseudonyms for personal data, and where they are."""
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", pseudonyms.pseudonyms_of(docs["text"], pseudonym_key(spark)).alias("found"))
    return found.select("doc_id", "found.text", F.size("found.spans").alias("n_replaced"), "found.spans")


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from the archives that it was written to."""
    folder = scratch(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), folder, shard_bytes=32 << 20, file_bytes=8 << 20)
    return warc.read_archives(spark, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "file")


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality statistics of every document, and whether the learned rules keep it."""
    stats = decision_list.describe(table(spark, sf_dir, "documents"))
    return decision_list.judge(stats, decision_list.learn(stats, table(spark, sf_dir, "labels")))


@query
def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence of at most 4096 tokens and its place in it."""
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path(), 4096), 4096)


#: Folds by id, and the one whose labels toxicity does not learn from; scores from which a document counts as toxic.
TOXIC_FOLDS, TOXIC_HELD_OUT, TOXIC_FROM = 4, 2, 0.3


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels outside the held-out fold."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = lambda key: F.coalesce(fold(key, TOXIC_FOLDS) == TOXIC_HELD_OUT, F.lit(False))
    classifier = toxicity.learn(docs, labels.where(~held_out(F.col("doc_id"))))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity.score_of(docs["text"], classifier, spark).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= TOXIC_FROM).cast("int"))


#: Folds by id whose documents language identification does not learn from.
LANGUAGE_FOLDS = 5


@query
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main language of every document, learned from those outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold(F.col("doc_id"), LANGUAGE_FOLDS) == 0, F.lit(False))
    model = language.learn(docs.where(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), language.mixture_of(docs["text"], model, spark).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score", "found.languages", "found.fits")


@query
def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 documents that score highest for each benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 50)


CHECKS["op11_search"] = lexical.check_sql(50)


@query
def op12_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and digest of every document's token ids, from the ORC files that they were written to."""
    folder = scratch(spark, "tokens")
    token_store.write_tokens(table(spark, sf_dir, "documents"), folder, tokenizer_path("byte_bpe_50k.json"))
    return token_store.digests(token_store.read_tokens(spark, folder))


#: Embeddings whose id is divisible by the first have labels one further, of so many.
RELABELLED, LABELS = 7, 10


@query
def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth embedding, for each of its five nearest of the same label."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % RELABELLED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved))


CHECKS["op13_negatives"] = hard_negatives.check_sql("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
