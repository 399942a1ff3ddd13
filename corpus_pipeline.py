"""From raw documents to packed training sequences, in five stages.

Each stage is given what the one before has kept, and is written as Parquet and read again before the next begins. All but
the last return the columns of the documents.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmetrics.llm import language, mixing, packing, pseudonyms, simhash
from reelmetrics.llm.common import scratch
from reelmetrics.llm.registry import pseudonym_key, tokenizer_path

# No stage but the mix could be put into SQL; tests compare the whole with a brute-force version.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those with letters, which a learned language explains better than letters drawn evenly."""
    model = language.learn(docs)
    found = language.mixture_of(docs["text"], model, spark)
    return docs.where((found["lang_pred"] != language.UNDETERMINED) & found["fits"])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id."""
    return simhash.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data in the text, by the key that the session names."""
    return pseudonyms.pseudonymise(docs, pseudonym_key(spark))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str, weights: dict[str | None, float] | None = None) -> DataFrame:
    """All documents, in the order of the mix; when a source ends, the others go on.

    The rows are in that order across the partitions, so in the files written from them too, whose names begin with the partition's number.
    """
    mixed = mixing.mix(docs, weights)
    ordered = mixed.repartitionByRange("slot", "start").sortWithinPartitions("slot", "start")
    return ordered.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str, window: int = 512) -> DataFrame:
    """Every piece of every document, with its sequence and place in it; sequences follow the order of the files' rows.

    Any first sequences hold what the mix has put first, but for the pieces of one window. Documents that do not come from files have no order,
    and are packed in that of a hash of their ids.
    """
    try:
        placed = docs.select("doc_id", "text", "_metadata.file_name", "_metadata.row_index")
        part = F.coalesce(F.regexp_extract("file_name", r"part-(\d+)", 1).try_cast("long"), F.lit(0))
        place = F.shiftleft(part, 40) + F.col("row_index")
    except AnalysisException:
        placed, place = docs, F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    return packing.pack_in_order(packing.pieces(placed, tokenizer_path(), 4096, place=place), 4096, window)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on the documents in `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
