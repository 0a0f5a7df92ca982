"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all that the stage before kept. All but
the last return the columns of documents. run() writes each stage's result in the shared folder and reads it back as
the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.llm.common import drop_materialized, materialize, table

#: Passages of so many words that several documents hold are cut.
PASSAGE_WORDS = 51


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, repeated rows alike: texts without letters, null texts and undecided ones go."""
    from lociweave.llm.langid import recognised

    return recognised(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays.

    That is the one with the least doc_id. Where different texts share a doc_id, each counts as a document: the one with
    the least hash under that doc_id, the others under a hash of their own. Of rows with equal doc_id and text one stays,
    that with the least hash of all its columns. Rows whose doc_id is null link with nothing and stay.
    """
    from lociweave.llm.neardup import near_duplicates

    own = next(f"own{k}" for k in range(len(docs.columns) + 1) if f"own{k}" not in docs.columns)
    version = F.xxhash64("text")
    ids = docs.where("doc_id is not null").select("doc_id", version.alias("version"))
    several = ids.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("version").alias("first")).where("rows > 1").drop("rows")
    several = materialize(several, "several")
    named = docs.join(several.withColumnRenamed("first", own), "doc_id", "left")
    # Hashes stand for texts that are not the first of their doc_id.
    named = named.withColumn(own, F.when(F.col(own).isNull() | (F.col(own) == version), F.col("doc_id").cast("long")).otherwise(F.xxhash64(F.lit("version"), "doc_id", "text")))
    gone = near_duplicates(named.select(F.col(own).alias("doc_id"), "text")).where(~F.col("kept")).select(F.col("doc_id").alias(own))
    gone = materialize(gone.distinct(), "gone")
    kept = named.join(gone, own, "left_anti")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if several.isEmpty():
        return kept.select(*columns)
    once = kept.join(several, "doc_id", "left_anti").select(*columns)
    often = kept.join(several, "doc_id", "left_semi").groupBy(own).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("row"))
    return once.unionByName(often.select("row.*"))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without repeats; null and empty texts stay as they are.

    Repeats are strings of 400 bytes and more that occur again anywhere, and passages of more than 50 words, however
    short in bytes, that other documents hold too. Both are judged on the texts that the stage is given.
    """
    from lociweave.llm.passages import shared_spans
    from lociweave.llm.suffixdedup import without_repeats

    return without_repeats(docs, more=lambda texts: shared_spans(texts, PASSAGE_WORDS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs; null and empty texts stay, and all if there are no items."""
    from lociweave.llm.decontam import uncontaminated

    return uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences of at most 1024 tokens; null and empty texts give their end mark."""
    import public_tokenizers

    from lociweave.llm.packing import pack_documents

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontaminate),
    ("packing", packing),
]

#: Language models and tokenizers are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        following = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if k:
            drop_materialized(docs)
        docs = following
    return docs
