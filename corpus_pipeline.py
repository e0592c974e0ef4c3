"""Corpus pipeline: each stage calls one operator of :mod:`astrolabe.llm` on all rows its predecessor kept.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)``
and returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from astrolabe.llm import exact_dedup, language_id, mixing, sentencepiece_bpe, simhash
from astrolabe.llm.common import materialise, table
from astrolabe.session import ship_package


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language (no text, or no letter in it) go."""
    ship_package(spark)
    return language_id.keep_recognised(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, the one with the smallest identifier goes on."""
    return exact_dedup.dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints are linked, the one with the smallest identifier goes on."""
    ship_package(spark)
    return simhash.dedup(docs, words=simhash.SHINGLE_WORDS, radius=simhash.RADIUS)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a document appears once per pass that takes it, cut where its source's target ends."""
    mixed = mixing.mixed_documents(docs)
    return mixed.withColumn("n_chars", F.length("text").cast(mixed.schema["n_chars"].dataType))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with the digests of ids and decoded text."""
    ship_package(spark)
    made = sentencepiece_bpe.encode_documents(docs, carry=("lang", "source")).withColumnRenamed("id", "doc_id")
    return made.drop("decoded")


STAGES = [
    ("language ID", language_stage),
    ("exact dedup", exact_stage),
    ("SimHash near-dedup", near_stage),
    ("mixing sources to target weights", mix_stage),
    ("SentencePiece encoding and decoding", token_stage),
]

#: No SQL: the stages learn a model, hash with XXH64 and run a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of the last."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
