"""A training corpus from raw documents: sound texts, one of each near-duplicate group, without secrets, mixed, packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm.common import scratch_table, table
from strandline.llm.mixing import sampled
from strandline.llm.packing import pack
from strandline.llm.quality import sound
from strandline.llm.secrets import redact
from strandline.llm.similar import keep_one
from strandline.llm.tokens import vocabulary_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on ``labels``, does not reject."""
    return sound(spark, docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8 or more."""
    return keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with confirmed secrets masked."""
    return redact(spark, docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by probabilities calibrated to the target marginals."""
    return sampled(spark, docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 ids."""
    return pack(docs, vocabulary_path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixture", mixture), ("packing", packing)]

#: The classifier, the forest and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
