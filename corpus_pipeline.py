"""A training corpus from `documents`: known languages, one of each near-duplicate group, no benchmark text, no personal data, packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provlake.llm import decontam, langid, packing, pii, simhash
from provlake.llm.common import materialize, read_table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the fitted model tells; null texts and texts without a letter go. Repeated rows are judged alike."""
    return langid.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of copies and near copies: the smallest id's, null ids last; of rows alike in all columns one."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item of 20 characters or more within 5 % edits; null and empty texts stay, rows are judged one by one."""
    return decontam.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced by the kind's name; n_chars follows the text. Null and empty texts stay as they are."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document in pieces with their places in sequences of 4096 tokens; a null text holds the end id alone."""
    return packing.pack_documents(docs, ids=True)


STAGES = [("language_id", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("redact_pii", redact), ("pack", pack)]

#: SQL cannot express the fingerprints, the fitted language model or the packing; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
