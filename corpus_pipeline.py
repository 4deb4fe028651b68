"""A corpus pipeline: documents become packed training sequences.

Toxic documents go, one document of each near-duplicate group stays, secrets are masked, and
what is left is packed. Every stage is written as a table in the shared folder and
read by the next one; what the stages staged besides is deleted once the next one is written. All but the last stage
return the columns of documents, whatever else they are called. Null and empty texts are clean, copies of equal
texts, without secrets, and one end id to pack; repeated rows are copies of each other; rows with a null doc_id pass every
stage; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import _common, ngram_join, packing, secrets, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score, learned from ``labels``, does not reject; without labels all of them."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that the n-gram Jaccard join links; rows with a null doc_id all stay."""
    return ngram_join.keep_one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets found in them masked; null texts stay null."""
    return secrets.mask_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in a training sequence; a null or empty text is one piece of one id."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("ngram_join", drop_near_duplicates), ("secrets", mask_secrets), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = _common.documents(spark, sf_dir), _common.staged(spark)
    for name, step in STAGES[:-1]:
        docs = _common.stage(step(spark, docs, sf_dir), name)
        _common.drop_all(spark, but=[*before, _common.staged(spark)[-1]])
    return STAGES[-1][1](spark, docs, sf_dir)
