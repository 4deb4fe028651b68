"""The corpus operators as named queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import _common, collocations, filter_audit, forced_bpe, huffman, licence_scan, lm, main_text, near_vectors, ngram_join, packing, secrets, spot_join, spotsigs, toxicity


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprint_documents(_common.documents(spark, sf_dir))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_common.documents(spark, sf_dir))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_common.documents(spark, sf_dir))


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_documents(_common.documents(spark, sf_dir))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.round_trip(_common.documents(spark, sf_dir))


def op9_forced_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forced_bpe.encode_documents(_common.documents(spark, sf_dir), digest=True)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(_common.documents(spark, sf_dir))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_phrases(_common.documents(spark, sf_dir))


def op12_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan.scan_documents(_common.documents(spark, sf_dir))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(_common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def spotsigs_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spot_join.join_texts(_common.documents(spark, sf_dir))


def queries() -> dict:
    every = (
        op1_spotsigs, op2_packing, op3_main_text, op4_toxicity, op5_lm_score, op6_near_vectors, op7_ngram_join, op8_token_files, op9_forced_bpe, op10_secrets,
        op11_collocations, op12_licences, op13_filter_audit, spotsigs_join,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op11_collocations": collocations.mine_sql(), "op12_licences": licence_scan.scan_sql(), "op13_filter_audit": filter_audit.AUDIT_SQL}
