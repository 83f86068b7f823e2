"""The thin queries: an operator applied to its whole table, in the stated columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colonnade.llm.work import read_table


def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colonnade.llm.hilbert_shards import hilbert_shards

    return hilbert_shards(read_table(spark, sf_dir, "documents"), shards=8)


def op10_golden_ratio_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colonnade.llm.mixing import mix_sources

    return mix_sources(read_table(spark, sf_dir, "documents")).drop("text_hash")


def op5_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colonnade.llm.near_dups import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents")).drop("_a", "_b")


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colonnade.llm.fingerprints import fingerprint_documents

    return fingerprint_documents(read_table(spark, sf_dir, "documents"))


def op6_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colonnade.llm.decontamination import contaminated

    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_license_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colonnade.llm.licenses import scan_licenses

    return scan_licenses(read_table(spark, sf_dir, "documents"))


def op3_content_addressed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from colonnade.llm.token_store import encode_documents

    docs = read_table(spark, sf_dir, "documents")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op2_quality_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colonnade.llm.quality import score_documents, train

    docs = read_table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, read_table(spark, sf_dir, "labels")))


def op9_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colonnade.llm.secrets import labelled_samples, scan_secrets, train

    return scan_secrets(read_table(spark, sf_dir, "documents"), train(labelled_samples(spark)))


def op4_pii_bilstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colonnade.llm.pii import find_personal_data

    return find_personal_data(read_table(spark, sf_dir, "documents"))
