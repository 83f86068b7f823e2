"""A corpus pipeline over ``documents``: quality, near-dedup, decontamination, mix, token store.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; all but the last return the columns of ``documents``.  In every stage null
texts count as empty, nulls in other columns play no part but that a null source
is a source, further columns are kept whatever their names, and an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm.decontamination import without_leaks
from colonnade.llm.mixing import mix_sources
from colonnade.llm.near_dups import keep_first_of_class
from colonnade.llm.quality import keep_good, train
from colonnade.llm.token_store import encode_documents
from colonnade.llm.work import cut, read_table
from colonnade.runtime import ship_package


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that score under 0.5 go; repeated rows are judged each."""
    ship_package(spark)
    return keep_good(docs, train(docs, read_table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: one document of each class stays, the one with the lowest doc_id; rows that repeat it are one."""
    ship_package(spark)
    return keep_first_of_class(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that hold a benchmark item go; empty texts hold none."""
    ship_package(spark)
    return without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: each document stands as often as the mix takes it.

    The mix takes whole documents but for the last one of each source, which is
    rounded: a source's words miss its target by half a document at most.
    Documents without words, of which the mix takes none, go.
    """
    ship_package(spark)
    keys = [F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_text")]
    plan = mix_sources(docs).withColumn("_n", F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + 0.5))
    plan = plan.filter("_n > 0").groupBy(F.col("doc_id").alias("_id"), "text_hash").agg(F.max("_n").alias("_n"))
    plan = plan.withColumnRenamed("text_hash", "_text")
    held = docs.select(F.struct("*").alias("_held"), *keys)
    match = held["_id"].eqNullSafe(plan["_id"]) & (held["_text"] == plan["_text"])
    rows = held.join(plan, match).select("_held", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    return rows.select("_held.*")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: ids in a content-addressed store, read back; copies of a row are documents of their own."""
    import public_tokenizers

    ship_package(spark)
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_dedup),
    ("decontamination", decontaminate),
    ("source mix", mix),
    ("token output", token_output),
]

#: SQL cannot express the classifier, the signatures and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = cut(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
