"""A corpus pipeline of five training-data operators: each stage works on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the shared scratch
folder and rereads. All but the last keep the columns of documents, and any others that the table has.

Null and empty texts have no words and go in the first stage. Texts are read whole in every stage, however long. Rows that
repeat are duplicates of each other: one stays. Of texts that are equally good members of a group the one of the smallest
doc_id stays; rows without id come last. An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cardloom.llm import byte_bpe, decontamination, line_dedup, near_dedup, quality_rules
from cardloom.llm.common import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality_rules.keep_good(docs)


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines in at least 10 documents go, as in op3; near duplicates count as one document, so that
    copies don't take each other's lines before the next stage keeps one of them. No row goes here."""
    groups = near_dedup.groups_of_texts(docs)
    return line_dedup.drop_shared_lines(docs, min_key_chars=1, min_documents=10, groups=groups).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near_dedup.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes."""
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", shared_lines),
    ("minhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("byte_bpe", tokens),
]

#: SQL can express neither the near-duplicate groups nor the merges; tests hold the stages against brute force.
ORACLE_SQL = None


#: Rows that go to a Python worker at once. Workers and the JVM's buffers outlive a stage, so all stages share this bound.
_ROWS, _BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, _BATCH_ROWS)
    try:
        for name, stage in STAGES:
            docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    finally:
        spark.conf.set(_ROWS, before)
    return docs
