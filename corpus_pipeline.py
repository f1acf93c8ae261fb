"""A training-corpus pipeline: five stages, each written as Parquet and read again by the next.

quality     documents that the weak-label classifier rejects go
near_dedup  one document (the smallest doc_id) stays of each group that Jaccard similarities of 0.8 of word shingles link
decontam    documents that hold a benchmark item go
pii         personal data is replaced by its kind
bpe         texts become token ids, which decode to the text again

All but the last return the columns of ``documents``. Each handles nulls, empty and very long texts (whole), ties, repeated
rows, empty tables and further columns as its operator does; of repeated rows near_dedup keeps one. A stage's folder is
deleted once the next one is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from osseo.llm import bpe, decontaminate, pii, quality, similar
from osseo.llm.rows import deleted, passing, shared_folder, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = quality.score(docs.select(F.struct("*").alias("row")), *quality.train(docs), text="row.text")
    return scored.where(F.col("score") >= quality.THRESHOLD).select("row.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.one_of_each(docs)


def decontam_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    return bpe.coded(docs.select(*kept, "text"), ids="ids", digests=True).select(*kept, "n_tokens", "ids", "decoded_sha256")


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("decontam", decontam_stage), ("pii", pii_stage), ("bpe", bpe_stage)]

#: SQL cannot express the classifier, the components or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus_pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
        if before:
            deleted(spark, before)
        before = passing(spark, f"{folder}/{k}_{name}")
    return docs
