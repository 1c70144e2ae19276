"""The corpus pipeline: five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and reread as the next one's docs. All but the last return the columns of
documents; the last returns the packed pieces.

Defined results of every stage: nulls in any column are allowed; an id may be null or
repeated, and every stage decides by id and text, so that texts under one id don't share
their fate. Null and empty texts score and hash as empty texts, are never contaminated
and hold no secrets. Texts of any length are taken whole. Ties (repeated rows equal in
all columns) are kept or dropped alike, also by the stage for near duplicates, which
keeps one row of any others. Columns beyond those of documents pass through, whatever
their names. An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from claimloom.llm import decontaminate, hilbert_packing, quality_knn, secret_scan, simhash_vptree
from claimloom.plans.staging import drop_staged, new_path, released, stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_knn.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that of the smallest id, or one of those without ids."""
    return simhash_vptree.keep_one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages by the contamination rule go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; every document stays."""
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents are tokenized and packed along the curve."""
    return hilbert_packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("secrets_masked", secrets_masked),
    ("packed", packed),
]

#: The classifier, the component search and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and reread.

    What a stage wrote on its way goes once its result is written, and that once the next one's is.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, function in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        with released(spark):
            docs = stage(function(spark, docs, sf_dir), name, path).df
        if before:
            drop_staged(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
