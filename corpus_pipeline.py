"""Cleaning a corpus in four stages: quality rules, near-duplicate removal, substring dedup, packing.

Every stage takes all rows that the one before kept, written as Parquet and read again; all but the last
return the columns of ``documents``. Rows with null ids or texts and empty tables pass as the operators'
docstrings say; columns beyond doc_id and text are carried along.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm import jaccard, packing, quality, spans
from glossmill.llm.queries import tokenizer_path
from glossmill.plans.lineage import cut, ensure_checkpoint_dir, remove


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the quality rules; those they reject go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of documents that links of Jaccard similarity connect: the one of least id."""
    return jaccard.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated spans of sentences stay where they come first; n_chars follows the text."""
    mark = uuid.uuid4().hex
    kept = spans.remove_spans(docs, figures=(f"sentences_{mark}", f"removed_{mark}"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col(f"removed_{mark}") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents left, and their places in sequences."""
    return packing.pack(packing.pieces(docs, tokenizer_path("word_bpe_49k.json")))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("substring_dedup", substring_dedup), ("best_fit_packing", best_fit_packing)]

# Hashed n-grams, tokenizer files and packing are beyond SQL; tests/llm/test_pipeline.py compares run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    packed = cut(STAGES[-1][1](spark, docs, sf_dir))
    remove(spark, folder)
    return packed
