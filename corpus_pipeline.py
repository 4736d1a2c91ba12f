"""From raw documents to token ids: quality classifier, quality rules, near-duplicate removal, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of documents.

Nulls, empty and very long texts, ties, repeated rows and empty tables are defined as the operators' docstrings say: a
null or empty text fails the base rules, rows that repeat a doc_id share its decisions but for the copies, of which one
stays; other columns pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import cotrain, isolation, mixing, parity_join, prefix_bpe
from corpusloom.session import bound_batches, stash


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    bound_batches(spark)
    return cotrain.keep_classified(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are anomalous to the isolation forest go."""
    bound_batches(spark)
    return isolation.keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one of the smallest doc_id stays."""
    bound_batches(spark)
    return parity_join.keep_first(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice. Longer documents are favoured."""
    return mixing.repeat_taken(docs, favour=mixing.magnitude(mixing.word_count(F.col("text"))))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers of ids and digests of ids and of the decoded bytes, a row for each copy in the mix."""
    bound_batches(spark)
    return prefix_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", source_mix),
    ("byte-level BPE", token_ids),
]

#: The classifier, the forest and BPE cannot be said in SQL; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
