"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_trie, cotrain, debruijn, html_extract, id_files, isolation, licenses, mixing, parity_join, pq_dedup, prefix_bpe, runs, warc


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    favour = mixing.magnitude(mixing.word_count(F.col("text")))
    return mixing.pareto_mix(docs, favour=favour).select("doc_id", "size", "source_size", "target", "taken")


def op5_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return prefix_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op2_context_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return id_files.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op3_product_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = isolation.quality_rules(docs, labels)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op7_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return cotrain.classify_quality(docs, labels)


def op8_license_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_de_bruijn_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = debruijn.repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", debruijn.span_words(F.col("spans")).alias("n_removed"), "kept_sha256")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), block=20, lent=4)


def planted_period(key: int | None, n: int) -> np.ndarray | None:
    """The places of the words of every tenth document (by checksum of its key), from some word on in a period."""
    h = zlib.crc32(str(key).encode())
    g = h // 10
    if key is None or h % 10 or not n:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


def period_columns(found: DataFrame) -> DataFrame:
    best = found.withColumn("__best", runs.strongest(F.col("runs")))
    start, length, period = (F.col(f"__best.{c}") for c in ("start", "length", "period"))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.expr("__best.length * 1000 div __best.period").alias("exponent_milli"),
        F.sha2(runs.listed(F.col("runs")).cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return period_columns(runs.collapse_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), order=planted_period))


QUERIES = {
    "op1_pareto_mix": op1_pareto_mix,
    "op2_context_coder": op2_context_coder,
    "op3_product_quantisation": op3_product_quantisation,
    "op4_isolation_forest": op4_isolation_forest,
    "op5_parity_sketch_join": op5_parity_sketch_join,
    "op6_prefix_bpe": op6_prefix_bpe,
    "op7_cotrained_quality": op7_cotrained_quality,
    "op8_license_paragraphs": op8_license_paragraphs,
    "op9_warc_revisits": op9_warc_revisits,
    "op10_host_suffix_array": op10_host_suffix_array,
    "op11_de_bruijn_repeats": op11_de_bruijn_repeats,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_periodic_runs": op13_periodic_runs,
}
#: The others cannot be said in SQL; their tests compare them with brute force or held-out labels.
ORACLES = {
    "op1_pareto_mix": mixing.ORACLE,
    "op3_product_quantisation": pq_dedup.ORACLE,
    "op9_warc_revisits": warc.ORACLE,
    "op11_de_bruijn_repeats": debruijn.ORACLE,
    "op12_conversation_trie": conversation_trie.ORACLE,
}
