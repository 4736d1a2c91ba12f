"""Nulls, empty and very long texts, repeated rows, null keys and columns of clashing names, at table level."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from corpusloom.llm import cotrain, isolation, parity_join, warc

SF = "/root/testdata/sf0.001"
RNG = random.Random(1)
PROSE = " ".join("".join(RNG.choice("abcdefghilmnorstu") for _ in range(RNG.randrange(2, 9))) for _ in range(60_000))
NEAR = PROSE.replace(" ", " changed ", 1)
ROWS = [(900_001, None), (900_002, ""), (900_003, " \n\t"), (900_004, PROSE), (900_005, NEAR), (900_006, "word " * 60_000), (None, PROSE[:5000]), (None, None), (900_007, PROSE[100:4000]), (900_007, PROSE[100:4000]), (900_008, "\n".join(["same line of words here"] * 3000))]
CLASH = ["size", "target", "kept", "quality", "component_id", "n_words", "key", "text_", "name", "p_bad"]


def odd(spark, columns):
    """ROWS as documents, with every other column null."""
    rows = spark.createDataFrame(ROWS, "doc_id long, text string")
    return rows.select(*(F.col(c) if c in ("doc_id", "text") else F.lit(None).cast(t).alias(c) for c, t in columns))


@pytest.fixture(scope="module")
def documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = docs.unionByName(odd(spark, docs.dtypes))
    return out.withColumns({c: F.lit("x") for c in CLASH})


def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_isolation(spark, documents):
    got = {(r["doc_id"], r["n_words"]): r for r in isolation.quality_rules(documents, labels(spark)).collect()}
    assert isolation.quality_rules(documents, labels(spark)).count() == documents.count()
    assert got[900_004, 60_000]["n_repeat_words"] == 0 and not got[900_004, 60_000]["base_failed"]
    assert got[900_006, 60_000]["n_repeat_words"] == 60_000 and got[900_006, 60_000]["base_failed"]
    assert got[900_008, 15_000]["n_dup_lines"] == 2999
    assert all(got[k, 0]["base_failed"] and not got[k, 0]["kept"] for k in (900_001, 900_002, 900_003, None))


def test_cotraining(spark, documents):
    got = cotrain.classify_quality(documents, labels(spark)).collect()
    assert len(got) == documents.count() and all(0 <= r["p_bad"] <= 1 for r in got)
    assert len({(r["p_bad"], r["kept"]) for r in got if r["doc_id"] == 900_007}) == 1
    assert cotrain.keep_classified(documents, labels(spark)).columns == documents.columns


def test_similar(spark, documents):
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in parity_join.similar_documents(documents).collect()}
    assert got[900_004, 59_996] == got[900_005, 59_997] == 900_004
    assert got[900_006, 1] == 900_006 and got[900_001, 0] == 900_001
    assert [c for (k, _), c in got.items() if k is None] == [None] * 2
    first = parity_join.keep_first(documents)
    assert first.columns == documents.columns
    kept = [r["doc_id"] for r in first.select("doc_id").collect()]
    assert kept.count(900_007) == 1 and 900_005 not in kept and kept.count(None) == 2


def test_archives(spark, tmp_path):
    long = "<p>" + PROSE * 8 + "</p>"
    df = spark.createDataFrame([(2, "u", long, "x"), (1, "v", long, "x"), (3, None, None, None), (None, "w", long[:200], "x")], "page_id long, url string, html string, payload_bytes string")
    got = {r["page_id"]: r for r in warc.round_trip(df, path=str(tmp_path / "w")).collect()}
    assert got[1]["record_type"] == "response" and (got[2]["record_type"], got[2]["refers_to"]) == ("revisit", 1)
    assert got[2]["payload_bytes"] == len(long) and got[2]["payload_digest"] == hashlib.sha256(long.encode()).hexdigest()
    assert got[3]["payload_bytes"] == 0 and got[None]["record_type"] == "response"


def test_pipeline(spark, documents, tmp_path):
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for name, stage in cp.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == columns, name
        assert docs.select("text").distinct().exceptAll(before.select("text").distinct()).count() == 0, name
        if name == "n-gram Jaccard join":
            left = [r["doc_id"] for r in docs.select("doc_id").collect()]
            assert not {900_001, 900_002, 900_003, 900_006} & set(left) and left.count(900_007) <= 1 and not {900_004, 900_005} <= set(left)
    ids = cp.STAGES[-1][1](spark, docs, str(tmp_path))
    assert ids.count() == docs.count() > 0
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
