"""Queries over whole texts, compared with brute force where their SQL does not reach."""

import hashlib

from corpusloom.plans import queries_files, queries_rag, registry  # noqa: F401


def sampled(data: bytes) -> str:
    n = len(data)
    if n <= 65536:
        return hashlib.sha256(data).hexdigest()
    places = [(n - 4096) * i // 15 for i in range(16)]
    return hashlib.sha256(n.to_bytes(8, "big") + b"".join(p.to_bytes(8, "big") + data[p : p + 4096] for p in places)).hexdigest()


def test_sampled_signature_of_every_text(spark, tmp_path):
    texts = ["", "a", "x" * 65536, "x" * 65537, "é" * 40_000, " ".join(map(str, range(40_000))), "é1 " * 30_001]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = dict(registry.QUERIES["sampled_signature"](spark, str(tmp_path)).collect())
    assert got == {i: sampled(t.encode()) for i, t in enumerate(texts)}


def test_relevance_scans_texts(spark, tmp_path):
    own, other = "die Öffnung der bildung", "and the caretion of it"
    texts = [(0, "src2", "en", own), (1, "src2", "en", other), (2, "src0", "en", other), (3, "src1", "de", "x" * 4990 + " the olderment"), (4, "src2", "en", "")]
    spark.createDataFrame(texts, "doc_id long, source string, lang string, text string").selectExpr("*", "length(text) n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: sorted(tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).collect())
    # src0 owns tion, src1 ment, src2 ung; the match in document 3 ends behind the part that is searched for phrases
    assert run("other_project_phrases_text") == [(1, "thecaretion")]
    assert run("anchor_score_text") == [(0, 1.45), (1, 0.0), (2, 1.0), (3, 1.45), (4, 0.0)]
    assert [r[1] for r in run("relevance_text")] == ["IN_SCOPE", "OUT_OF_SCOPE", "IN_SCOPE", "IN_SCOPE", "IN_SCOPE"]


def test_keyword_coverage_reads_documents(spark):
    rows = registry.QUERIES["keyword_coverage_ranked"](spark, "/root/testdata/sf0.001").collect()
    assert rows and sum(r.coverage > 0 for r in rows) > len(rows) / 2
