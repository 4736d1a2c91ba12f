"""Drafts and files of few names: most pairs are those of one name."""

from pyspark.sql import functions as F

from corpusloom.operators import evidence


def test_scope_by_names_and_numbers(spark, monkeypatch):
    monkeypatch.setattr(evidence, "PAIRS", 3)
    asks = ["仅使用 12、plan alpha 号文件", "只引用 plan alpha；其他", "只引用 7号 nothing", "仅使用 99、号", "no clause", "只引用 beta"]
    names = ["d/12_plan alpha.md", "d/12_other.md", "d/plan_alpha.md", "d/7x.md", "d/the beta file.md", "d/zz.md"]
    drafts = spark.createDataFrame([(i, asks[i % 6]) for i in range(30)], "artifact_id long, instructions string")
    files = spark.createDataFrame([(i, names[i % 6]) for i in range(18)], "file_id long, rel_path string")
    got = {}
    for r in evidence.evidence_scope(drafts, files).collect():
        got.setdefault(r.artifact_id, []).append(r.file_id)
    own = {0: [i for i in range(18) if i % 6 in (0, 1, 2)], 1: [i for i in range(18) if i % 6 in (0, 2)], 2: [i for i in range(18) if i % 6 == 3], 3: [None], 5: [i for i in range(18) if i % 6 == 4]}
    assert {k: sorted(v, key=str) for k, v in got.items() if k < 6} == {k: sorted(v, key=str) for k, v in own.items()}
    assert all(sorted(map(str, got[k])) == sorted(map(str, got[k % 6])) for k in got) and len(got) == 25


def test_pairs_are_dealt_and_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(evidence, "PAIRS", 1 << 18)
    name = F.element_at(F.array(F.lit("plan alpha"), F.lit("plan beta")), (F.col("id") % 2 + 1).cast("int"))
    drafts = spark.range(4000).select(F.col("id").alias("artifact_id"), F.concat(F.lit("只引用 "), name).alias("instructions"))
    files = spark.range(4000).select(F.col("id").alias("file_id"), F.concat(F.lit("d/"), name, F.lit(".md")).alias("rel_path"))
    made = evidence.evidence_scope(drafts, files).groupBy(F.spark_partition_id()).count()
    rows = [r["count"] for r in made.collect()]
    assert sum(rows) == 8_000_000 and len(rows) > 8 and max(rows) < 2_500_000
