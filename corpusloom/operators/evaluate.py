"""Scoring answers against golden questions and experiment cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip


def split_expectations(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[\n,，;；]"), strip), lambda x: x != ""))


def score_answers(golden: DataFrame, answers: DataFrame) -> DataFrame:
    """(question_id, keyword_coverage, source_coverage, score, passed, matched, missing): shares of expected keywords in
    the answer and of expected patterns in a cited file, 1 where nothing is expected."""
    files = F.transform(F.coalesce("citations", F.array().cast("array<struct<file_name:string>>")), lambda c: F.lower(c["file_name"]))
    j = golden.join(answers, "question_id").select(
        "question_id", F.lower(F.coalesce("answer", F.lit(""))).alias("a"), F.coalesce("grounded", F.lit(False)).alias("grounded"), files.alias("files"),
        split_expectations(F.col("expected_keywords")).alias("kw"), split_expectations(F.col("expected_source_patterns")).alias("src"),
    )
    hit = F.filter("kw", lambda k: F.contains(F.col("a"), F.lower(k)))
    found = F.filter("src", lambda s: F.exists("files", lambda f: F.contains(f, F.lower(s))))
    share = lambda x, of: F.when(F.size(of) == 0, 1.0).otherwise(F.size(x) / F.size(of))
    j = j.withColumn("k", share(hit, F.col("kw"))).withColumn("s", share(found, F.col("src")))
    score = 0.65 * F.col("k") + 0.25 * F.col("s") + F.when(F.col("grounded"), 0.1).otherwise(0.0)
    return j.select("question_id", F.col("k").alias("keyword_coverage"), F.col("s").alias("source_coverage"), score.alias("score"), (F.col("grounded") & (F.col("k") >= 0.7) & (F.col("s") >= 0.5)).alias("passed"), F.array_join(hit, ",").alias("matched"), F.array_join(F.array_except("kw", hit), ",").alias("missing"))


def evaluation_run(items: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """(total, passed, mean_score, status): FAILED if any answer is an outage of the provider (failures: provider_failure)."""
    out = items.agg(F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"), F.avg(F.col("score").cast("decimal(18,9)")).cast("double").alias("mean_score"))
    bad = F.lit(False) if failures is None else F.col("bad")
    out = out if failures is None else out.join(failures.agg(F.coalesce(F.bool_or("provider_failure"), F.lit(False)).alias("bad")))
    return out.select("total", "passed", "mean_score", F.when(bad, "FAILED").otherwise("COMPLETED").alias("status"))


def experiment_cases(cases: DataFrame, results: DataFrame) -> DataFrame:
    """(id, mode, seven checks, passed) of every case and mode; results (id, mode, answer, grounded, files, n_evidence).
    A missing expectation holds."""
    c = cases.select("*", F.explode("modes").alias("mode"))
    j = c.join(results, ["id", "mode"])
    low = F.lower(F.coalesce("answer", F.lit("")))
    has = lambda f, p: F.contains(F.lower(f), F.lower(p))
    none = lambda x: F.size(F.coalesce(x, F.array().cast("array<string>"))) == 0
    checks = {
        "grounded_ok": F.col("grounded"),
        "citations_ok": F.size("files") >= F.coalesce("minCitations", F.lit(0)),
        "evidence_ok": F.col("n_evidence") >= F.coalesce("minEvidence", F.lit(0)),
        "first_file_ok": F.col("expectedFirstFileContains").isNull() | F.coalesce(has(F.try_element_at("files", F.lit(1)), F.col("expectedFirstFileContains")), F.lit(False)),
        "any_file_ok": F.col("expectedAnyCitationFileContains").isNull() | F.exists("files", lambda f: has(f, F.col("expectedAnyCitationFileContains"))),
        "any_term_ok": none(F.col("mustContainAny")) | F.exists("mustContainAny", lambda t: F.contains(low, F.lower(t))),
        "all_terms_ok": none(F.col("mustContainAll")) | F.forall("mustContainAll", lambda t: F.contains(low, F.lower(t))),
    }
    cols = {n: F.coalesce(x, F.lit(False)) for n, x in checks.items()}
    out = j.select("id", "mode", *(x.alias(n) for n, x in cols.items()))
    passed = F.lit(True)
    for n in cols:
        passed = passed & F.col(n)
    return out.withColumn("passed", passed)


def latest_runs(runs: DataFrame, n: int = 20) -> DataFrame:
    w = Window.partitionBy("project").orderBy(F.desc("created_at"), F.desc("run_id"))
    return runs.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)
