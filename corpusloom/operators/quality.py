"""Drafts checked against their evidence, and versions compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import strip


def _found(text: Column, patterns: list[str], most: int) -> Column:
    every = [F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(0)), strip) for p in patterns]
    return F.slice(F.array_distinct(F.concat(*every)), 1, most)


def extract_facts(text: Column) -> Column:
    """Dates, addresses, links, amounts and codes, in that order; distinct, 40 at most."""
    return _found(text, rules.FACTS, 40)


def extract_assertions(text: Column) -> Column:
    return _found(text, rules.ASSERTIONS, 20)


def claim_form(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\s,，]", "")


def unsupported_claims(drafts: DataFrame, evidence: DataFrame, most: int = 12) -> DataFrame:
    """(artifact_id, n_claims, n_unsupported, unsupported): facts and strong claims that neither title, instructions nor
    evidence (artifact_id, excerpt) hold; the first `most` are listed."""
    e = evidence.groupBy("artifact_id").agg(F.array_join(F.array_sort(F.collect_list(F.coalesce("excerpt", F.lit("")))), "\n").alias("ev"), F.count(F.lit(1)).alias("n_evidence"))
    j = drafts.join(e, "artifact_id", "left")
    support = claim_form(F.concat_ws("\n", "title", "instructions", "ev"))
    claims = F.concat(extract_facts(F.col("content")), extract_assertions(F.col("content")))
    j = j.select("artifact_id", F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), claims.alias("c"), support.alias("s"))
    bad = F.array_distinct(F.filter("c", lambda x: ~F.contains(F.col("s"), claim_form(x))))
    return j.select("artifact_id", "n_evidence", F.size("c").alias("n_claims"), F.least(F.size(bad), F.lit(most)).alias("n_unsupported"), F.array_join(F.slice(bad, 1, most), " | ").alias("unsupported"))


def completeness(text: Column) -> Column:
    t = strip(F.coalesce(text, F.lit("")))
    fences = F.size(F.filter(F.split(t, r"\R"), lambda x: F.startswith(strip(x), F.lit("```"))))
    cut = F.rlike(t, F.lit(r"(?:\.\.\.|……|，|,)$"))
    s = 100 - F.when(F.length(t) < 120, 25).otherwise(0) - F.when(cut, 30).otherwise(0) - F.when(fences % 2 == 1, 40).otherwise(0)
    return F.when(t == "", 0).otherwise(F.greatest(F.lit(0), s))


def pending_items(text: Column) -> Column:
    """Lines with an open item; bare headings for open items do not count."""
    plain = F.transform(F.split(F.coalesce(text, F.lit("")), r"\R"), lambda x: strip(F.regexp_replace(strip(x), r"^[#>*\-\s]+", "")))
    return F.size(F.filter(plain, lambda x: ~x.isin(*rules.PENDING_TITLES) & F.rlike(x, F.lit(rules.PENDING))))


def mojibake(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return (F.regexp_count(t, F.lit(r"[\x80-\x9f]")) >= 2) | (F.regexp_count(t, F.lit(rules.MOJIBAKE)) >= 3)


def quality_score(drafts: DataFrame, evidence: DataFrame) -> DataFrame:
    """(artifact_id, completeness, coverage, pending, damaged, n_unsupported, status)."""
    c = unsupported_claims(drafts, evidence)
    j = drafts.select("artifact_id", completeness(F.col("content")).alias("completeness"), pending_items(F.col("content")).alias("pending"), mojibake(F.col("content")).alias("damaged")).join(c, "artifact_id")
    share = F.greatest(F.lit(0), F.floor(100.0 * (F.col("n_claims") - F.col("n_unsupported")) / F.col("n_claims") + 0.5).cast("int"))
    coverage = F.when(F.col("n_evidence") == 0, 0).when(F.col("n_claims") == 0, F.when(F.col("n_evidence") >= 2, 100).otherwise(80)).otherwise(share)
    warned = (F.col("pending") > 0) | (F.col("n_unsupported") > 0) | (F.col("n_evidence") == 0)
    status = F.when((F.col("completeness") < 60) | F.col("damaged"), "FAILED").when(warned, "WARNING").otherwise("PASSED")
    return j.select("artifact_id", "completeness", coverage.alias("coverage"), "pending", "damaged", "n_unsupported", status.alias("status"))


def evidence_items(ranked: DataFrame, chunks: DataFrame, limit: int = 1200) -> DataFrame:
    """(artifact_id, rank, chunk_id, file_id, cell_range, excerpt)."""
    from ..sources.files import cell_range_of

    j = ranked.join(chunks, "chunk_id")
    return j.select("artifact_id", "rank", "chunk_id", "file_id", cell_range_of(F.substring("content", 1, limit)).alias("cell_range"), F.substring("content", 1, limit).alias("excerpt"))


def source_files(items: DataFrame, most: int = 12) -> DataFrame:
    """(artifact_id, file_id, place): distinct sources by their first rank."""
    w = Window.partitionBy("artifact_id").orderBy("rank", "file_id")
    first = items.groupBy("artifact_id", "file_id").agg(F.min("rank").alias("rank"))
    return first.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select("artifact_id", "file_id", "place")


def latest_versions(artifacts: DataFrame) -> DataFrame:
    """(root_id, artifact_id, version_no) of the newest live version of each root."""
    live = artifacts.filter("deleted_at IS NULL")
    best = live.groupBy("root_id").agg(F.max_by(F.struct("artifact_id", "version_no"), F.struct("version_no", "artifact_id")).alias("x"))
    return best.select("root_id", "x.*")


def next_version(artifacts: DataFrame) -> DataFrame:
    """(root_id, next_version): one above the greatest version there was, deleted ones included."""
    return artifacts.groupBy("root_id").agg((F.max("version_no") + 1).alias("next_version"))


def trash(artifacts: DataFrame) -> DataFrame:
    return artifacts.filter("deleted_at IS NOT NULL").orderBy(F.desc("deleted_at"), F.desc("artifact_id"))


def folder_counts(folders: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(folder, n): live artifacts in a folder or below. Each artifact is counted for every prefix of its path."""
    parts = F.split("rel_path", "/")
    up = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    n = artifacts.filter("deleted_at IS NULL").select(F.explode(up).alias("folder")).groupBy("folder").agg(F.count(F.lit(1)).alias("n"))
    return folders.join(n, "folder", "left").select("folder", F.coalesce("n", F.lit(0)).alias("n"))


def approval_gate(previewed: Column, status: Column) -> Column:
    return previewed.isNotNull() & status.isNotNull() & (status != "FAILED")


def rewrite_paths(path: Column, old: str, new: str) -> Column:
    """Paths at or below folder old moved to folder new."""
    inside = (path == old) | F.startswith(path, F.lit(old + "/"))
    return F.when(inside, F.concat(F.lit(new), F.substring(path, F.lit(len(old) + 1), F.length(path)))).otherwise(path)


