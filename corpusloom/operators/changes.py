"""Changes between two snapshots of a file tree. Files are keyed by (project, rel_path)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stash

KEY = ["project", "rel_path"]


def content_sha256(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def sampled_signature(content: Column, whole: int = 65536, samples: int = 16, size: int = 4096) -> Column:
    """The digest of a short content, else of its size and of samples at even places, each behind its place."""
    data = content.cast("binary")
    n = F.octet_length(data)
    start = lambda i: F.floor((n - size) * i / (samples - 1)).cast("long")
    long8 = lambda x: F.unhex(F.lpad(F.hex(x.cast("long")), 16, "0"))
    parts = [F.concat(long8(start(i)), F.substring(data, (start(i) + 1).cast("int"), F.lit(size))) for i in range(samples)]
    return F.when(n <= whole, F.sha2(data, 256)).otherwise(F.sha2(F.concat(long8(n), *parts), 256))


def snapshot_diff(prev: DataFrame, cur: DataFrame, mode: str = "INCREMENTAL") -> DataFrame:
    """(project, rel_path, change_type, old_rel_path, size, sha256) of all files of both snapshots (project, rel_path,
    size, sha256). Equal content is UNCHANGED whatever its time; FULL takes every known path as MODIFIED. Rows of cur
    without a size could not be read: they are left out, and their files are not DELETED. A vanished file whose
    content stands under a new path is RENAMED there (one to one, by path order)."""
    unread = cur.filter(F.col("size").isNull()).select(*KEY)
    p = prev.join(unread, KEY, "left_anti").select(*KEY, F.lit(True).alias("had"), F.col("sha256").alias("old_sha"), F.col("size").alias("old_size"))
    c = cur.filter(F.col("size").isNotNull()).select(*KEY, F.lit(True).alias("has"), "sha256", "size")
    change = F.when(F.col("had").isNull(), "ADDED").when(F.col("has").isNull(), "DELETED")
    change = change.when(F.lit(mode == "FULL") | ~F.col("sha256").eqNullSafe(F.col("old_sha")), "MODIFIED").otherwise("UNCHANGED")
    out = p.join(c, KEY, "full_outer").select(*KEY, change.alias("change_type"), F.lit(None).cast("string").alias("old_rel_path"), F.coalesce("size", "old_size").alias("size"), F.coalesce("sha256", "old_sha").alias("sha256"))
    return rename_detect(out)


def rename_detect(changes: DataFrame) -> DataFrame:
    """changes with each pair of an ADDED and a DELETED file of equal content as one RENAMED row.

    The k-th added path of a content meets its k-th deleted one. Ranks come from range partitions, so that a content
    that half of all files have is not one task's."""
    from ..sources.files import rank_in_groups

    moved = changes.filter(F.col("change_type").isin("ADDED", "DELETED") & F.col("sha256").isNotNull()).select("project", "sha256", "change_type", "rel_path")
    ranked = stash(rank_in_groups(moved, ["project", "sha256", "change_type"], ["rel_path"], "k"), "moved")
    at = lambda kind, path: ranked.filter(F.col("change_type") == kind).select("project", "sha256", F.col("rel_path").alias(path), "k")
    pairs = at("ADDED", "new_path").join(at("DELETED", "gone_path"), ["project", "sha256", "k"]).select("project", "new_path", "gone_path")
    gone = pairs.select("project", F.col("gone_path").alias("rel_path"), F.lit("DELETED").alias("change_type"))
    left = changes.join(gone, ["project", "rel_path", "change_type"], "left_anti")
    new = pairs.select("project", F.col("new_path").alias("rel_path"), F.lit("ADDED").alias("change_type"), "gone_path")
    found = left.join(new, ["project", "rel_path", "change_type"], "left")
    renamed = F.col("gone_path").isNotNull()
    return found.select("project", "rel_path", F.when(renamed, "RENAMED").otherwise(F.col("change_type")).alias("change_type"), F.coalesce("gone_path", "old_rel_path").alias("old_rel_path"), "size", "sha256")


def apply_snapshot(assets: DataFrame, changes: DataFrame, scan_id: int) -> DataFrame:
    """The file table after a scan: (project, rel_path, size, sha256, parse_status, summary, doc_type, first_seen_scan,
    last_seen_scan, deleted). Changed content resets what was derived from it; a renamed file keeps it."""
    old = assets.select("project", F.col("rel_path").alias("was"), "parse_status", "summary", "doc_type", "first_seen_scan", F.col("last_seen_scan").alias("seen"))
    c = changes.withColumn("was", F.coalesce("old_rel_path", "rel_path"))
    j = c.join(old, ["project", "was"], "left")
    fresh, gone = F.col("change_type").isin("MODIFIED", "ADDED"), F.col("change_type") == "DELETED"
    keep = lambda n: F.when(fresh, F.lit(None)).otherwise(F.col(n)).alias(n)
    return j.select(
        "project", "rel_path", "size", "sha256", F.when(fresh, "PENDING").otherwise(F.col("parse_status")).alias("parse_status"), keep("summary"), keep("doc_type"),
        F.coalesce(F.col("first_seen_scan"), F.lit(scan_id).cast("long")).alias("first_seen_scan"), F.when(gone, F.col("seen")).otherwise(F.lit(scan_id).cast("long")).alias("last_seen_scan"), gone.alias("deleted"),
    )


def change_summary(changes: DataFrame) -> DataFrame:
    """(change_type, n) and a row 'CHANGED' for all but UNCHANGED."""
    by = changes.groupBy("change_type").agg(F.count(F.lit(1)).alias("n"))
    return by.unionByName(by.agg(F.lit("CHANGED").alias("change_type"), F.coalesce(F.sum(F.when(F.col("change_type") != "UNCHANGED", F.col("n"))), F.lit(0)).alias("n")))


def scan_change_log(changes: DataFrame, scan_id: int) -> DataFrame:
    """Rows to append to the log of changes: all but UNCHANGED."""
    return changes.filter("change_type != 'UNCHANGED'").select(F.lit(scan_id).cast("long").alias("scan_id"), *KEY, "change_type", "old_rel_path", F.col("size").alias("file_size"), "sha256")


def changes_by_scan(log: DataFrame, scan_id: int) -> DataFrame:
    return log.filter(F.col("scan_id") == scan_id).orderBy("change_type", "rel_path")


def changes_by_project(log: DataFrame, project: str) -> DataFrame:
    return log.filter(F.col("project") == project).orderBy(F.desc("scan_id"), F.desc("rel_path"))


def purge_deleted_derived(derived: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows derived from files that are not DELETED."""
    return derived.join(changes.filter("change_type = 'DELETED'").select(*KEY), KEY, "left_anti")


def purge_stale_evidence(edges: DataFrame, chunks: DataFrame, changes: DataFrame) -> DataFrame:
    """edges without entity relations whose evidence chunk belongs to a MODIFIED or DELETED file."""
    changed = changes.filter(F.col("change_type").isin("MODIFIED", "DELETED")).select(*KEY)
    stale = chunks.join(changed, KEY, "left_semi").select(F.col("chunk_id").alias("evidence_chunk_id"), F.lit("ENTITY_REL").alias("edge_type"))
    return edges.join(stale, ["evidence_chunk_id", "edge_type"], "left_anti")


def parse_candidates(files: DataFrame, changes: DataFrame) -> DataFrame:
    """Added or modified files that hold text."""
    new = changes.filter(F.col("change_type").isin("ADDED", "MODIFIED")).select(*KEY)
    return files.filter(~F.col("category").isin("archive", "image")).join(new, KEY, "left_semi")


def purge_project(tables: dict[str, DataFrame], project: str, runs: DataFrame) -> dict[str, DataFrame]:
    """Every table without the project's rows; refused while one of its scans is pending or running."""
    if not runs.filter((F.col("project") == project) & F.col("status").isin("PENDING", "RUNNING")).isEmpty():
        raise ValueError(f"project {project} is being scanned")
    return {n: t.filter(F.col("project") != project) for n, t in tables.items()}


def skip_if_unchanged(changes: DataFrame) -> bool:
    """Is there nothing to do after an incremental diff?"""
    return changes.filter("change_type != 'UNCHANGED'").isEmpty()


def duplicate_paths(files: DataFrame) -> DataFrame:
    """(project, sha256, n, place, rel_path): a row for each path of a content that more than one live file has, with the
    number of its paths and the path's place among them."""
    from ..sources.files import rank_in_groups

    live = files.filter("NOT deleted AND sha256 IS NOT NULL").select("project", "sha256", "rel_path")
    many = live.groupBy("project", "sha256").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = live.join(many, ["project", "sha256"])
    return rank_in_groups(rows, ["project", "sha256"], ["rel_path"], "place").select("project", "sha256", "n", "place", "rel_path")


def canonical_files(files: DataFrame) -> DataFrame:
    """One live file for each content: greatest relevance, then shortest path, then smallest id. Files without a digest
    all stay. An aggregate picks it, so copies are combined before they move."""
    live = files.filter("NOT deleted")
    best = live.filter("sha256 IS NOT NULL").groupBy("project", "sha256").agg(F.min_by("file_id", F.struct(-F.coalesce("relevance_score", F.lit(0.0)), F.length("rel_path"), F.col("file_id"))).alias("file_id"))
    kept = live.join(best.select("file_id"), "file_id", "left_semi")
    return kept.unionByName(live.filter("sha256 IS NULL"))
