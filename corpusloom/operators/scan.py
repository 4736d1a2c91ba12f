"""A scan in one call: fingerprints, changes, the file table, chunks, endpoints, graph and report, kept by scan.

Tables lie below one folder, each in a partition for every scan. files, nodes, edges and report are whole per scan; log,
chunks and items hold what a scan made new. Derived rows are keyed by (file_id, content_scan), the file and the scan that
last changed its content: a row is current while its file is live and has that content_scan, so nothing is deleted or
moved when files change, vanish or are renamed. A scan that is run again writes the same partitions again. Review
decisions are rows of their own and outlive the items that they were made for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path, stash
from ..sources.files import file_category, file_ext
from . import graph, reports
from .changes import KEY, content_sha256, sampled_signature, scan_change_log, snapshot_diff
from .chunks import line_chunks, parse_status
from .endpoints import carry_review_decisions, extract_endpoints

FILES = "file_id bigint, project string, rel_path string, size bigint, mtime bigint, sha256 string, content_signature string, parse_status string, first_seen_scan bigint, last_seen_scan bigint, content_scan bigint, deleted boolean"
TABLES = {
    "files": FILES,
    "log": "project string, rel_path string, change_type string, old_rel_path string, file_size bigint, sha256 string",
    "chunks": "file_id bigint, content_scan bigint, seq int, heading string, content string, token_count int",
    "items": "file_id bigint, content_scan bigint, key_type string, key_value string, context string, pattern_no int, start int",
    "nodes": "project string, node_key string, node_type string, label string",
    "edges": "project string, source_key string, target_key string, edge_type string, description string, weight double",
    "report": "section string, name string, n bigint, detail string",
}


def read_plan(listing: DataFrame, known: DataFrame, mode: str = "INCREMENTAL", signatures: bool = False) -> DataFrame:
    """The listing (project, rel_path, path, size, mtime) with `reads`: HASH for new files and for those whose size or time
    moved (all in a FULL scan), SIGN for the others if signatures are asked for, KEEP for those that stay closed."""
    old = known.filter("NOT deleted").select(*KEY, F.col("size").alias("__size"), F.col("mtime").alias("__mtime"), F.col("sha256").alias("__sha"), F.col("content_signature").alias("__sign"))
    moved = ~(F.col("size").eqNullSafe(F.col("__size")) & F.col("mtime").eqNullSafe(F.col("__mtime")))
    reads = F.when(F.lit(mode == "FULL") | F.col("__sha").isNull() | moved, "HASH")
    if signatures:
        reads = reads.when(F.col("__sign").isNull(), "HASH").otherwise("SIGN")
    return listing.join(old, KEY, "left").withColumn("reads", F.coalesce(reads, F.lit("KEEP")))


def _literal(path: str) -> str:
    """A path as a pattern that only it matches."""
    return "".join("\\" + c if c in "\\[]{}*?" else c for c in path)


def open_files(spark: SparkSession, paths: DataFrame, batch: int = 10_000) -> DataFrame:
    """(path, sha256, content_signature) of the files in paths (path): only these are opened.

    Spark's file index, which the listing comes from, is on the driver anyway; paths pass through it in batches, and the
    contents are read by the executors."""
    out, held = fresh_path(spark, "fingerprints"), []

    def flush() -> None:
        read = spark.read.format("binaryFile").load([_literal(p) for p in held])
        read.select("path", content_sha256(F.col("content")).alias("sha256"), sampled_signature(F.col("content")).alias("content_signature")).write.mode("append").parquet(out)
        held.clear()

    for row in paths.select("path").toLocalIterator():
        held.append(row["path"])
        if len(held) >= batch:
            flush()
    if held:
        flush()
    schema = "path string, sha256 string, content_signature string"
    try:
        return spark.read.schema(schema).parquet(out)
    except Exception as e:  # nothing was opened
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def fingerprints(spark: SparkSession, listing: DataFrame, known: DataFrame, mode: str = "INCREMENTAL", signatures: bool = False, read: Callable[[SparkSession, DataFrame], DataFrame] = open_files) -> DataFrame:
    """(project, rel_path, path, size, mtime, sha256, content_signature, reads) of a listing: metadata first, then the
    contents of those files that read_plan wants.

    A file with the size and time that it had keeps its digest unread. With signatures it is sampled too, and hashed
    anew where its signature differs; Spark's reader opens the whole file for that."""
    plan = stash(read_plan(listing, known, mode, signatures), "read-plan")
    got = read(spark, plan.filter("reads != 'KEEP'").select("path")).select(F.col("path").alias("__p"), F.col("sha256").alias("__new"), F.col("content_signature").alias("__newsign"))
    same = (F.col("reads") == "KEEP") | ((F.col("reads") == "SIGN") & F.col("__newsign").eqNullSafe(F.col("__sign")))
    out = plan.join(got, F.col("path") == F.col("__p"), "left")
    return out.select(*KEY, "path", "size", "mtime", F.when(same, F.col("__sha")).otherwise(F.col("__new")).alias("sha256"), F.when(F.col("reads") == "KEEP", F.col("__sign")).otherwise(F.col("__newsign")).alias("content_signature"), "reads")


def next_files(known: DataFrame, changes: DataFrame, listing: DataFrame, scan_id: int) -> DataFrame:
    """The file table after a scan. Changed content gets the scan's number as content_scan and is to be parsed; a renamed
    file keeps its file_id and all that hangs on it; vanished files stay as deleted rows, and what could not be read stays
    as it was."""
    scan = F.lit(scan_id).cast("long")
    live = known.filter("NOT deleted")
    old = live.select("project", F.col("rel_path").alias("__was"), *(F.col(c).alias(f"__{c}") for c in ("file_id", "mtime", "content_signature", "parse_status", "first_seen_scan", "last_seen_scan", "content_scan")))
    now = listing.select(*KEY, "mtime", "content_signature")
    c = changes.withColumn("__was", F.coalesce("old_rel_path", "rel_path")).join(old, ["project", "__was"], "left").join(now, KEY, "left")
    fresh, gone = F.col("change_type").isin("ADDED", "MODIFIED"), F.col("change_type") == "DELETED"
    seen = c.select(
        F.coalesce("__file_id", F.xxhash64("project", "rel_path", scan)).alias("file_id"), *KEY, F.col("size").cast("long").alias("size"), F.when(gone, F.col("__mtime")).otherwise(F.col("mtime")).alias("mtime"), "sha256",
        F.when(gone, F.col("__content_signature")).otherwise(F.col("content_signature")).alias("content_signature"), F.when(fresh, "PENDING").otherwise(F.col("__parse_status")).alias("parse_status"),
        F.coalesce("__first_seen_scan", scan).alias("first_seen_scan"), F.when(gone, F.col("__last_seen_scan")).otherwise(scan).alias("last_seen_scan"), F.when(fresh, scan).otherwise(F.col("__content_scan")).alias("content_scan"), gone.alias("deleted"),
    )
    told = changes.select(*KEY).unionByName(changes.filter("old_rel_path IS NOT NULL").select("project", F.col("old_rel_path").alias("rel_path"))).distinct()
    unread = live.join(told, KEY, "left_anti")
    # a path that is used again is a file of its own; the one that had it before stays deleted
    return seen.unionByName(unread).unionByName(known.filter("deleted"))


def _eligible(category: Column) -> Column:
    return ~category.isin("archive", "image")


class ScanStore:
    """The tables of one corpus below a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        """All scans' rows of a table with their scan_id; reviews have none."""
        schema = "file_id bigint, key_type string, key_value string, review_status string" if name == "reviews" else TABLES[name] + ", scan_id bigint"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as e:  # not written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def write(self, name: str, rows: DataFrame, scan_id: int) -> None:
        """Replaces the scan's partition of a table; no rows leave an empty one."""
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/scan_id={scan_id}")

    def last_scan(self, before: int | None = None) -> int | None:
        scans = self.table("files").select("scan_id")
        return (scans if before is None else scans.filter(F.col("scan_id") < before)).agg(F.max("scan_id")).first()[0]

    def files(self, scan_id: int | None = None) -> DataFrame:
        """The file table as a scan left it; the last one's if none is named."""
        scan_id = self.last_scan() if scan_id is None else scan_id
        return self.table("files").filter(F.col("scan_id") == F.lit(scan_id).cast("long")).drop("scan_id")

    def current(self, name: str, scan_id: int | None = None) -> DataFrame:
        """The chunks or items of live files, of their present contents, with project and rel_path."""
        f = self.files(scan_id).filter("NOT deleted").select("file_id", "content_scan", *KEY)
        return self.table(name).filter(F.col("scan_id") == F.col("content_scan")).drop("scan_id").join(f, ["file_id", "content_scan"])

    def items(self, scan_id: int | None = None) -> DataFrame:
        """Current items with the review_status that was decided for the file, type and value."""
        return carry_review_decisions(self.current("items", scan_id), self.table("reviews"))

    def review(self, decisions: DataFrame) -> None:
        """Adds decisions (file_id, key_type, key_value, review_status)."""
        decisions.select("file_id", "key_type", "key_value", "review_status").write.mode("append").parquet(f"{self.path}/reviews")

    def scan(self, listing: DataFrame, scan_id: int, mode: str = "INCREMENTAL") -> DataFrame:
        """Applies a listing (project, rel_path, size, mtime, sha256, content_signature, text) as a scan and returns its
        changes. Texts are read for changed files only. An incremental scan without changes makes no new rows but
        those of its file table, graph and report."""
        before = self.last_scan(scan_id)
        known = self.files(before) if before is not None else self.spark.createDataFrame([], FILES)
        known = stash(known, "known-files")
        meta = listing.select(*KEY, "size", "mtime", "sha256", "content_signature")
        changes = stash(snapshot_diff(known.filter("NOT deleted").select(*KEY, "size", "sha256"), meta.select(*KEY, "size", "sha256"), mode), "changes")
        files = stash(next_files(known, changes, meta, scan_id), "files")
        fresh = files.filter((F.col("content_scan") == scan_id) & ~F.col("deleted")).select("file_id", *KEY, file_category(file_ext(F.element_at(F.split("rel_path", "/"), -1))).alias("category"))
        texts = stash(fresh.join(listing.select(*KEY, "text"), KEY), "fresh-texts")
        state = F.when(_eligible(F.col("category")), parse_status(F.col("text"))).otherwise("SKIPPED")
        states = texts.select("file_id", F.lit(scan_id).cast("long").alias("content_scan"), state.alias("__state"))
        files = files.join(states, ["file_id", "content_scan"], "left").withColumn("parse_status", F.coalesce("__state", "parse_status")).select(known.columns)
        number = F.lit(scan_id).cast("long").alias("content_scan")
        self.write("chunks", line_chunks(texts.filter(_eligible(F.col("category")))).select("file_id", number, "seq", "heading", "content", "token_count"), scan_id)
        self.write("items", extract_endpoints(texts.filter(F.col("category").isin("doc", "config"))).select("file_id", number, "key_type", "key_value", "context", "pattern_no", "start"), scan_id)
        self.write("log", scan_change_log(changes, scan_id).drop("scan_id"), scan_id)
        # the file table comes last of these: a scan is known once it is there
        self.write("files", files, scan_id)
        self._graph_and_report(scan_id)
        return changes

    def _graph_and_report(self, scan_id: int) -> None:
        live = self.files(scan_id).filter("NOT deleted")
        named = live.select("project", "file_id", "rel_path", F.element_at(F.split("rel_path", "/"), -1).alias("name"), F.lit(None).cast("string").alias("summary"), F.lit(True).alias("eligible"), "deleted", "parse_status", "first_seen_scan")
        items = self.items(scan_id).withColumn("item_no", F.col("start"))
        typed = lambda df, kind: df.select("project", "node_key", F.lit(kind).alias("node_type"), "label")
        nodes = typed(graph.graph_file_nodes(named, items), "FILE").unionByName(typed(graph.graph_dir_nodes(named), "DIR")).unionByName(typed(graph.graph_service_nodes(items), "SERVICE"))
        edges = graph.edges_contains(named).unionByName(graph.edges_project_contains(named)).unionByName(graph.edges_mentions(items))
        self.write("nodes", nodes, scan_id)
        self.write("edges", edges, scan_id)
        made = lambda name: self.table(name).filter(F.col("scan_id") == scan_id)
        self.write("report", reports.scan_report(named, items, made("nodes"), made("edges"), scan_id), scan_id)
