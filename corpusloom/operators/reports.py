"""Reports, lists and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scan_report(files: DataFrame, items: DataFrame, nodes: DataFrame, edges: DataFrame, scan_id: int, shown: int = 20) -> DataFrame:
    """(section, name, n, detail): parse states, new files, failed paths, endpoints, graph and risks of a scan.

    files: rel_path, parse_status, first_seen_scan; items: key_type, review_status; nodes: node_type; edges: edge_type."""
    none = F.lit(None).cast("string")

    def by(df: DataFrame, col: str, section: str) -> DataFrame:
        return df.groupBy(F.col(col).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(section).alias("section"), "name", "n", none.alias("detail"))

    failed = files.filter("parse_status = 'FAILED'")
    paths = failed.orderBy("rel_path").limit(shown).agg(F.array_join(F.array_sort(F.collect_list("rel_path")), "|").alias("detail"))
    count = lambda df, section, name, detail=none: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(section).alias("section"), F.lit(name).alias("name"), "n", detail.alias("detail"))
    risk = failed.agg(F.count(F.lit(1)).alias("n")).join(paths).select(F.lit("risk").alias("section"), F.lit("PARSE_FAILED").alias("name"), "n", "detail")
    parts = [by(files, "parse_status", "parse"), count(files.filter(F.col("first_seen_scan") == scan_id), "files", "NEW"), by(items, "key_type", "config_type"), by(items, "review_status", "config_status"), by(nodes, "node_type", "node"), by(edges, "edge_type", "edge"), risk, count(items.filter("review_status = 'PENDING'"), "risk", "UNCONFIRMED_CONFIG")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def scan_report_json(report: DataFrame) -> DataFrame:
    """(json): sections of name and number. A report has a few dozen rows, whatever the corpus' size."""
    rows = report.groupBy("section").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("name", F.lit("")), "n")))).alias("m"))
    return rows.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("section", F.to_json("m").alias("m")))))).alias("json"))


def file_list(files: DataFrame, doc_type: str | None = None, parse_status: str | None = None, page: int = 0, size: int = 20) -> DataFrame:
    out = files.filter("NOT deleted")
    out = out.filter(F.col("doc_type") == doc_type) if doc_type else out
    out = out.filter(F.col("parse_status") == parse_status) if parse_status else out
    size = min(size, 100)
    return out.orderBy("rel_path", "file_id").offset(page * size).limit(size)


def file_stats(files: DataFrame, missing: str = "(none)") -> DataFrame:
    return files.filter("NOT deleted").groupBy(F.coalesce("doc_type", F.lit(missing)).alias("doc_type")).agg(F.count(F.lit(1)).alias("n"))


def latest_report(reports: DataFrame) -> DataFrame:
    best = reports.groupBy("project").agg(F.max_by(F.struct("report_id", "created_at"), F.struct("created_at", "report_id")).alias("x"))
    return best.select("project", "x.*")


def visible_projects(projects: DataFrame, owned: DataFrame, admin: bool = False) -> DataFrame:
    return projects if admin else projects.join(owned.select("project").distinct(), "project", "left_semi")


def normalize_route(route: Column) -> Column:
    """Numbers and long keys in a path become '{id}' and '{key}'; null is 'unknown'."""
    out = F.regexp_replace(route, r"/[0-9]+(?=/|$)", "/{id}")
    return F.coalesce(F.regexp_replace(out, r"/[0-9a-fA-F-]{24,}(?=/|$)", "/{key}"), F.lit("unknown"))


def route_metrics(log: DataFrame) -> DataFrame:
    """(route, requests, errors, average_ms, max_ms) of (method, route, status, duration_ms); averages are truncated."""
    key = F.concat(F.col("method"), F.lit(" "), normalize_route(F.col("route")))
    by = log.groupBy(key.alias("route")).agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") >= 400).alias("errors"), F.sum("duration_ms").alias("total"), F.max("duration_ms").alias("max_ms"))
    return by.select("route", "requests", "errors", F.expr("total div requests").alias("average_ms"), "max_ms", "total")


def overall_metrics(routes: DataFrame) -> DataFrame:
    """(requests, errors, average_ms, exact_ms): the average weighs the routes' truncated averages, exact_ms the totals."""
    s = routes.agg(F.sum("requests").alias("requests"), F.sum("errors").alias("errors"), F.sum(F.col("requests") * F.col("average_ms")).alias("w"), F.sum("total").alias("t"))
    return s.select("requests", "errors", F.expr("w div requests").alias("average_ms"), (F.col("t") / F.col("requests")).alias("exact_ms"))


def recent_audits(log: DataFrame, n: int = 200) -> DataFrame:
    return log.orderBy(F.desc("ts"), F.desc("event_id")).limit(min(n, 200))


def scans_by_project(scans: DataFrame, project: str) -> DataFrame:
    return scans.filter(F.col("project") == project).orderBy(F.desc("created_at"), F.desc("scan_id"))


def recent_failures(log: DataFrame, n: int = 30) -> DataFrame:
    return log.filter((F.col("status") >= 500) | F.col("error").isNotNull()).orderBy(F.desc("ts"), F.desc("event_id")).limit(n)
