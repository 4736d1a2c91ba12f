"""The given tables in the shape the operators take, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changes import content_sha256, sampled_signature
from ..session import spread
from ..sources.files import file_category, file_ext


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A given table; those of texts over all cores, as a file of one row group is one task's otherwise."""
    t = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(t) if name in ("documents", "pages", "conversations") else t


def files(spark: SparkSession, d: str) -> DataFrame:
    """documents as files of a project (their source)."""
    t = table(spark, d, "documents")
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".md"))
    return t.select(
        F.col("doc_id").alias("file_id"), F.col("source").alias("project"), F.concat_ws("/", "source", "lang", name).alias("rel_path"), name.alias("name"), file_ext(name).alias("ext"), file_category(file_ext(name)).alias("category"),
        F.col("n_chars").alias("size"), F.col("doc_id").alias("mtime"), content_sha256(F.col("text")).alias("sha256"), "text", "lang", F.lit(False).alias("deleted"),
    )


FILES = "f AS (SELECT doc_id AS file_id, source AS project, source || '/' || lang || '/doc_' || doc_id || '.md' AS rel_path, 'doc_' || doc_id || '.md' AS name, n_chars AS size, sha256(text) AS sha256, text, lang FROM documents)"


def listings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two listings with texts: first the labelled documents; then all, without the toxic ones, bad ones with another
    text, good French ones under another path."""
    f = files(spark, d).select("file_id", "project", "rel_path", "size", "mtime", "text", "lang")
    lab = table(spark, d, "labels").select(F.col("doc_id").alias("file_id"), "quality", "toxic")
    digests = lambda df: df.withColumns({"sha256": content_sha256(F.col("text")), "content_signature": sampled_signature(F.col("text"))})
    cols = ["project", "rel_path", "size", "mtime", "text"]
    prev = digests(f.join(lab.select("file_id"), "file_id", "left_semi").select(cols))
    c = f.join(lab, "file_id", "left").filter("toxic IS NULL OR toxic = 0")
    text = F.when(F.col("quality") == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    path = F.when((F.col("lang") == "fr") & (F.col("quality") == 1), F.concat(F.lit("moved/"), "rel_path")).otherwise(F.col("rel_path"))
    return prev, digests(c.withColumns({"text": text, "rel_path": path}).select(cols))


def snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The listings' names, sizes and digests."""
    prev, cur = listings(spark, d)
    return prev.select("project", "rel_path", "size", "sha256"), cur.select("project", "rel_path", "size", "sha256")


SNAPSHOTS = (
    FILES
    + """,
prev AS (SELECT project, rel_path, size, sha256 FROM f WHERE file_id IN (SELECT doc_id FROM labels)),
cur AS (SELECT project, CASE WHEN lang = 'fr' AND quality = 1 THEN 'moved/' || rel_path ELSE rel_path END AS rel_path, size, CASE WHEN quality = 0 THEN sha256(text || '!') ELSE sha256 END AS sha256
  FROM f LEFT JOIN labels l ON l.doc_id = f.file_id WHERE toxic IS NULL OR toxic = 0),
raw AS (SELECT coalesce(c.project, p.project) AS project, coalesce(c.rel_path, p.rel_path) AS rel_path,
  CASE WHEN p.project IS NULL THEN 'ADDED' WHEN c.project IS NULL THEN 'DELETED' WHEN c.sha256 <> p.sha256 THEN 'MODIFIED' ELSE 'UNCHANGED' END AS change_type,
  coalesce(c.size, p.size) AS size, coalesce(c.sha256, p.sha256) AS sha256 FROM prev p FULL JOIN cur c ON p.project = c.project AND p.rel_path = c.rel_path),
k AS (SELECT *, row_number() OVER (PARTITION BY project, sha256, change_type ORDER BY rel_path) AS k FROM raw),
pairs AS (SELECT a.project, a.rel_path AS new_path, b.rel_path AS gone FROM k a JOIN k b ON a.project = b.project AND a.sha256 = b.sha256 AND a.k = b.k WHERE a.change_type = 'ADDED' AND b.change_type = 'DELETED'),
diff AS (SELECT r.project, r.rel_path, CASE WHEN n.gone IS NOT NULL THEN 'RENAMED' ELSE r.change_type END AS change_type, n.gone AS old_rel_path, r.size, r.sha256
  FROM raw r LEFT JOIN pairs n ON r.project = n.project AND r.rel_path = n.new_path AND r.change_type = 'ADDED'
  WHERE NOT (r.change_type = 'DELETED' AND (r.project, r.rel_path) IN (SELECT (project, gone) FROM pairs)))"""
)


def services(spark: SparkSession, d: str) -> DataFrame:
    """Line items as services (parts) that files (orders) mention."""
    t = table(spark, d, "lineitem")
    return t.select(
        F.lit("p").alias("project"), F.col("l_orderkey").alias("file_id"), F.concat(F.lit("o/"), F.col("l_orderkey").cast("string")).alias("rel_path"), F.lit("PART").alias("key_type"), F.col("l_partkey").cast("string").alias("key_value"),
        F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("context"), F.col("l_linenumber").alias("item_no"), F.when(F.col("l_returnflag") == "R", "REJECTED").otherwise("PENDING").alias("review_status"),
    )


SERVICES = "s AS (SELECT 'p' AS project, l_orderkey AS file_id, 'o/' || l_orderkey AS rel_path, 'PART' AS key_type, CAST(l_partkey AS VARCHAR) AS key_value, 'line ' || l_linenumber AS context, l_linenumber AS item_no, CASE WHEN l_returnflag = 'R' THEN 'REJECTED' ELSE 'PENDING' END AS review_status FROM lineitem)"


def customer_tree(spark: SparkSession, d: str) -> DataFrame:
    """Customers as files in directories (nations) of projects (regions)."""
    c, n, r = table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "region")
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select(F.col("r_name").alias("project"), F.concat(F.col("n_name"), F.lit("/"), F.col("c_name")).alias("rel_path"), F.col("c_name").alias("name"), F.col("c_custkey").alias("file_id"), F.lit(False).alias("deleted"), (F.col("c_acctbal") >= 0).alias("eligible"), F.col("c_mktsegment").alias("summary"))


TREE = "t AS (SELECT r_name AS project, n_name || '/' || c_name AS rel_path, n_name AS dir, c_name AS name, c_custkey AS file_id, c_acctbal >= 0 AS eligible, c_mktsegment AS summary FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def history(spark: SparkSession, d: str) -> DataFrame:
    """User turns with the assistant turn behind each, as questions with answers."""
    t = table(spark, d, "conversations")
    a = t.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    u = t.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    return u.join(a, ["conv_id", "turn"], "left")


HISTORY = "h AS (SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')"


def requests(spark: SparkSession, d: str) -> DataFrame:
    """events as a request log."""
    e = table(spark, d, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.lit("GET").alias("method"), F.concat(F.lit("/users/"), F.col("user_id").cast("string"), F.lit("/"), "event_type").alias("route"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), F.floor("value").cast("long").alias("duration_ms"), F.when(F.col("event_type") == "error", F.col("event_type")).alias("error"))


REQUESTS = "q AS (SELECT event_id, ts, 'GET /users/{id}/' || event_type AS route, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, CAST(floor(value) AS BIGINT) AS duration_ms FROM events)"
