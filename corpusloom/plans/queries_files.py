"""Queries of scanning, changes, chunks, classification and endpoints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as tx
from ..operators import changes, chunks, classify, endpoints
from ..session import fresh_path, spread
from ..sources import files as src
from .fixtures import FILES, SNAPSHOTS, files, snapshots, table
from .registry import query


@query("file_totals", "SELECT count(*) AS n_files, CAST(sum(n_chars) AS BIGINT) AS n_bytes, count(*) FILTER (n_chars >= 20000) AS n_large FROM documents")
def _(s, d):
    return src.file_totals(files(s, d), large=20000)


@query("ignore_filter", """SELECT page_id, rel_path FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS rel_path FROM pages)
WHERE NOT (starts_with(rel_path, 'de/') OR contains(rel_path, '/de/') OR ends_with(lower(rel_path), '.html') OR contains(regexp_extract(rel_path, '[^/]*$'), '77'))""")
def _(s, d):
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "")
    return src.ignore_filter(table(s, d, "pages").select("page_id", path.alias("rel_path")), src.ignore_rules(s, ["de/", "*.html", "# comment", "*.png", "77"]))


@query("file_category", """SELECT page_id, ext, CASE WHEN ext = 'html' THEN 'doc' ELSE 'other' END AS category FROM
(SELECT page_id, lower(regexp_extract(regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/]*$'), '^.+\\.([^.]+)$', 1)) AS ext FROM pages)""")
def _(s, d):
    name = F.regexp_extract(F.regexp_replace("url", r"[?#].*$", ""), r"[^/]*$", 0)
    ext = src.file_ext(name)
    return table(s, d, "pages").select("page_id", ext.alias("ext"), src.file_category(ext).alias("category"))


@query("parent_dir", f"WITH {FILES} SELECT file_id, regexp_replace(rel_path, '/[^/]*$', '') AS dir, lang AS label FROM f")
def _(s, d):
    p = src.parent_dir(F.col("rel_path"))
    return files(s, d).select("file_id", p.alias("dir"), src.dir_label(p).alias("label"))


def _page_text(html):
    """html_page_text as SQL; RE2 has no references back, so each element's kind is taken out by itself."""
    x = f"regexp_replace(coalesce({html}, ''), '(?s)<!--.*?-->', '', 'g')"
    for name in ("head", "script", "style"):
        x = rf"regexp_replace({x}, '(?is)<{name}\b.*?</{name}\s*>', '', 'g')"
    for n in range(1, 7):
        x = rf"regexp_replace({x}, '(?i)<h{n}\b[^>]*>', chr(10) || '{'#' * n} ', 'g')"
    x = rf"regexp_replace({x}, '(?i)<(?:br|/?(?:p|div|li|ul|ol|tr|table|section|article|nav|footer|header|h[1-6]))\b[^>]*>', chr(10), 'g')"
    x = f"regexp_replace({x}, '(?s)<[^>]*>', '', 'g')"
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{char}')"
    return rf"regexp_replace(regexp_replace(regexp_replace({x}, '[ \t]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[\s　]+|[\s　]+$', '', 'g')"


PAGES = f"pt AS (SELECT page_id, {_page_text('html')} AS text FROM pages)"


@query("html_page_text", f"WITH {PAGES} SELECT page_id, text FROM pt")
def _(s, d):
    return table(s, d, "pages").select("page_id", src.html_page_text(F.col("html")).alias("text"))


@query("enumerate_files", "SELECT source, count(*) FILTER (n_chars >= 0) > 0 AS found, CAST(sum(strlen(text) + 1) AS BIGINT) AS size FROM documents GROUP BY 1")
def _(s, d):
    # documents as text files below a folder for each source: what is listed has their bytes and line ends
    root = fresh_path(s, "tree")
    table(s, d, "documents").select("source", "text").write.partitionBy("source").text(root)
    found = src.enumerate_files(s, root).withColumn("source", F.regexp_extract("path", r"/source=([^/]*)/[^/]*$", 1))
    return found.groupBy("source").agg((F.count_if(F.col("mtime") > 0) > 0).alias("found"), F.sum("size").alias("size"))


@query("html_sanitize", f"""SELECT page_id, md5(CASE WHEN contains(h, '<head>') THEN replace(h, '<head>', '<head>' || c) ELSE c || h END) AS digest FROM
(SELECT page_id, $c${src.CSP}$c$ AS c, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>', '', 'g'), '(?is)</?(?:iframe|object|embed|link)\\b[^>]*>', '', 'g'),
 '(?is)\\son[a-z]+\\s*=\\s*(?:"[^"]*"|''[^'']*''|[^\\s>]+)', '', 'g'), '(?i)javascript:', '', 'g') AS h FROM pages)""")
def _(s, d):
    return table(s, d, "pages").select("page_id", F.md5(src.html_sanitize(F.col("html"))).alias("digest"))


@query("clean_text_noise", r"""WITH l AS (SELECT doc_id, generate_subscripts(a, 1) AS n, unnest(a) AS line FROM (SELECT doc_id, string_split(regexp_replace(text, '\n+$', ''), chr(10)) AS a FROM documents)),
k AS (SELECT doc_id, n, CASE WHEN trim(line, E' \t\r\n') = '' THEN '' ELSE regexp_replace(line, ' {2,}', ' ', 'g') END AS line FROM l WHERE NOT regexp_matches(trim(line), '^[A-Za-z0-9+/=]{81,}$'))
SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY n) || chr(10)) AS digest FROM k GROUP BY doc_id""")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(src.clean_text_noise(F.col("text"))).alias("digest"))


@query("rows_to_evidence", """SELECT r AS row_no, '[Suppliers!A' || r || ':C' || r || ']' AS cell_range, '[Suppliers!A' || r || ':C' || r || '] ' || s_suppkey || ' | ' || s_name || ' | ' || s_nationkey AS content
FROM (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS r FROM supplier)""")
def _(s, d):
    return src.rows_to_evidence(table(s, d, "supplier"), ["s_suppkey", "s_name", "s_nationkey"], "Suppliers", ["s_suppkey"], limit=None)


@query("cell_range_of", "SELECT s_suppkey, 'Suppliers!A' || s_suppkey || ':B' || s_suppkey AS cell_range FROM supplier")
def _(s, d):
    k = F.col("s_suppkey").cast("string")
    return table(s, d, "supplier").select("s_suppkey", src.cell_range_of(F.concat(F.lit("x [y] [Suppliers!A"), k, F.lit(":B"), k, F.lit("] z"))).alias("cell_range"))


@query("content_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", changes.content_sha256(F.col("text")).alias("digest"))


@query("sampled_signature", "SELECT doc_id, sha256(text) AS digest FROM documents WHERE strlen(text) <= 65536")
def _(s, d):
    # longer texts get the sampled digest, which the SQL leaves out; tests/test_whole_texts.py compares those
    return table(s, d, "documents").select("doc_id", changes.sampled_signature(F.col("text")).alias("digest"))


@query("snapshot_diff", f"WITH {SNAPSHOTS} SELECT project, rel_path, change_type, old_rel_path, size, sha256 FROM diff")
def _(s, d):
    return changes.snapshot_diff(*snapshots(s, d))


@query("snapshot_diff_full", f"WITH {SNAPSHOTS} SELECT project, rel_path, CASE WHEN change_type = 'UNCHANGED' THEN 'MODIFIED' ELSE change_type END AS change_type FROM diff")
def _(s, d):
    return changes.snapshot_diff(*snapshots(s, d), mode="FULL").select("project", "rel_path", "change_type")


@query("rename_detect", f"WITH {SNAPSHOTS} SELECT project, rel_path, old_rel_path FROM diff WHERE change_type = 'RENAMED'")
def _(s, d):
    return changes.snapshot_diff(*snapshots(s, d)).filter("change_type = 'RENAMED'").select("project", "rel_path", "old_rel_path")


def _assets(s, d):
    prev, cur = snapshots(s, d)
    old = prev.select("project", "rel_path", F.lit("PARSED").alias("parse_status"), F.lit("sum").alias("summary"), F.lit("note").alias("doc_type"), F.lit(1).cast("long").alias("first_seen_scan"), F.lit(1).cast("long").alias("last_seen_scan"))
    return old, changes.snapshot_diff(prev, cur)


@query("apply_snapshot", f"""WITH {SNAPSHOTS} SELECT project, rel_path, size, sha256, CASE WHEN change_type IN ('ADDED', 'MODIFIED') THEN 'PENDING' ELSE 'PARSED' END AS parse_status,
CASE WHEN change_type NOT IN ('ADDED', 'MODIFIED') THEN 'sum' END AS summary, CASE WHEN change_type NOT IN ('ADDED', 'MODIFIED') THEN 'note' END AS doc_type,
CASE WHEN change_type = 'ADDED' THEN 2 ELSE 1 END AS first_seen_scan, CASE WHEN change_type = 'DELETED' THEN 1 ELSE 2 END AS last_seen_scan, change_type = 'DELETED' AS deleted FROM diff""")
def _(s, d):
    old, diff = _assets(s, d)
    return changes.apply_snapshot(old, diff, 2)


@query("change_summary", f"WITH {SNAPSHOTS} SELECT change_type, count(*) AS n FROM diff GROUP BY 1 UNION ALL SELECT 'CHANGED', count(*) FROM diff WHERE change_type <> 'UNCHANGED'")
def _(s, d):
    return changes.change_summary(changes.snapshot_diff(*snapshots(s, d)))


@query("scan_change_log", f"WITH {SNAPSHOTS} SELECT 2 AS scan_id, project, rel_path, change_type, old_rel_path, size AS file_size, sha256 FROM diff WHERE change_type <> 'UNCHANGED'")
def _(s, d):
    return changes.scan_change_log(changes.snapshot_diff(*snapshots(s, d)), 2)


@query("changes_by_scan", f"WITH {SNAPSHOTS} SELECT change_type, rel_path, project FROM diff WHERE change_type <> 'UNCHANGED'")
def _(s, d):
    log = changes.scan_change_log(changes.snapshot_diff(*snapshots(s, d)), 2)
    return changes.changes_by_scan(log, 2).select("change_type", "rel_path", "project")


@query("changes_by_project", f"WITH {SNAPSHOTS} SELECT change_type, rel_path FROM diff WHERE change_type <> 'UNCHANGED' AND project = 'src0'")
def _(s, d):
    log = changes.scan_change_log(changes.snapshot_diff(*snapshots(s, d)), 2)
    return changes.changes_by_project(log, "src0").select("change_type", "rel_path")


@query("purge_deleted_derived", f"WITH {SNAPSHOTS} SELECT project, rel_path FROM prev WHERE (project, rel_path) NOT IN (SELECT (project, rel_path) FROM diff WHERE change_type = 'DELETED')")
def _(s, d):
    prev, cur = snapshots(s, d)
    return changes.purge_deleted_derived(prev.select("project", "rel_path"), changes.snapshot_diff(prev, cur))


@query("purge_stale_evidence", f"""WITH {SNAPSHOTS}, c AS (SELECT doc_id AS chunk_id, source AS project, source || '/' || lang || '/doc_' || doc_id || '.md' AS rel_path FROM documents),
e AS (SELECT doc_id AS evidence_chunk_id, CASE WHEN toxic = 1 THEN 'ENTITY_REL' ELSE 'MENTIONS' END AS edge_type FROM labels UNION ALL SELECT doc_id, CASE WHEN quality = 0 THEN 'ENTITY_REL' ELSE 'IMPORTS' END FROM labels)
SELECT * FROM e WHERE NOT (edge_type = 'ENTITY_REL' AND evidence_chunk_id IN (SELECT chunk_id FROM c WHERE (project, rel_path) IN (SELECT (project, rel_path) FROM diff WHERE change_type IN ('MODIFIED', 'DELETED'))))""")
def _(s, d):
    f, lab = files(s, d), table(s, d, "labels")
    c = f.select(F.col("file_id").alias("chunk_id"), "project", "rel_path")
    e = lab.select(F.col("doc_id").alias("evidence_chunk_id"), F.when(F.col("toxic") == 1, "ENTITY_REL").otherwise("MENTIONS").alias("edge_type"))
    e = e.unionByName(lab.select(F.col("doc_id").alias("evidence_chunk_id"), F.when(F.col("quality") == 0, "ENTITY_REL").otherwise("IMPORTS").alias("edge_type")))
    return changes.purge_stale_evidence(e, c, changes.snapshot_diff(*snapshots(s, d)))


@query("parse_candidates", f"WITH {SNAPSHOTS} SELECT file_id FROM f WHERE (project, rel_path) IN (SELECT (project, rel_path) FROM diff WHERE change_type IN ('ADDED', 'MODIFIED'))")
def _(s, d):
    return changes.parse_candidates(files(s, d), changes.snapshot_diff(*snapshots(s, d))).select("file_id")


@query("purge_project", f"WITH {FILES} SELECT 'files' AS part, project, file_id, rel_path AS value FROM f WHERE project <> 'src0' UNION ALL SELECT 'languages', project, file_id, lang FROM f WHERE project <> 'src0'")
def _(s, d):
    f = files(s, d)
    runs = f.select("project", F.lit("DONE").alias("status")).distinct()
    left = changes.purge_project({"files": f.withColumn("value", F.col("rel_path")), "languages": f.withColumn("value", F.col("lang"))}, "src0", runs)
    rows = [t.select(F.lit(n).alias("part"), "project", "file_id", "value") for n, t in left.items()]
    return rows[0].unionByName(rows[1])


@query("skip_if_unchanged", f"WITH {FILES} SELECT project, rel_path, 'UNCHANGED' AS change_type FROM f")
def _(s, d):
    cur = files(s, d).select("project", "rel_path", "size", "sha256")
    diff = changes.snapshot_diff(cur, cur)
    assert changes.skip_if_unchanged(diff)
    return diff.select("project", "rel_path", "change_type")


@query("duplicate_paths", f"WITH {FILES} SELECT project, sha256, count(*) OVER (PARTITION BY project, sha256) AS n, row_number() OVER (PARTITION BY project, sha256 ORDER BY rel_path) AS place, rel_path FROM f QUALIFY n > 1")
def _(s, d):
    return changes.duplicate_paths(files(s, d))


@query("canonical_files", f"WITH {FILES} SELECT file_id FROM (SELECT file_id, row_number() OVER (PARTITION BY project, sha256 ORDER BY coalesce(quality, 0) DESC, length(rel_path), file_id) AS r FROM f LEFT JOIN labels ON doc_id = file_id) WHERE r = 1")
def _(s, d):
    lab = table(s, d, "labels").select(F.col("doc_id").alias("file_id"), F.col("quality").cast("double").alias("relevance_score"))
    return changes.canonical_files(files(s, d).join(lab, "file_id", "left")).select("file_id")


CHUNKS = r"""RECURSIVE l AS (SELECT doc_id AS file_id, string_split(regexp_replace(text, '\n+$', ''), chr(10)) AS a FROM documents WHERE trim(text) <> ''),
w AS (SELECT file_id, a, 1 AS i, 0 AS n, 0 AS held FROM l UNION ALL SELECT file_id, a, i + 1, CASE WHEN held + length(a[i]) + 1 >= 1600 THEN n + 1 ELSE n END, CASE WHEN held + length(a[i]) + 1 >= 1600 THEN 0 ELSE held + length(a[i]) + 1 END FROM w WHERE i <= len(a)),
c AS (SELECT file_id, n AS seq, regexp_replace(string_agg(a[i], chr(10) ORDER BY i), '^[\s　]+|[\s　]+$', '', 'g') AS content, CAST(floor((sum(length(a[i]) + 1)) / 1.5) AS INTEGER) AS token_count FROM w WHERE i <= len(a) GROUP BY 1, 2)"""


@query("line_chunks", f"WITH {CHUNKS} SELECT file_id, seq, md5(content) AS digest, token_count FROM c WHERE content <> ''")
def _(s, d):
    return chunks.line_chunks(files(s, d)).select("file_id", "seq", F.md5("content").alias("digest"), "token_count")


# orders as texts with headings: a '#' line for each line item, then its figures
_ORDER = "concat('  ## Line ', l_linenumber, '  ', chr(10), 'part ', l_partkey, chr(10), chr(10), '```', chr(10), 'supplier ', l_suppkey, chr(10))"
ORDERS = "o AS (SELECT file_id, string_agg(part, '' ORDER BY n, part) AS text FROM (SELECT l_orderkey AS file_id, l_linenumber AS n, " + _ORDER + " AS part FROM lineitem) GROUP BY 1)"
HEADED = r"""RECURSIVE """ + ORDERS + r""", l AS (SELECT file_id, string_split(regexp_replace(text, '\n+$', ''), chr(10)) AS a FROM o),
w AS (SELECT file_id, a, 1 AS i, 0 AS n, 0 AS held FROM l UNION ALL SELECT file_id, a, i + 1, CASE WHEN held + length(a[i]) + 1 >= 60 THEN n + 1 ELSE n END, CASE WHEN held + length(a[i]) + 1 >= 60 THEN 0 ELSE held + length(a[i]) + 1 END FROM w WHERE i <= len(a)),
c AS (SELECT file_id, n AS seq, any_value(a) AS a, min(i) AS first, trim(string_agg(a[i], chr(10) ORDER BY i), E' \n') AS content FROM w WHERE i <= len(a) GROUP BY 1, 2),
h AS (SELECT file_id, seq, content, a[list_last(list_filter(range(1, first + 1), lambda j: starts_with(trim(a[j]), '#')))] AS line FROM c WHERE content <> '')"""


def order_texts(s, d):
    part = F.expr(_ORDER.replace("chr(10)", "'\n'"))
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("n"), part.alias("part"))
    return li.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda x: x["part"]), "").alias("text"))


@query("chunk_heading", f"WITH {HEADED} SELECT file_id, seq, trim(ltrim(trim(line), '#')) AS heading, md5(content) AS digest FROM h")
def _(s, d):
    return chunks.line_chunks(order_texts(s, d), limit=60).select("file_id", "seq", "heading", F.md5("content").alias("digest"))


@query("page_chunk_heading", f"WITH RECURSIVE {PAGES}, l AS (SELECT page_id AS file_id, string_split(text, chr(10)) AS a FROM pt WHERE text <> '')," + r"""
w AS (SELECT file_id, a, 1 AS i, 0 AS n, 0 AS held FROM l UNION ALL SELECT file_id, a, i + 1, CASE WHEN held + length(a[i]) + 1 >= 400 THEN n + 1 ELSE n END, CASE WHEN held + length(a[i]) + 1 >= 400 THEN 0 ELSE held + length(a[i]) + 1 END FROM w WHERE i <= len(a)),
c AS (SELECT file_id, n AS seq, any_value(a) AS a, min(i) AS first FROM w WHERE i <= len(a) GROUP BY 1, 2)
SELECT file_id, seq, regexp_replace(ltrim(a[list_last(list_filter(range(1, first + 1), lambda j: starts_with(a[j], '#')))], '#'), '^[\s　]+|[\s　]+$', '', 'g') AS heading FROM c""")
def _(s, d):
    pages = table(s, d, "pages").select(F.col("page_id").alias("file_id"), src.html_page_text(F.col("html")).alias("text"))
    return chunks.line_chunks(pages, limit=400).select("file_id", "seq", "heading")


@query("fixed_chunks", """SELECT conv_id, turn AS page_no, i AS seq, '第 ' || turn || ' 页' AS heading, md5(substr(text, i * 100 + 1, 100)) AS digest
FROM (SELECT *, unnest(range(0, CAST(ceil(length(text) / 100.0) AS BIGINT))) AS i FROM conversations WHERE trim(text) <> '')""")
def _(s, d):
    return chunks.fixed_chunks(table(s, d, "conversations"), "conv_id", "turn", size=100).select("conv_id", "page_no", "seq", "heading", F.md5("content").alias("digest"))


@query("overlap_chunks", "SELECT file_id, i AS seq, md5(substr(text, i * 1050 + 1, 1200)) AS digest FROM (SELECT doc_id AS file_id, text, unnest(range(0, (length(text) - 1) // 1050 + 1)) AS i FROM documents WHERE length(text) > 0)")
def _(s, d):
    return chunks.overlap_chunks(files(s, d)).select("file_id", "seq", F.md5("content").alias("digest"))


@query("split_sections", "SELECT l_orderkey AS file_id, section, 'Line ' || n AS title, md5('part ' || p || chr(10) || 'supplier ' || u) AS digest FROM (SELECT l_orderkey, l_linenumber AS n, l_partkey AS p, l_suppkey AS u, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, " + _ORDER + ") AS section FROM lineitem)")
def _(s, d):
    return chunks.split_sections(order_texts(s, d)).select("file_id", "section", "title", F.md5("content").alias("digest"))


@query("page_sections", f"WITH {PAGES}, " + r"""l AS (SELECT page_id AS file_id, unnest(a) AS line, generate_subscripts(a, 1) AS n FROM (SELECT page_id, string_split(text, chr(10)) AS a FROM pt)),
h AS (SELECT *, sum(CASE WHEN starts_with(line, '#') THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY n) AS section FROM l)
SELECT file_id, section::BIGINT AS section, coalesce(max(CASE WHEN starts_with(line, '#') THEN regexp_replace(line, '^#+\s*', '') END), 'Document') AS title, md5(string_agg(line, chr(10) ORDER BY n) FILTER (NOT starts_with(line, '#'))) AS digest
FROM h WHERE line <> '' AND NOT starts_with(line, '```') GROUP BY 1, 2 HAVING count(*) FILTER (NOT starts_with(line, '#')) > 0""")
def _(s, d):
    pages = table(s, d, "pages").select(F.col("page_id").alias("file_id"), src.html_page_text(F.col("html")).alias("text"))
    return chunks.split_sections(pages).select("file_id", "section", "title", F.md5("content").alias("digest"))


@query("token_estimate", "SELECT doc_id, CAST(floor(length(text) / 1.5) AS INTEGER) AS tokens FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


@query("parse_status", r"SELECT doc_id, CASE WHEN regexp_replace(coalesce(text, ''), '\s', '', 'g') = '' THEN 'FAILED' ELSE 'PARSED' END AS status FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", chunks.parse_status(F.col("text")).alias("status"))


@query("chunk_with_source", f"WITH {CHUNKS} SELECT c.file_id, seq, source || '/' || lang || '/doc_' || doc_id || '.md' AS rel_path FROM c JOIN documents ON doc_id = c.file_id WHERE content <> ''")
def _(s, d):
    f = files(s, d)
    return chunks.chunk_with_source(chunks.line_chunks(f), f).select("file_id", "seq", "rel_path")


@query("chunks_of_file", f"WITH {CHUNKS} SELECT file_id, seq FROM c WHERE content <> '' AND file_id = (SELECT max(file_id) FROM (SELECT file_id FROM c GROUP BY 1 ORDER BY count(*) DESC, file_id DESC LIMIT 1))")
def _(s, d):
    c = chunks.line_chunks(files(s, d))
    longest = c.groupBy("file_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("file_id")).first()
    return chunks.chunks_of_file(c, longest["file_id"]).select("file_id", "seq")


LATIN_TYPES = [("report", ["the and", "of the"]), ("note", ["que", "der "])]


@query("doc_type", f"""WITH {FILES} SELECT file_id, CASE WHEN contains(h, 'the and') OR contains(h, 'of the') THEN 'report' WHEN contains(h, 'que') OR contains(h, 'der ') THEN 'note' ELSE '说明文档' END AS doc_type
FROM (SELECT file_id, lower(rel_path || chr(10) || substr(text, 1, 4000)) AS h FROM f)""")
def _(s, d):
    return files(s, d).select("file_id", classify.doc_type(F.col("rel_path"), F.col("text"), F.col("ext"), LATIN_TYPES).alias("doc_type"))


@query("doc_tags", f"""WITH {FILES} SELECT file_id, nullif(concat_ws(',', CASE WHEN contains(h, 'licen') OR contains(h, 'apache') THEN 'legal' END, CASE WHEN contains(h, '@') THEN 'mail' END, CASE WHEN contains(h, 'idiot') THEN 'rude' END), '') AS tags
FROM (SELECT file_id, lower(rel_path || chr(10) || text) AS h FROM f)""")
def _(s, d):
    rules = [("legal", ["licen", "apache"]), ("mail", ["@"]), ("rude", ["idiot"])]
    return files(s, d).select("file_id", F.array_join(classify.doc_tags(F.col("rel_path"), F.col("text"), F.lit(None).cast("string"), rules), ",").alias("tags"))


def _projects(s, d):
    n = table(s, d, "nation")
    return n.select(F.col("n_name").alias("project"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("code"), F.col("n_name").alias("name"), F.concat(F.lit("/data/12"), F.col("n_name")).alias("root_path"))


@query("project_anchors", """WITH n AS (SELECT n_name AS project, regexp_replace(lower(n_name), '[^\\p{L}\\p{N}]+', '', 'g') AS x, 'n' || n_nationkey AS code FROM nation),
a AS (SELECT project, x AS anchor, true AS strong FROM n UNION SELECT project, right(x, k), true FROM n, range(4, 9) t(k) WHERE length(x) >= k UNION SELECT project, right(x, 3), false FROM n UNION SELECT project, code, false FROM n)
SELECT DISTINCT project, anchor, strong FROM a WHERE length(anchor) >= 3 AND NOT regexp_matches(anchor, '^\\d+$')""")
def _(s, d):
    return classify.project_anchors(_projects(s, d))


def _customer_files(s, d):
    c, n = table(s, d, "customer"), table(s, d, "nation")
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    path = F.concat(F.when(F.col("c_acctbal") < 0, "demo/").otherwise("x/"), F.when(F.col("c_mktsegment") == "BUILDING", F.col("n_name")).otherwise("none"), F.lit("/"), "c_name")
    return j.select(F.col("c_custkey").alias("file_id"), F.col("n_name").alias("project"), path.alias("rel_path"), F.col("c_name").alias("name"), F.lit("").alias("text"))


RELEVANCE = """n AS (SELECT n_nationkey, n_name AS project, regexp_replace(lower(n_name), '[^\\p{L}\\p{N}]+', '', 'g') AS x, 'n' || n_nationkey AS code FROM nation),
a AS (SELECT DISTINCT project, anchor, strong FROM (SELECT project, x AS anchor, true AS strong FROM n UNION SELECT project, right(x, k), true FROM n, range(4, 9) t(k) WHERE length(x) >= k UNION SELECT project, right(x, 3), false FROM n UNION SELECT project, code, false FROM n)
  WHERE length(anchor) >= 3 AND NOT regexp_matches(anchor, '^\\d+$')),
cf AS (SELECT c_custkey AS file_id, n_name AS project, CASE WHEN c_acctbal < 0 THEN 'demo/' ELSE 'x/' END || CASE WHEN c_mktsegment = 'BUILDING' THEN n_name ELSE 'none' END || '/' || c_name AS rel_path, c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey),
hay AS (SELECT file_id, project, rel_path, regexp_replace(lower(rel_path || chr(10) || name || chr(10)), '[^\\p{L}\\p{N}]+', '', 'g') AS h FROM cf),
sc AS (SELECT hay.file_id, hay.rel_path, coalesce(sum(CASE WHEN anchor IS NULL THEN 0 WHEN NOT strong THEN 45 WHEN length(anchor) >= 5 THEN 200 ELSE 100 END), 0) / 100 AS score FROM hay LEFT JOIN a ON a.project = hay.project AND contains(h, anchor) GROUP BY 1, 2),
rel AS (SELECT file_id, CASE WHEN starts_with(rel_path, 'demo/') AND score < 3 THEN 'REFERENCE' ELSE 'IN_SCOPE' END AS status,
  CASE WHEN starts_with(rel_path, 'demo/') AND score < 3 THEN greatest(score, 0.35) WHEN score >= 1 THEN least(1.0, score / 6.0) ELSE 0.45 END AS score,
  CASE WHEN starts_with(rel_path, 'demo/') AND score < 3 THEN 'REFERENCE_MATERIAL' WHEN score >= 1 THEN 'PROJECT_CORE' ELSE 'PROJECT_ASSUMED' END AS scope_type FROM sc)"""


@query("anchor_score", f"WITH {RELEVANCE} SELECT file_id, CAST(score AS DOUBLE) AS score FROM sc")
def _(s, d):
    return classify.anchor_scores(_customer_files(s, d), classify.project_anchors(_projects(s, d)))


@query("relevance", f"WITH {RELEVANCE} SELECT file_id, status, CAST(score AS DOUBLE) AS score, scope_type FROM rel")
def _(s, d):
    return classify.relevance(_customer_files(s, d), classify.project_anchors(_projects(s, d)))


@query("fill_missing_relevance", f"WITH {RELEVANCE} SELECT cf.file_id, CASE WHEN c_acctbal >= 5000 THEN 'IN_SCOPE' ELSE status END AS status FROM cf JOIN customer ON c_custkey = cf.file_id JOIN rel ON rel.file_id = cf.file_id")
def _(s, d):
    bal = table(s, d, "customer").select(F.col("c_custkey").alias("file_id"), "c_acctbal")
    known = F.col("c_acctbal") >= 5000
    f = _customer_files(s, d).drop("text").join(bal, "file_id").select("file_id", "project", "rel_path", "name", F.lit(False).alias("deleted"), F.when(known, "IN_SCOPE").otherwise("").alias("status"), F.lit(1.0).alias("score"), F.when(known, "PROJECT_CORE").alias("scope_type"))
    return classify.fill_missing_relevance(f, classify.project_anchors(_projects(s, d))).select("file_id", "status")


@query("other_project_phrases", f"WITH {FILES} SELECT file_id, '智慧' || lang || '系统' AS phrase FROM f WHERE false")
def _(s, d):
    return classify.other_project_phrases(_customer_files(s, d), classify.project_anchors(_projects(s, d)))


# names of projects in Latin texts, and endings that name each source
LATIN_PHRASE = "(?:the|der|la|el) [a-z]{2,12}(?:tion|ment|ung|ción)"
ENDINGS = ["tion", "ment", "ung", "ción"]


def _source_anchors(s):
    n = F.col("id")
    strong = F.when(n % 3 == 0, F.array(F.lit("ening"))).otherwise(F.array().cast("array<string>"))
    strong = F.concat(F.array(F.element_at(F.array(*map(F.lit, ENDINGS)), (n % 4 + 1).cast("int"))), strong)
    a = s.range(100).select(F.concat(F.lit("src"), n.cast("string")).alias("project"), strong.alias("strong"), F.array(F.lit("der")).alias("weak"))
    return a.select("project", F.explode("strong").alias("anchor"), F.lit(True).alias("strong")).unionByName(a.select("project", F.explode("weak").alias("anchor"), F.lit(False).alias("strong")))


TEXT_RELEVANCE = f"""{FILES}, a AS (SELECT 'src' || k AS project, {ENDINGS}[k % 4 + 1] AS anchor, true AS strong FROM range(0, 100) t(k) UNION ALL SELECT 'src' || k, 'ening', true FROM range(0, 100) t(k) WHERE k % 3 = 0 UNION ALL SELECT 'src' || k, 'der', false FROM range(0, 100) t(k)),
hay AS (SELECT file_id, project, regexp_replace(lower(rel_path || chr(10) || name || chr(10) || substr(text, 1, {classify.SCORE_LIMIT})), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS h FROM f),
sc AS (SELECT hay.file_id, coalesce(sum(CASE WHEN anchor IS NULL THEN 0 WHEN NOT strong THEN 45 WHEN length(anchor) >= 5 THEN 200 ELSE 100 END), 0) / 100 AS score FROM hay LEFT JOIN a ON a.project = hay.project AND contains(h, anchor) GROUP BY 1),
ph AS (SELECT DISTINCT file_id, project, regexp_replace(lower(p), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS phrase FROM (SELECT file_id, project, unnest(regexp_extract_all(rel_path || chr(10) || name || chr(10) || substr(text, 1, {classify.PHRASE_LIMIT}), '{LATIN_PHRASE}')) AS p FROM f)),
oth AS (SELECT file_id, phrase FROM ph WHERE length(phrase) >= 5 AND NOT EXISTS (SELECT 1 FROM a WHERE a.project = ph.project AND length(anchor) >= CASE WHEN strong THEN 3 ELSE 4 END AND (contains(phrase, anchor) OR contains(anchor, phrase))))"""


@query("anchor_score_text", f"WITH {TEXT_RELEVANCE} SELECT file_id, CAST(score AS DOUBLE) AS score FROM sc")
def _(s, d):
    return classify.anchor_scores(files(s, d), _source_anchors(s))


@query("other_project_phrases_text", f"WITH {TEXT_RELEVANCE} SELECT file_id, phrase FROM oth")
def _(s, d):
    return classify.other_project_phrases(files(s, d), _source_anchors(s), pattern=LATIN_PHRASE)


@query("relevance_text", f"""WITH {TEXT_RELEVANCE} SELECT file_id, CASE WHEN o THEN 'OUT_OF_SCOPE' ELSE 'IN_SCOPE' END AS status, CAST(CASE WHEN o THEN least(score, 0.2) WHEN score >= 1 THEN least(1.0, score / 6.0) ELSE 0.45 END AS DOUBLE) AS score,
CASE WHEN o THEN 'OTHER_PROJECT' WHEN score >= 1 THEN 'PROJECT_CORE' ELSE 'PROJECT_ASSUMED' END AS scope_type FROM (SELECT sc.file_id, CAST(score AS DOUBLE) AS score, sc.file_id IN (SELECT file_id FROM oth) AS o FROM sc)""")
def _(s, d):
    return classify.relevance(files(s, d), _source_anchors(s), pattern=LATIN_PHRASE)


@query("eligibility", "SELECT doc_id, q IS NULL OR q = 'IN_SCOPE' AS eligible, coalesce(q = 'REFERENCE', false) AS reference, coalesce(q = 'OUT_OF_SCOPE', false) AS out_of_scope FROM (SELECT d.doc_id, CASE WHEN toxic = 1 THEN 'OUT_OF_SCOPE' WHEN quality = 0 THEN 'REFERENCE' WHEN quality = 1 THEN 'IN_SCOPE' END AS q FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)")
def _(s, d):
    j = table(s, d, "documents").select("doc_id").join(table(s, d, "labels"), "doc_id", "left")
    q = F.when(F.col("toxic") == 1, "OUT_OF_SCOPE").when(F.col("quality") == 0, "REFERENCE").when(F.col("quality") == 1, "IN_SCOPE")
    j = j.withColumn("q", q)
    return j.select("doc_id", classify.is_knowledge_eligible(F.col("q")).alias("eligible"), classify.is_reference(F.col("q")).alias("reference"), classify.is_out_of_scope(F.col("q")).alias("out_of_scope"))


# the given texts have no Han characters, so RE2's word boundary agrees with the JVM's; documents hold addresses only
IPS = r"""ip AS (SELECT DISTINCT doc_id AS file_id, 'IP_PORT' AS key_type, v AS key_value FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b(?:\d{1,3}\.){3}\d{1,3}(?::\d{2,5})?\b')) AS v FROM documents WHERE regexp_matches(text, '\d\.\d'))
  WHERE NOT regexp_matches(v, '^(127\.0\.0\.1|0\.0\.0\.0)') AND len(list_filter(string_split(split_part(v, ':', 1), '.'), lambda p: CAST(p AS INTEGER) > 255)) = 0
   AND (contains(v, ':') OR regexp_matches(v, '^(10\.|127\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)')))"""


@query("extract_endpoints", f"WITH {IPS} SELECT * FROM ip")
def _(s, d):
    # documents hold addresses only; config_endpoints has the other kinds
    return endpoints.extract_endpoints(files(s, d)).select("file_id", "key_type", "key_value")


@query("endpoint_matches", r"SELECT file_id, key_type, key_value, count(*) AS n FROM (SELECT doc_id AS file_id, 'IP_PORT' AS key_type, unnest(regexp_extract_all(text, '\b(?:\d{1,3}\.){3}\d{1,3}(?::\d{2,5})?\b')) AS key_value FROM documents WHERE regexp_matches(text, '\d\.\d')) WHERE NOT regexp_matches(key_value, '^(127\.0\.0\.1|0\.0\.0\.0)') GROUP BY 1, 2, 3")
def _(s, d):
    m = endpoints.endpoint_matches(files(s, d)).filter("key_type = 'IP_PORT'")
    return m.groupBy("file_id", "key_type", "key_value").agg(F.count(F.lit(1)).alias("n"))


@query("url_matches", r"SELECT page_id AS file_id, unnest(regexp_extract_all(url, '(?i)https?://[^\s\"''<>\[\]()]{5,200}')) AS key_value FROM pages")
def _(s, d):
    m = endpoints.endpoint_matches(table(s, d, "pages"), key="page_id", text="url").filter("key_type = 'URL'")
    return m.select(F.col("page_id").alias("file_id"), "key_value")


@query("endpoint_offsets", r"SELECT doc_id, string_agg(v, ',' ORDER BY i) AS found FROM (SELECT doc_id, unnest(a) AS v, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS a FROM documents)) GROUP BY 1")
def _(s, d):
    m = table(s, d, "documents").select("doc_id", "text", F.explode(tx.match_offsets(F.col("text"), "[0-9]+")).alias("m"))
    # what stands at an offset is the match
    there = F.expr("substring(text, m.start + 1, length(m.match))")
    return m.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("m.start", there.alias("x")))), lambda x: x["x"]), ",").alias("found"))


@query("page_endpoints", "SELECT page_id AS file_id, 'IP_PORT' AS key_type, '10.' || page_id % 256 || '.1.2:80' || page_id % 10 AS key_value FROM pages UNION ALL SELECT page_id, 'URL', 'https://svc' || page_id || '.corp/x' FROM pages")
def _(s, d):
    # the pages' own links are those of documentation sites; each gets two addresses that are none
    k = F.col("page_id")
    own = F.concat(F.lit("node 10."), (k % 256).cast("string"), F.lit(".1.2:80"), (k % 10).cast("string"), F.lit(" behind https://svc"), k.cast("string"), F.lit(".corp/x ,"))
    pages = table(s, d, "pages").select(k.alias("file_id"), F.concat_ws("\n", "url", src.html_page_text(F.col("html")), F.repeat(F.lit("plain words "), 20), own).alias("text"))
    return endpoints.extract_endpoints(pages).select("file_id", "key_type", "key_value")


def _items(s, d):
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.lit("PART").alias("key_type"), F.col("l_partkey").cast("string").alias("key_value"), F.col("l_linestatus").alias("context")).dropDuplicates(["file_id", "key_type", "key_value"])


@query("carry_review_decisions", """SELECT o AS file_id, p AS key_value, coalesce(r, 'PENDING') AS review_status FROM (SELECT l_orderkey AS o, CAST(l_partkey AS VARCHAR) AS p, max(CASE l_returnflag WHEN 'R' THEN 'REJECTED' WHEN 'A' THEN 'CONFIRMED' END) AS r FROM lineitem GROUP BY 1, 2)""")
def _(s, d):
    flag = F.when(F.col("l_returnflag") == "R", "REJECTED").when(F.col("l_returnflag") == "A", "CONFIRMED").otherwise("PENDING")
    before = table(s, d, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.lit("PART").alias("key_type"), F.col("l_partkey").cast("string").alias("key_value"), flag.alias("review_status"))
    return endpoints.carry_review_decisions(_items(s, d), before).select("file_id", "key_value", "review_status")


@query("refine_with_model_output", """WITH i AS (SELECT DISTINCT l_orderkey AS o, CAST(l_partkey AS VARCHAR) AS p FROM lineitem), m AS (SELECT o_orderkey AS o, CAST(o_custkey AS VARCHAR) AS v FROM orders WHERE o_orderstatus = 'F')
SELECT i.o AS file_id, i.p AS key_value FROM i LEFT JOIN m ON m.o = i.o WHERE m.v IS NULL OR contains(m.v, i.p) OR contains(i.p, m.v)""")
def _(s, d):
    items = _items(s, d).withColumn("context", F.lit("ctx"))
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("file_id"), F.lit("ctx").alias("context"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit('[{"value":"'), F.col("o_custkey").cast("string"), F.lit('"}]'))).otherwise("[]").alias("items_json"))
    return endpoints.refine_with_model_output(items, o).select("file_id", "key_value")


@query("config_stats", "SELECT l_returnflag AS key_type, count(*) AS n FROM lineitem GROUP BY 1")
def _(s, d):
    return endpoints.config_stats(table(s, d, "lineitem").select(F.col("l_returnflag").alias("key_type")))


@query("config_list", "SELECT file_id, key_value FROM (SELECT DISTINCT l_orderkey AS file_id, CAST(l_partkey AS VARCHAR) AS key_value FROM lineitem) ORDER BY key_value, file_id LIMIT 50 OFFSET 50")
def _(s, d):
    return endpoints.config_list(_items(s, d).withColumn("review_status", F.lit("PENDING")), kind="PART", status="PENDING", page=1, size=50).select("file_id", "key_value")


@query("bulk_review", "SELECT DISTINCT l_orderkey AS file_id, CAST(l_partkey AS VARCHAR) AS key_value, CASE WHEN max(CASE WHEN l_tax > 0.05 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey, l_partkey) = 1 THEN 'CONFIRMED' ELSE 'PENDING' END AS review_status FROM lineitem")
def _(s, d):
    ids = table(s, d, "lineitem").filter("l_tax > 0.05").select(F.col("l_orderkey").alias("file_id"), F.lit("PART").alias("key_type"), F.col("l_partkey").cast("string").alias("key_value"))
    return endpoints.bulk_review(_items(s, d).withColumn("review_status", F.lit("PENDING")), ids, "CONFIRMED").select("file_id", "key_value", "review_status")


@query("extract_scope", f"WITH {FILES} SELECT file_id FROM f LEFT JOIN labels ON doc_id = file_id WHERE coalesce(quality, 1) = 1")
def _(s, d):
    lab = table(s, d, "labels").select(F.col("doc_id").alias("file_id"), F.when(F.col("quality") == 0, "REFERENCE").otherwise("IN_SCOPE").alias("status"))
    return endpoints.extract_scope(files(s, d).join(lab, "file_id", "left")).select("file_id")


def _list(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _holds(column, values):
    return f"len(list_filter({_list(values)}, lambda x: contains({column}, x))) > 0"


# line items as endpoint values, some of them noise, with text around them
_VALUE = "CASE l_partkey % 8 WHEN 0 THEN concat('10.', l_suppkey % 300, '.', l_linenumber, '.', l_partkey % 256) WHEN 1 THEN concat(l_suppkey % 300, '.7.', l_linenumber, '.', l_partkey % 256, ':', 80 + l_linenumber) WHEN 2 THEN concat('db', l_suppkey, '.internal:', 5000 + l_linenumber) WHEN 3 THEN 'localhost:8080' WHEN 4 THEN concat('https://docs.spring.io/', l_partkey) WHEN 5 THEN concat('http://svc', l_suppkey, '.corp/api?q=', l_partkey, '\")`;') WHEN 6 THEN concat('172.', l_suppkey % 40, '.0.', l_linenumber) ELSE concat('your-host-', l_partkey, ',') END"
_KIND = "CASE WHEN l_partkey % 8 IN (0, 1, 6) THEN 'IP_PORT' WHEN l_partkey % 8 IN (4, 5) THEN 'URL' ELSE 'HOST_PORT' END"
_AROUND = "CASE l_suppkey % 5 WHEN 0 THEN 'An Example: use ' WHEN 1 THEN '部署 example at ' WHEN 2 THEN '请替换 this: ' WHEN 3 THEN '' ELSE 'plain text ' END"
VALUES = f"v AS (SELECT l_orderkey, l_linenumber, l_partkey, {_KIND} AS kind, {_VALUE} AS value, {_AROUND} AS around FROM lineitem)"
_IDS = ["l_orderkey", "l_linenumber", "l_partkey"]
_PLAIN_IP = """(len(string_split(split_part(value, ':', 1), '.')) = 4 AND len(list_filter(string_split(split_part(value, ':', 1), '.'), lambda p: coalesce(TRY_CAST(p AS INTEGER) BETWEEN 0 AND 255, false))) = 4
  AND (contains(value, ':') OR regexp_matches(value, '^(10\\.|127\\.|192\\.168\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.)')))""".replace("\\\\", "\\")


def _values(s, d):
    return table(s, d, "lineitem").select(*_IDS, F.expr(_KIND).alias("kind"), F.expr(_VALUE).alias("value"), F.expr(_AROUND).alias("around"))


@query("trim_trailing_punct", f"WITH {VALUES} SELECT l_orderkey, l_linenumber, l_partkey, rtrim(value, '`''\",);|\\') AS value FROM v")
def _(s, d):
    return _values(s, d).select(*_IDS, endpoints.trim_trailing_punct(F.col("value")).alias("value"))


@query("plausible_ip", f"WITH {VALUES} SELECT l_orderkey, l_linenumber, l_partkey, {_PLAIN_IP} AS ok FROM v")
def _(s, d):
    return _values(s, d).select(*_IDS, endpoints.plausible_ip(F.col("value")).alias("ok"))


@query("endpoint_noise", f"""WITH {VALUES} SELECT l_orderkey, l_linenumber, l_partkey, length(value) < 3 OR {_holds("lower(value)", rules.VALUE_MARKERS)} OR (kind = 'URL' AND {_holds("lower(value)", rules.DOC_DOMAINS)})
  OR (kind = 'HOST_PORT' AND (list_contains({_list(rules.HOST_BLACKLIST)}, split_part(lower(value), ':', 1)) OR regexp_matches(split_part(value, ':', 1), '^[0-9]+$'))) OR (kind = 'IP_PORT' AND NOT {_PLAIN_IP}) AS noise FROM v""")
def _(s, d):
    return _values(s, d).select(*_IDS, endpoints.endpoint_noise(F.col("kind"), F.col("value")).alias("noise"))


@query("example_context", f"""WITH {VALUES} SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN {_holds("lower(around)", rules.REAL_MARKERS)} THEN false WHEN {_holds("lower(around)", rules.EXAMPLE_MARKERS)} THEN true
  ELSE (starts_with(value, '192.168.') OR starts_with(value, '10.') OR starts_with(value, '172.')) AND {_holds("lower(around)", rules.REPLACE_MARKERS)} END AS example FROM v""")
def _(s, d):
    return _values(s, d).select(*_IDS, endpoints.example_context(F.col("around"), F.col("value")).alias("example"))


# a fence opens before every value, and closes again for odd line numbers
_FENCED = "concat(around, 'api call', chr(10), '```sh', chr(10), 'run', chr(10), CASE WHEN l_linenumber % 2 = 1 THEN concat('```', chr(10)) ELSE '' END, value)"


@query("example_code_block", f"""WITH {VALUES}, b AS (SELECT *, {_FENCED.replace(", value)", ")")} AS before FROM v), k AS (SELECT *, l_linenumber % 2 = 0 AS open, lower(CASE WHEN l_linenumber % 2 = 0 THEN split_part(before, '```', 1) ELSE before END) AS lead FROM b)
SELECT l_orderkey, l_linenumber, l_partkey, open AND (contains(right(lead, 160), 'api') OR contains(right(lead, 160), 'example')) AS fenced FROM k""")
def _(s, d):
    v = _values(s, d)
    text = F.expr(_FENCED.replace("chr(10)", "'\n'"))
    start = F.length(text) - F.length("value")
    return v.select(*_IDS, endpoints.example_code_block(text, start, F.col("around")).alias("fenced"))


@query("endpoint_context", """WITH p AS (SELECT conv_id, turn, 'head' || chr(10) || '## part ' || turn || chr(10) || text || chr(10) || '# next ' || text AS t, length('head## part ') + 2 + length(CAST(turn AS VARCHAR)) + length(text) // 2 AS start FROM conversations)
SELECT conv_id, turn, substr(trim(replace(regexp_replace(substr(t, greatest(start - 79, 1), least(start, 80)), '(?s)^.*(\n#{1,3} )', '\\1') || substr(t, start + 1, 6) || regexp_replace(substr(t, start + 7, 80), '(?s)\n#{1,3} .*$', ''), chr(10), ' ')), 1, 512) AS context FROM p""")
def _(s, d):
    turn, text = F.col("turn").cast("string"), F.col("text")
    t = F.concat(F.lit("head\n## part "), turn, F.lit("\n"), text, F.lit("\n# next "), text)
    start = F.length(F.lit("head## part ")) + 2 + F.length(turn) + F.floor(F.length(text) / 2).cast("int")
    return table(s, d, "conversations").select("conv_id", "turn", endpoints.endpoint_context(t, start, F.lit(6)).alias("context"))


@query("dedupe_first", f"WITH {VALUES} SELECT l_orderkey AS file_id, key_type, key_value, pattern_no, start FROM (SELECT l_orderkey, kind AS key_type, regexp_extract(value, '^[a-z0-9]+') AS key_value, l_linenumber AS pattern_no, l_partkey AS start, row_number() OVER (PARTITION BY l_orderkey, kind, regexp_extract(value, '^[a-z0-9]+') ORDER BY l_linenumber, l_partkey) AS r FROM v) WHERE r = 1")
def _(s, d):
    v = _values(s, d).select(F.col("l_orderkey").alias("file_id"), F.col("kind").alias("key_type"), F.regexp_extract("value", "^[a-z0-9]+", 0).alias("key_value"), F.col("l_linenumber").alias("pattern_no"), F.col("l_partkey").alias("start"))
    return endpoints.dedupe_first(v)


# orders as configurations that name each kind of endpoint
_CONFIG = "concat('jdbc:mysql://db', o_custkey % 50, '.corp:3306/app', chr(10), 'see https://svc', o_orderkey, '.corp/api, or redis://cache', o_custkey % 7, ':6379/1 and amqp://mq.corp:5672/', o_orderkey % 9, ';', chr(10), 'node 10.', o_orderkey % 256, '.', o_custkey % 256, '.3 or 8.8.4.', o_custkey % 256, ':53', chr(10), 'Broker = kafka', o_orderkey % 11, '.corp:9092, host: localhost:80', chr(10), 'docs https://docs.spring.io/x')"


@query("config_endpoints", """WITH e AS (SELECT o_orderkey AS file_id, unnest([{'t': 'JDBC_URL', 'v': 'jdbc:mysql://db' || o_custkey % 50 || '.corp:3306/app'}, {'t': 'URL', 'v': 'https://svc' || o_orderkey || '.corp/api'}, {'t': 'REDIS_URL', 'v': 'redis://cache' || o_custkey % 7 || ':6379/1'},
  {'t': 'MQ_URL', 'v': 'amqp://mq.corp:5672/' || o_orderkey % 9}, {'t': 'IP_PORT', 'v': '10.' || o_orderkey % 256 || '.' || o_custkey % 256 || '.3'}, {'t': 'IP_PORT', 'v': '8.8.4.' || o_custkey % 256 || ':53'}, {'t': 'HOST_PORT', 'v': 'kafka' || o_orderkey % 11 || '.corp:9092'}]) AS x FROM orders)
SELECT DISTINCT file_id, x.t AS key_type, x.v AS key_value FROM e""")
def _(s, d):
    texts = spread(table(s, d, "orders")).select(F.col("o_orderkey").alias("file_id"), F.expr(_CONFIG.replace("chr(10)", "'\n'")).alias("text"))
    return endpoints.extract_endpoints(texts).select("file_id", "key_type", "key_value")


@query("write_project_tables", f"WITH {FILES} SELECT project, count(*) AS n, CASE WHEN project = 'src1' THEN 'new' ELSE 'old' END AS state FROM f GROUP BY 1")
def _(s, d):
    path, f = fresh_path(s, "project-tables"), files(s, d).select("project", "file_id")
    src.write_project_tables(f.withColumn("state", F.lit("old")), path)
    # only the partition of the project that is written again changes
    src.write_project_tables(f.filter("project = 'src1'").withColumn("state", F.lit("new")), path)
    return s.read.parquet(path).groupBy(F.col("project").cast("string").alias("project"), "state").agg(F.count(F.lit(1)).alias("n")).select("project", "n", "state")
