"""Queries of graphs, communities and version families."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import families, graph
from .fixtures import FILES, SERVICES, TREE, customer_tree, files, services, table
from .registry import query




@query("graph_file_nodes", f"WITH {TREE} SELECT project, 'file:' || rel_path AS node_key, name AS label, summary FROM t WHERE eligible OR file_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'F')")
def _(s, d):
    items = table(s, d, "orders").select(F.col("o_custkey").alias("file_id"), F.when(F.col("o_orderstatus") == "F", "REJECTED").otherwise("PENDING").alias("review_status"))
    return graph.graph_file_nodes(customer_tree(s, d), items)


@query("graph_dir_nodes", f"WITH {TREE} SELECT DISTINCT project, 'dir:' || dir AS node_key, dir AS label FROM t")
def _(s, d):
    return graph.graph_dir_nodes(customer_tree(s, d))


@query("edges_contains", f"WITH {TREE} SELECT project, 'dir:' || dir AS source_key, 'file:' || rel_path AS target_key, 'CONTAINS' AS edge_type, NULL AS description, CAST(0.5 AS DOUBLE) AS weight FROM t")
def _(s, d):
    return graph.edges_contains(customer_tree(s, d))


@query("edges_project_contains", f"WITH {TREE} SELECT DISTINCT project, 'project:' || project AS source_key, 'dir:' || dir AS target_key, 'PROJECT_CONTAINS' AS edge_type, NULL AS description, CAST(0.9 AS DOUBLE) AS weight FROM t")
def _(s, d):
    return graph.edges_project_contains(customer_tree(s, d))


@query("graph_service_nodes", f"WITH {SERVICES} SELECT DISTINCT project, 'svc:PART:' || key_value AS node_key, key_value AS label FROM s WHERE review_status <> 'REJECTED'")
def _(s, d):
    return graph.graph_service_nodes(services(s, d))


@query("edges_mentions", f"WITH {SERVICES} SELECT project, 'file:' || rel_path AS source_key, 'svc:PART:' || key_value AS target_key, 'MENTIONS' AS edge_type, arg_min(context, item_no) AS description, CAST(1.0 AS DOUBLE) AS weight FROM s WHERE review_status <> 'REJECTED' GROUP BY project, rel_path, key_value")
def _(s, d):
    one = services(s, d).groupBy("project", "rel_path", "key_type", "key_value", "review_status", "item_no").agg(F.min("context").alias("context"))
    return graph.edges_mentions(one)


RELATED = f"WITH {SERVICES}, d AS (SELECT DISTINCT file_id, 'svc:PART:' || key_value AS k FROM s WHERE review_status <> 'REJECTED'), r AS (SELECT a.k AS a, b.k AS b, count(*) AS n FROM d a JOIN d b ON a.file_id = b.file_id AND a.k < b.k GROUP BY 1, 2 HAVING count(*) >= 2)"


@query("edges_related", f"{RELATED} SELECT 'p' AS project, a AS source_key, b AS target_key, n AS n_files, CAST(0.3 AS DOUBLE) AS weight FROM r")
def _(s, d):
    return graph.edges_related(services(s, d))


@query("edges_imports", "SELECT 'src' AS project, 'file:' || dir || '/P' || p_partkey || '.java' AS source_key, 'file:' || 'd0/P' || p_size || '.java' AS target_key FROM (SELECT *, 'd0' AS dir FROM part) WHERE p_size <> p_partkey AND p_size IN (SELECT p_partkey FROM part)")
def _(s, d):
    p = table(s, d, "part")
    name = F.concat(F.lit("P"), F.col("p_partkey").cast("string"), F.lit(".java"))
    text = F.concat(F.lit("package x;\nimport static a.B.c;\nimport org.acme.P"), F.col("p_size").cast("string"), F.lit(";\nimport org.acme.Missing;\nclass A {}"))
    src = p.select(F.lit("src").alias("project"), F.concat(F.lit("d0/"), name).alias("rel_path"), name.alias("name"), text.alias("text"))
    return graph.edges_imports(src).select("project", "source_key", "target_key")


def _typed_graph(s, d):
    t, i = customer_tree(s, d), services(s, d)
    kind = lambda df, k: df.select("node_key", F.lit(k).alias("node_type"))
    nodes = kind(graph.graph_dir_nodes(t), "DIR").unionByName(kind(graph.graph_service_nodes(i), "SERVICE")).unionByName(table(s, d, "part").select(F.col("p_name").alias("node_key"), F.lit("ENTITY").alias("node_type")))
    edges = graph.edges_contains(t).select("source_key", "target_key", "edge_type").unionByName(graph.edges_project_contains(t).select("source_key", "target_key", "edge_type"))
    edges = edges.unionByName(table(s, d, "part").select(F.col("p_brand").alias("source_key"), F.col("p_type").alias("target_key"), F.lit("ENTITY_REL").alias("edge_type")))
    return nodes, edges


STATS = f"""WITH {TREE}, {SERVICES}, n AS (SELECT 'node' AS part, 'DIR' AS type, count(DISTINCT (project, dir)) AS n FROM t UNION ALL SELECT 'node', 'SERVICE', count(DISTINCT key_value) FROM s WHERE review_status <> 'REJECTED' UNION ALL SELECT 'node', 'ENTITY', count(*) FROM part
UNION ALL SELECT 'edge', 'CONTAINS', count(*) FROM t UNION ALL SELECT 'edge', 'PROJECT_CONTAINS', count(DISTINCT (project, dir)) FROM t UNION ALL SELECT 'edge', 'ENTITY_REL', count(*) FROM part)"""


@query("graph_stats", f"{STATS} SELECT * FROM n")
def _(s, d):
    return graph.graph_stats(*_typed_graph(s, d))


@query("merge_structural", f"{STATS} SELECT part, type, CASE WHEN type IN ('ENTITY', 'ENTITY_REL') THEN 2 * n ELSE n END AS n FROM n")
def _(s, d):
    n, e = _typed_graph(s, d)
    return graph.graph_stats(*graph.merge_structural(n, e, n, e, True))


_NODE, _EDGE = ("""'{"node_key":"' || k || '","node_type":"' || y || '"}'""", """'{"source_key":"' || a || '","target_key":"' || b || '","edge_type":"' || y || '"}'""")


@query("graph_export", f"""{STATS}, nk AS (SELECT DISTINCT project || '' AS p, 'dir:' || dir AS k, 'DIR' AS y FROM t UNION SELECT DISTINCT project, 'svc:PART:' || key_value, 'SERVICE' FROM s WHERE review_status <> 'REJECTED'),
ek AS (SELECT DISTINCT project AS p, 'dir:' || dir AS a, 'file:' || rel_path AS b, 'CONTAINS' AS y FROM t UNION SELECT DISTINCT project, 'project:' || project, 'dir:' || dir, 'PROJECT_CONTAINS' FROM t)
SELECT 'node' AS part, {_NODE} AS json FROM (SELECT k, y FROM nk UNION ALL SELECT p_name, 'ENTITY' FROM part) UNION ALL SELECT 'edge', {_EDGE} FROM (SELECT a, b, y FROM ek UNION ALL SELECT p_brand, p_type, 'ENTITY_REL' FROM part)
UNION ALL SELECT 'counts', '{{"n_nodes":' || (SELECT sum(n)::BIGINT FROM n WHERE part = 'node') || ',"n_edges":' || (SELECT sum(n)::BIGINT FROM n WHERE part = 'edge') || '}}'""")
def _(s, d):
    return graph.graph_export(*_typed_graph(s, d))


def _fragments(s, d):
    """A fragment for each order: its parts as nodes, neighbours by line as relations."""
    li = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    node = F.struct(F.concat(F.col("p_name"), F.lit(" "), F.col("p_brand")).alias("name"), F.col("p_type").alias("type"), F.concat(F.col("p_name"), F.lit(" of size "), F.col("p_size").cast("string")).alias("desc"))
    g = li.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", node.alias("n")))), lambda x: x["n"]).alias("nodes"))
    n, m = F.slice("nodes", F.lit(1), F.size("nodes") - 1), F.slice("nodes", F.lit(2), F.size("nodes") - 1)
    edge = F.zip_with(n, m, lambda a, b: F.struct(a["name"].alias("source"), b["name"].alias("target"), F.lit("WITH").alias("type"), a["desc"].alias("desc"), F.lit(0.0).alias("weight")))
    doc = F.to_json(F.struct("nodes", F.when(F.size("nodes") > 1, edge).alias("edges")))
    return g.select(F.col("l_orderkey").alias("chunk_id"), F.col("l_orderkey").alias("file_id"), F.concat(F.lit("Answer: "), doc, F.lit(" end")).alias("fragment_json"))


FRAGMENTS = """b AS (SELECT l_orderkey AS c, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, p_name || ' ' || p_brand) - 1 AS ord, p_name || ' ' || p_brand AS name, p_type AS type, p_name || ' of size ' || p_size AS descr FROM lineitem JOIN part ON l_partkey = p_partkey),
e AS (SELECT x.c, x.ord, x.name AS source, y.name AS target, x.descr FROM b x JOIN b y ON x.c = y.c AND y.ord = x.ord + 1 WHERE x.name <> y.name)"""


@query("parse_graph_fragments", f"WITH {FRAGMENTS} SELECT c AS chunk_id, ord, source, target, CAST(0.0 AS DOUBLE) AS weight FROM e")
def _(s, d):
    return graph.parse_graph_fragments(_fragments(s, d))[1].select("chunk_id", "ord", "source", "target", "weight")


@query("merge_entities", f"WITH {FRAGMENTS} SELECT name, arg_min(type, (c, ord)) AS type, arg_max(descr, (length(descr), -c, -ord)) AS summary, count(DISTINCT c) AS n_files FROM b GROUP BY 1")
def _(s, d):
    return graph.merge_entities(*graph.parse_graph_fragments(_fragments(s, d)))


@query("merge_relations", f"WITH {FRAGMENTS} SELECT source, target, 'WITH' AS type, arg_min(descr, (c, ord)) AS desc, CAST(0.5 AS DOUBLE) AS weight, min(c) AS evidence_chunk_id FROM e GROUP BY 1, 2")
def _(s, d):
    return graph.merge_relations(graph.parse_graph_fragments(_fragments(s, d))[1])


@query("edges_mentioned_in", f"WITH {FRAGMENTS}, f AS (SELECT name, c, min(ord) AS o FROM b WHERE c IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1, 2) SELECT name, c AS file_id, CAST(0.3 AS DOUBLE) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY c, o) AS r FROM f) WHERE r <= 2")
def _(s, d):
    nodes = table(s, d, "orders").filter("o_orderstatus != 'P'").select(F.col("o_orderkey").alias("file_id"))
    return graph.edges_mentioned_in(graph.parse_graph_fragments(_fragments(s, d))[0], nodes)


@query("rebuild_mentions", f"WITH {FRAGMENTS}, r AS (SELECT source, target, min(c) AS c FROM e GROUP BY 1, 2) SELECT source AS name, c AS file_id FROM r UNION SELECT target, c FROM r")
def _(s, d):
    rel = graph.merge_relations(graph.parse_graph_fragments(_fragments(s, d))[1])
    o = table(s, d, "orders")
    return graph.rebuild_mentions(rel, o.select(F.col("o_orderkey").alias("chunk_id"), F.col("o_orderkey").alias("file_id")), o.select(F.col("o_orderkey").alias("file_id")))


@query("select_entity_chunks", "SELECT chunk_id FROM (SELECT l_orderkey * 10 + l_linenumber AS chunk_id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F') WHERE r <= 80")
def _(s, d):
    li, o = table(s, d, "lineitem"), table(s, d, "orders")
    c = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), F.col("l_orderkey").alias("file_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("seq"))
    f = o.select(F.col("o_orderkey").alias("file_id"), F.col("o_orderpriority").alias("project"), F.lit(False).alias("deleted"), (F.col("o_orderstatus") == "F").alias("eligible"))
    return graph.select_entity_chunks(c, f).select("chunk_id")


def _part_graph(s, d):
    return graph.edges_related(services(s, d)).select(F.col("source_key").alias("source"), F.col("target_key").alias("target"))


@query("node_degree", f"{RELATED} SELECT node, count(*) AS degree FROM (SELECT a AS node FROM r UNION ALL SELECT b FROM r) GROUP BY 1")
def _(s, d):
    return graph.node_degree(_part_graph(s, d))


@query("label_propagation")
def _(s, d):
    return graph.label_propagation(_part_graph(s, d))


@query("communities")
def _(s, d):
    e = _part_graph(s, d)
    return graph.communities(graph.label_propagation(e), e)


REGION = "m AS (SELECT r_name AS community, row_number() OVER (PARTITION BY r_name ORDER BY n_name) AS rank, n_name AS label, 'NATION' AS type, 'key ' || n_nationkey AS summary FROM nation JOIN region ON n_regionkey = r_regionkey)"


# the line items of an order, each linked with each
CLIQUES = "n AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS node, l_orderkey AS o FROM lineitem), g AS (SELECT o, count(*) AS size, min(node) AS low FROM n GROUP BY 1 HAVING count(*) > 1)"


def _cliques(s, d):
    n = table(s, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("node"), F.col("l_orderkey").alias("o")).distinct()
    return n.select("o", F.col("node").alias("source")).join(n.select("o", F.col("node").alias("target")), "o").filter("source < target").select("source", "target")


@query("label_propagation_cliques", f"WITH {CLIQUES} SELECT node, low AS community, true AS converged FROM n JOIN g ON g.o = n.o")
def _(s, d):
    found = graph.label_propagation(_cliques(s, d))
    low = found.groupBy("label").agg(F.min("node").alias("community"))
    return found.join(low, "label").select("node", "community", "converged")


@query("communities_cliques", f"WITH {CLIQUES} SELECT g.size, string_agg(node, '、' ORDER BY CAST(node AS VARCHAR)) AS members FROM n JOIN g ON g.o = n.o GROUP BY g.o, g.size")
def _(s, d):
    e = _cliques(s, d)
    return graph.communities(graph.label_propagation(e), e).select("size", "members")


@query("community_context", f"WITH {REGION} SELECT community, string_agg('- ' || label || '（NATION）：' || summary, chr(10) ORDER BY rank) AS context, string_agg(label, '、' ORDER BY rank) FILTER (rank <= 6) AS summary FROM m GROUP BY 1")
def _(s, d):
    from pyspark.sql import Window

    j = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    m = j.select(F.col("r_name").alias("community"), F.row_number().over(Window.partitionBy("r_name").orderBy("n_name")).alias("rank"), F.col("n_name").alias("label"), F.lit("NATION").alias("type"), F.concat(F.lit("key "), F.col("n_nationkey").cast("string")).alias("summary"))
    return graph.community_context(m)


@query("weighted_graph_merge", "SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, max(l_discount) AS weight, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS relations FROM lineitem GROUP BY 1, 2")
def _(s, d):
    return graph.weighted_graph_merge(table(s, d, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), F.col("l_discount").alias("weight"), F.col("l_returnflag").alias("relation")))


@query("community_rel_facts", """WITH e AS (SELECT DISTINCT c_custkey AS a, o_orderkey + 1000000000 AS b FROM customer JOIN orders ON o_custkey = c_custkey), l AS (SELECT c_custkey AS node, c_nationkey AS c FROM customer UNION ALL SELECT o_orderkey + 1000000000, o_orderkey % 25 FROM orders),
x AS (SELECT l1.c AS community, a, b, row_number() OVER (PARTITION BY l1.c ORDER BY a, b) AS r FROM e JOIN l l1 ON l1.node = a JOIN l l2 ON l2.node = b WHERE l1.c = l2.c)
SELECT community, count(*) AS n_relations, string_agg(a || ' - ' || b, '; ' ORDER BY r) FILTER (r <= 3) AS facts FROM x GROUP BY 1""")
def _(s, d):
    c, o = table(s, d, "customer"), table(s, d, "orders")
    node = F.col("o_orderkey") + 1_000_000_000
    e = c.join(o, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_custkey").alias("source"), node.alias("target")).distinct()
    labels = c.select(F.col("c_custkey").alias("node"), F.col("c_nationkey").cast("long").alias("label")).unionByName(o.select(node.alias("node"), (F.col("o_orderkey") % 25).alias("label")))
    return graph.community_rel_facts(e, labels)


@query("normalize_doc_name", r"SELECT page_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(n, '\.[^.]+$', ''), '(?i)[_\-\s]*[Vv]\d+(\.\d+)*', '', 'g'), '\b20\d{6}\b|\b20\d{2}-\d{2}-\d{2}\b|\b[01]\d{3,5}\b', '', 'g'), '(?i)[_\-\s]*(?:final|copy|revised|draft|backup)', '', 'g'), '[\(]\d+[\)]', '', 'g'), '[_\-\s]+', ' ', 'g'))) AS name FROM (SELECT page_id, regexp_extract(url, '[^/]*$') || '_v1.2 (3)_final.docx' AS n FROM pages)")
def _(s, d):
    n = F.concat(F.regexp_extract("url", r"[^/]*$", 0), F.lit("_v1.2 (3)_final.docx"))
    return table(s, d, "pages").select("page_id", families.normalize_doc_name(n).alias("name"))


@query("version_label", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'v' || p_size || '.1' WHEN p_size < 20 THEN '20240101' WHEN p_size < 30 THEN 'draft' END AS label FROM part")
def _(s, d):
    size = F.col("p_size")
    n = F.when(size < 10, F.concat(F.lit("a_v"), size.cast("string"), F.lit(".1_final.md"))).when(size < 20, F.lit("b 20240101 final.md")).when(size < 30, F.lit("c_draft.md")).otherwise(F.lit("plain.md"))
    return table(s, d, "part").select("p_partkey", families.version_label(n).alias("label"))


def _versions(s, d):
    """Parts as documents: parts of one name are versions."""
    p = table(s, d, "part")
    name = F.concat(F.col("p_name"), F.lit("_v"), F.col("p_size").cast("string"), F.lit(".docx"))
    return p.select(F.lit("p").alias("project"), F.col("p_partkey").alias("file_id"), name.alias("name"), F.col("p_size").cast("long").alias("mtime"), F.col("p_type").alias("doc_type"), F.lit("doc").alias("category"), F.lit(False).alias("deleted"))


FAM = "fam AS (SELECT p_name AS family, count(*) AS file_count, arg_max(p_partkey, (p_size, -p_partkey)) AS eff FROM part GROUP BY 1 HAVING count(*) >= 2), ty AS (SELECT p_name AS family, arg_min(p_type, (-n, p_type)) AS doc_type FROM (SELECT p_name, p_type, count(*) AS n FROM part GROUP BY 1, 2) GROUP BY 1)"


@query("doc_families", f"WITH {FAM} SELECT 'p' AS project, fam.family, file_count, doc_type, eff AS effective_file_id FROM fam JOIN ty ON ty.family = fam.family")
def _(s, d):
    return families.doc_families(_versions(s, d))


@query("family_assign", f"WITH {FAM} SELECT p_partkey AS file_id, family, CASE WHEN family IS NOT NULL THEN 'v' || p_size END AS version_label FROM part LEFT JOIN fam ON family = p_name")
def _(s, d):
    v = _versions(s, d)
    return families.family_assign(v, families.doc_families(v)).select("file_id", "family", "version_label")


@query("family_list", f"WITH {FAM} SELECT family, file_count FROM fam ORDER BY file_count DESC, family LIMIT 20")
def _(s, d):
    return families.family_list(families.doc_families(_versions(s, d))).select("family", "file_count")


@query("family_members", f"WITH {FAM} SELECT family, p_partkey AS file_id, row_number() OVER (PARTITION BY family ORDER BY p_size DESC, p_partkey) AS place, p_partkey = eff AS is_effective FROM part JOIN fam ON family = p_name")
def _(s, d):
    v = _versions(s, d)
    f = families.doc_families(v)
    return families.family_members(families.family_assign(v, f), f).select("family", "file_id", "place", "is_effective")


@query("document_families", f"WITH {FILES} SELECT project, sha256 AS family, count(*) AS file_count, max(file_id) AS effective_file_id FROM f GROUP BY 1, 2 HAVING count(*) >= 2")
def _(s, d):
    f = files(s, d).withColumn("doc_type", F.lit("note"))
    return families.doc_families(f, key=F.col("sha256")).select("project", "family", "file_count", "effective_file_id")
