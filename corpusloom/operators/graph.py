"""Nodes and edges: files, directories, services, imports; entities from model fragments; communities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import WEIGHTS
from ..functions.text import strip
from ..session import stash, unstash
from ..sources.files import dir_label, parent_dir

FRAGMENT = "struct<nodes:array<struct<name:string,type:string,desc:string>>,edges:array<struct<source:string,target:string,type:string,desc:string,weight:double>>>"


def _edges(df: DataFrame, source: Column, target: Column, kind: str, description: Column | None = None) -> DataFrame:
    d = F.lit(None).cast("string") if description is None else description
    return df.select("project", source.alias("source_key"), target.alias("target_key"), F.lit(kind).alias("edge_type"), d.alias("description"), F.lit(WEIGHTS[kind]).alias("weight"))


def file_key(path: Column) -> Column:
    return F.concat(F.lit("file:"), path)


def graph_file_nodes(files: DataFrame, items: DataFrame) -> DataFrame:
    """(project, node_key, label, summary) of live eligible files and of files that hold an item not rejected."""
    held = items.filter("review_status != 'REJECTED'").select("file_id").distinct().withColumn("held", F.lit(True))
    out = files.filter("NOT deleted").join(held, "file_id", "left").filter(F.col("eligible") | F.col("held").isNotNull())
    return out.select("project", file_key(F.col("rel_path")).alias("node_key"), F.col("name").alias("label"), F.substring("summary", 1, 512).alias("summary"))


def graph_dir_nodes(files: DataFrame) -> DataFrame:
    d = files.select("project", parent_dir(F.col("rel_path")).alias("dir")).distinct()
    return d.select("project", F.concat(F.lit("dir:"), "dir").alias("node_key"), dir_label(F.col("dir")).alias("label"))


def edges_contains(files: DataFrame) -> DataFrame:
    return _edges(files, F.concat(F.lit("dir:"), parent_dir(F.col("rel_path"))), file_key(F.col("rel_path")), "CONTAINS").distinct()


def edges_project_contains(files: DataFrame) -> DataFrame:
    d = files.select("project", parent_dir(F.col("rel_path")).alias("dir")).distinct()
    return _edges(d, F.concat(F.lit("project:"), "project"), F.concat(F.lit("dir:"), "dir"), "PROJECT_CONTAINS")


def service_key(kind: Column, value: Column) -> Column:
    return F.concat(F.lit("svc:"), kind, F.lit(":"), value)


def graph_service_nodes(items: DataFrame) -> DataFrame:
    """(project, node_key, label) of distinct services of items that are not rejected; label cut to 100 characters."""
    s = items.filter("review_status != 'REJECTED'").select("project", "key_type", "key_value").distinct()
    return s.select("project", service_key(F.col("key_type"), F.col("key_value")).alias("node_key"), F.substring("key_value", 1, 100).alias("label"))


def edges_mentions(items: DataFrame) -> DataFrame:
    """One edge for each file and service, with the description of the file's first item of it."""
    live = items.filter("review_status != 'REJECTED'")
    one = live.groupBy("project", "rel_path", "key_type", "key_value").agg(F.min_by("context", "item_no").alias("context"))
    return _edges(one, file_key(F.col("rel_path")), service_key(F.col("key_type"), F.col("key_value")), "MENTIONS", F.col("context"))


def edges_related(items: DataFrame, least: int = 2, wide: int = 2000) -> DataFrame:
    """(project, source_key, target_key, n_files, weight) of service pairs that occur together in `least` files or more.

    (file, service) is made distinct first. Services in fewer than `least` files cannot pair and leave before the
    pairs are made. Files with over `wide` services are salted: their services are dealt to blocks, and pairs of
    blocks meet in separate tasks."""
    fs = items.filter("review_status != 'REJECTED'").select("project", "file_id", service_key(F.col("key_type"), F.col("key_value")).alias("s")).distinct()
    often = fs.groupBy("project", "s").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("project", "s")
    fs = fs.join(often, ["project", "s"], "left_semi")
    sizes = fs.groupBy("project", "file_id").agg(F.ceil(F.count(F.lit(1)) / wide).cast("int").alias("blocks")).filter("blocks >= 1")
    fs = stash(fs.join(sizes, ["project", "file_id"]).withColumn("block", F.pmod(F.xxhash64("s"), F.col("blocks")).cast("int")), "services")
    spread = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a = fs.select("project", "file_id", F.col("block").alias("x"), spread.alias("y"), F.col("s").alias("a"))
    b = fs.select("project", "file_id", F.col("block").alias("y"), spread.alias("x"), F.col("s").alias("b"))
    pairs = a.join(b, ["project", "file_id", "x", "y"]).filter("a < b").groupBy("project", "a", "b").agg(F.count(F.lit(1)).alias("n_files"))
    return pairs.filter(F.col("n_files") >= least).select("project", F.col("a").alias("source_key"), F.col("b").alias("target_key"), "n_files", F.lit(WEIGHTS["RELATED"]).alias("weight"))


def edges_imports(sources: DataFrame) -> DataFrame:
    """Edges from files (project, rel_path, name, text) to the file in the project that an import line names; of files of
    one name the smallest path."""
    line = sources.select("project", "rel_path", F.explode(F.split("text", "\n")).alias("line"))
    target = F.concat(F.regexp_extract("line", r"^import\s+(?!static\b)(?:[\w]+\.)*(\w+)\s*;", 1), F.lit(".java"))
    named = line.filter(F.startswith("line", F.lit("import "))).withColumn("target", target).filter("target != '.java'")
    by_name = sources.groupBy("project", F.col("name").alias("target")).agg(F.min("rel_path").alias("to"))
    j = named.join(by_name, ["project", "target"]).filter("to != rel_path").select("project", "rel_path", "to").distinct()
    return _edges(j, file_key(F.col("rel_path")), file_key(F.col("to")), "IMPORTS")


def merge_structural(old_nodes: DataFrame, old_edges: DataFrame, nodes: DataFrame, edges: DataFrame, preserve_entities: bool) -> tuple[DataFrame, DataFrame]:
    """A rebuilt graph; entities and their relations are kept from the old one if asked for."""
    if not preserve_entities:
        return nodes, edges
    return old_nodes.filter("node_type = 'ENTITY'").unionByName(nodes), old_edges.filter("edge_type = 'ENTITY_REL'").unionByName(edges)


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, type, n)."""
    n = nodes.groupBy(F.col("node_type").alias("type")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("part"), "type", "n")
    return n.unionByName(edges.groupBy(F.col("edge_type").alias("type")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("part"), "type", "n"))


def graph_export(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, json): a row for each node and edge, and one with both counts."""
    def row(df: DataFrame, part: str) -> DataFrame:
        return df.select(F.lit(part).alias("part"), F.to_json(F.struct(*df.columns)).alias("json"))

    total = nodes.agg(F.count(F.lit(1)).alias("n_nodes")).join(edges.agg(F.count(F.lit(1)).alias("n_edges")))
    return row(nodes, "node").unionByName(row(edges, "edge")).unionByName(row(total, "counts"))


def select_entity_chunks(chunks: DataFrame, files: DataFrame, most: int = 80) -> DataFrame:
    """The first `most` chunks of each project's live eligible files, by file and place."""
    live = files.filter("NOT deleted AND eligible").select("file_id", "project")
    w = Window.partitionBy("project").orderBy("file_id", "seq")
    return chunks.join(live, "file_id").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def parse_graph_fragments(fragments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (chunk_id, file_id, name, type, desc, ord) and edges (…, source, target, type, desc, weight, ord) of model
    output (chunk_id, file_id, fragment_json): what stands between the first and last brace. Bad JSON is empty."""
    doc = F.from_json(F.regexp_extract("fragment_json", r"(?s)\{.*\}", 0), FRAGMENT)
    base = fragments.select("chunk_id", "file_id", doc.alias("d"))
    name = lambda c: F.substring(strip(F.coalesce(c, F.lit(""))), 1, 120)
    n = base.select("chunk_id", "file_id", F.posexplode("d.nodes").alias("ord", "x")).select("chunk_id", "file_id", "ord", name(F.col("x.name")).alias("name"), F.col("x.type").alias("type"), F.col("x.desc").alias("desc"))
    e = base.select("chunk_id", "file_id", F.posexplode("d.edges").alias("ord", "x"))
    e = e.select("chunk_id", "file_id", "ord", name(F.col("x.source")).alias("source"), name(F.col("x.target")).alias("target"), F.col("x.type").alias("type"), F.col("x.desc").alias("desc"), F.coalesce(F.col("x.weight"), F.lit(0.5)).alias("weight"))
    return n.filter("name != ''"), e.filter("source != '' AND target != '' AND source != target")


def merge_entities(nodes: DataFrame, edges: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(name, type, summary, n_files): the first type, the longest description (the earlier of equals); ends of edges
    are entities too. Existing types that are not blank stay, summaries grow only; they are cut to 1000 characters."""
    ends = edges.select("chunk_id", "file_id", "ord", F.explode(F.array("source", "target")).alias("name")).withColumn("kind", F.lit(1))
    every = nodes.select("chunk_id", "file_id", "ord", "name", "type", "desc", F.lit(0).alias("kind")).unionByName(ends.withColumns({"type": F.lit(None).cast("string"), "desc": F.lit(None).cast("string")}).select("chunk_id", "file_id", "ord", "name", "type", "desc", "kind"))
    order = F.struct("chunk_id", "kind", "ord")
    d = F.length("desc")
    by = every.groupBy("name").agg(
        F.min_by("type", F.when(F.length("type") > 0, order)).alias("type"), F.max_by("desc", F.when(d > 0, F.struct(d, -F.col("chunk_id"), -F.col("kind"), -F.col("ord")))).alias("summary"), F.count_distinct("file_id").alias("n_files"),
    )
    if existing is not None:
        old = existing.select("name", F.col("type").alias("t0"), F.col("summary").alias("s0"))
        longer = F.length(F.coalesce("summary", F.lit(""))) > F.length(F.coalesce("s0", F.lit("")))
        by = by.join(old, "name", "full_outer").select("name", F.coalesce(F.nullif(F.trim("t0"), F.lit("")), "type").alias("type"), F.when(longer, F.col("summary")).otherwise(F.col("s0")).alias("summary"), F.coalesce("n_files", F.lit(0)).alias("n_files"))
    return by.withColumn("summary", F.substring("summary", 1, 1000))


def merge_relations(edges: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """The first relation of each ordered pair, unless one exists; weights are 0.5 for none and 1 at most."""
    first = edges.groupBy("source", "target").agg(F.min_by(F.struct("type", "desc", "weight", "chunk_id"), F.struct("chunk_id", "ord")).alias("x")).select("source", "target", "x.*")
    out = first.withColumn("weight", F.when(F.col("weight") <= 0, 0.5).otherwise(F.least("weight", F.lit(1.0)))).withColumnRenamed("chunk_id", "evidence_chunk_id")
    return out if existing is None else out.join(existing.select("source", "target"), ["source", "target"], "left_anti")


def edges_mentioned_in(nodes: DataFrame, file_nodes: DataFrame, most: int = 2) -> DataFrame:
    """(name, file_id, weight): up to `most` files of each entity, in order of encounter, that have a node."""
    first = nodes.groupBy("name", "file_id").agg(F.min(F.struct("chunk_id", "ord")).alias("at")).join(file_nodes.select("file_id"), "file_id", "left_semi")
    w = Window.partitionBy("name").orderBy("at", "file_id")
    return first.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most).select("name", "file_id", F.lit(WEIGHTS["MENTIONED_IN"]).alias("weight"))


def rebuild_mentions(relations: DataFrame, chunks: DataFrame, file_nodes: DataFrame) -> DataFrame:
    """(name, file_id) for both ends of every relation and the file of its evidence chunk."""
    j = relations.join(chunks.select(F.col("chunk_id").alias("evidence_chunk_id"), "file_id"), "evidence_chunk_id").join(file_nodes.select("file_id"), "file_id", "left_semi")
    return j.select(F.explode(F.array("source", "target")).alias("name"), "file_id").distinct()


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("a"), F.col("target").alias("b")).unionByName(edges.select(F.col("target").alias("a"), F.col("source").alias("b")))


def node_degree(edges: DataFrame) -> DataFrame:
    return _both(edges).groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def _votes(both: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, best): the label that most of a's edges lead to, of equals the smallest."""
    votes = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a", "label").agg(F.sum("n").alias("n"))
    return votes.groupBy("a").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("best"))


def label_propagation(edges: DataFrame, max_iter: int = 12) -> DataFrame:
    """(node, label, converged): each node takes the label that most of its edges lead to, of equals the smallest, until
    no node would change; 2 x max_iter half-steps at most, then as many rounds. converged is false in all rows if some
    node still would.

    Parallel edges count as often as they are there, in either direction. In a half-step only the nodes of a class
    drawn anew by hash change, so that neighbours do not swap labels for ever. Of many small groups a few are still
    unsettled after any number of draws; in a round, of the nodes that would change those change that have no smaller
    such neighbour. As no two neighbours do, each change adds to the edges within labels or makes a label smaller. What
    a node would take is kept next to its label, and only neighbours of nodes that have just changed vote again: later
    steps look at a few nodes and their edges. Labels are written to the shared folder after each step, and those of
    the step before are deleted."""
    both = stash(_both(edges).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), "neighbours")
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
    state = stash(labels.join(_votes(both, labels), F.col("node") == F.col("a")).select("node", "label", "best"), "labels")
    converged = state.filter("best != label").isEmpty()
    for step in range(4 * max_iter):
        if converged:
            break
        old, wish = state, F.col("best") != F.col("label")
        if step < 2 * max_iter:
            turn = (F.pmod(F.xxhash64("node", F.lit(step)), F.lit(2)) == 0) & wish
        else:
            wishing = stash(state.filter(wish).select("node"), "wishing")
            near = both.filter("b < a").join(wishing.select(F.col("node").alias("a")), "a").join(wishing.select(F.col("node").alias("b")), "b", "left_semi")
            first = wishing.join(near.select(F.col("a").alias("node")), "node", "left_anti").withColumn("__turn", F.lit(True))
            state, turn = state.join(first, "node", "left"), F.col("__turn").isNotNull()
        changed = state.filter(turn).select(F.col("node").alias("b"))
        state = state.withColumn("label", F.when(turn, F.col("best")).otherwise(F.col("label"))).select("node", "label", "best")
        again = both.join(changed, "b", "left_semi").select("a").distinct()
        votes = _votes(both.join(again, "a", "left_semi"), state).select("a", F.col("best").alias("__best"))
        state = state.join(votes, F.col("node") == F.col("a"), "left").select("node", "label", F.coalesce("__best", "best").alias("best"))
        state = stash(state, "labels")
        unstash(old)
        converged = state.filter("best != label").isEmpty()
    return state.select("node", "label").withColumn("converged", F.lit(converged))


def communities(labels: DataFrame, edges: DataFrame, least: int = 2, shown: int = 1024) -> DataFrame:
    """(community_no, size, members): groups of `least` or more by size, then label; members by degree, then name, joined
    by '、' and cut to `shown` characters. Numbers come from a range sort of the groups. Only the members that can be
    shown are gathered in a row."""
    from ..sources.files import number_rows

    j = labels.select("node", "label").join(node_degree(edges), "node")
    by = j.groupBy("label").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= least)
    w = Window.partitionBy("label").orderBy(F.desc("degree"), F.col("node").cast("string"))
    first = j.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= shown).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("r", F.col("node").cast("string").alias("node")))).alias("m"))
    out = number_rows(by.join(first, "label").withColumn("order", -F.col("size")), ["order", "label"], "community_no")
    return out.select((F.col("community_no") - 1).alias("community_no"), "size", F.substring(F.array_join(F.transform("m", lambda x: x["node"]), "、"), 1, shown).alias("members"))


def community_context(members: DataFrame, most: int = 30) -> DataFrame:
    """(community, context, summary): lines '- label（type）：summary' of the first members (community, rank, label, type,
    summary), and the first six names."""
    top = members.filter(F.col("rank") <= most).groupBy("community").agg(F.array_sort(F.collect_list(F.struct("rank", "label", "type", "summary"))).alias("m"))
    line = F.transform("m", lambda x: F.concat(F.lit("- "), x["label"], F.lit("（"), F.coalesce(x["type"], F.lit("")), F.lit("）："), F.coalesce(x["summary"], F.lit(""))))
    return top.select("community", F.array_join(line, "\n").alias("context"), F.array_join(F.slice(F.transform("m", lambda x: x["label"]), 1, 6), "、").alias("summary"))


def weighted_graph_merge(edges: DataFrame) -> DataFrame:
    """(a, b, weight, relations): one undirected edge with the greatest weight and all relation names, sorted."""
    u = edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), "weight", "relation")
    return u.groupBy("a", "b").agg(F.max("weight").alias("weight"), F.array_join(F.array_sort(F.collect_set("relation")), ",").alias("relations"))


def community_rel_facts(edges: DataFrame, labels: DataFrame, shown: int = 3) -> DataFrame:
    """(community, n_relations, facts): relations within a community and the first lines of them."""
    own = labels.select(F.col("node").alias("source"), F.col("label").alias("community"))
    other = labels.select(F.col("node").alias("target"), F.col("label").alias("c2"))
    j = edges.join(own, "source").join(other, "target").filter("community = c2")
    w = Window.partitionBy("community").orderBy("source", "target")
    line = F.concat(F.col("source").cast("string"), F.lit(" - "), F.col("target").cast("string"))
    ranked = j.select("community", line.alias("line"), F.row_number().over(w).alias("r"))
    facts = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= shown, F.struct("r", "line")))), lambda x: x["line"]), "; ")
    return ranked.groupBy("community").agg(F.count(F.lit(1)).alias("n_relations"), facts.alias("facts"))
