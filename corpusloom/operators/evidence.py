"""From ranked chunks and graphs to contexts, citations and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import any_of, grams, normalize_text, strip
from ..session import apart, stash
from .retrieval import contained

CITATIONS = "array<struct<file_name:string,heading_path:string,chunk_id:bigint,score:double>>"
UNAVAILABLE = "The model is not available at present."


def seed_entities(questions: DataFrame, entities: DataFrame, seed_text: DataFrame | None = None, most: int = 4) -> DataFrame:
    """(question_id, name, score, rank): 100 for a label in the question, 50 in question and seed chunks (question_id,
    text), 3 for each of the question's Han pairs in the summary. Labels meet questions by their first two characters."""
    ctx = questions.select("question_id", "question", F.lower("question").alias("q"))
    if seed_text is not None:
        ctx = ctx.join(seed_text.groupBy("question_id").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("st")), "question_id", "left")
        ctx = ctx.withColumn("all", F.concat_ws("\n", "q", F.lower("st")))
    else:
        ctx = ctx.withColumn("all", F.col("q"))
    pairs = F.filter(grams(F.col("question")), lambda x: F.rlike(x, F.lit(r"^[一-鿿]{2}$")))
    ctx = ctx.select("question_id", "q", "all", pairs.alias("pairs"))
    e = entities.filter(F.length("name") >= 2).select("name", F.lower("name").alias("label"), F.coalesce("summary", F.lit("")).alias("summary"))
    by_label = apart(ctx.select("question_id", F.explode(grams(F.col("all"))).alias("g"))).join(e.select("name", F.substring("label", 1, 2).alias("g")), "g").select("question_id", "name")
    by_pair = apart(ctx.select("question_id", F.explode("pairs").alias("g"))).join(e.select("name", F.explode(grams(F.col("summary"))).alias("g")), "g").select("question_id", "name")
    # one shuffle by question serves the distinct pairs, their texts and the ranks
    j = by_label.unionByName(by_pair).repartition("question_id").distinct().join(apart(ctx), "question_id").join(e, "name")
    s = F.when(F.contains("q", "label"), 100).otherwise(0) + F.when(F.contains("all", "label"), 50).otherwise(0) + 3 * F.size(F.filter("pairs", lambda p: F.contains(F.col("summary"), p)))
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), "name")
    return j.select("question_id", "name", s.alias("score")).filter("score > 0").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def seed_entities_alias(questions: DataFrame, entities: DataFrame) -> DataFrame:
    """(question_id, name): entities whose name, or a part of it of two characters or more, is in the question; for
    questions without any, those whose description holds one of the question's Han runs."""
    parts = F.array_distinct(F.filter(F.concat(F.array("name"), F.split("name", r"[()（）/·]")), lambda p: F.length(F.trim(p)) >= 2))
    e = entities.select("name", F.explode(F.transform(parts, F.trim)).alias("part"))
    q = questions.select("question_id", "question")
    # grams leave their question; of the pairs that they find, each looks at its text once
    met = apart(q.select("question_id", F.explode(grams(F.col("question"))).alias("g"))).join(e.withColumn("g", F.substring("part", 1, 2)), "g").select("question_id", "name", "part")
    hit = met.repartition("question_id").join(apart(q), "question_id").filter(F.contains("question", "part")).select("question_id", "name").distinct()
    left = apart(q).join(apart(hit.select("question_id").distinct()), "question_id", "left_anti")
    runs = left.select("question_id", F.explode(F.regexp_extract_all("question", F.lit(r"[一-鿿]{2,}"), F.lit(0))).alias("run"))
    by = entities.select("name", "description", F.explode(grams(F.coalesce("description", F.lit("")))).alias("g"))
    more = apart(runs.withColumn("g", F.substring("run", 1, 2))).join(by, "g").filter(F.contains("description", "run")).select("question_id", "name").distinct()
    return hit.unionByName(more)


def local_relations(seeds: DataFrame, relations: DataFrame, most: int = 18) -> DataFrame:
    """(question_id, source, target, edge_type, weight, rank): relations of a seed, the heaviest first.

    What is among a question's first `most` is among those of each of its seeds that has it, so that only these meet the
    seeds, whatever the number of relations of a name."""
    cols, order = ["source", "target", "edge_type", "weight"], [F.desc("weight"), "source", "target", "edge_type"]
    r = relations.select(cols).distinct()
    ends = r.select(F.col("source").alias("name"), *cols).unionByName(r.filter("NOT target <=> source").select(F.col("target").alias("name"), *cols))
    first = ends.withColumn("__r", F.row_number().over(Window.partitionBy("name").orderBy(*order))).filter(F.col("__r") <= most).drop("__r")
    met = apart(seeds.select("question_id", "name")).join(first, "name").select("question_id", *cols)
    w = Window.partitionBy("question_id").orderBy(*order)
    return met.repartition("question_id").distinct().withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def graph_facts(seeds: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(question_id, facts): lines for seed entities, then for relations, in rank order."""
    e = entities.select("name", F.coalesce("type", F.lit("")).alias("type"), F.coalesce("summary", F.lit("")).alias("summary"))
    s = apart(seeds).join(e, "name").select("question_id", F.lit(0).alias("k"), "rank", F.concat(F.lit("Seed entity: "), "name", F.lit("; type="), "type", F.lit("; summary="), "summary").alias("line"))
    r = relations.select("question_id", F.lit(1).alias("k"), "rank", F.concat(F.lit("Relation: "), "source", F.lit(" --["), "edge_type", F.lit("]--> "), "target").alias("line"))
    return s.unionByName(r).groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "rank", "line"))), lambda x: x["line"]), "\n").alias("facts"))


def local_evidence_chunks(relations: DataFrame, labels: DataFrame, chunks: DataFrame, seeds: DataFrame, limit: int = 8, per_label: int = 2, most_labels: int = 12) -> DataFrame:
    """(question_id, chunk_id, rank): evidence chunks of relations (question_id, rank, evidence_chunk_id), then up to
    per_label chunks that hold a label (question_id, label, place); none that is a seed chunk already."""
    from .retrieval import keyword_hits

    first = relations.filter("evidence_chunk_id IS NOT NULL").select("question_id", F.col("evidence_chunk_id").alias("chunk_id"), F.lit(0).alias("k"), F.col("rank").alias("a"), F.lit(0).alias("b"))
    few = labels.filter(F.col("place") < most_labels)
    hits = keyword_hits(None, chunks, None, words=few.select(F.lower("label").alias("keyword")).filter("keyword != ''").distinct()).select("keyword", "chunk_id")
    w = Window.partitionBy("question_id", "place").orderBy("chunk_id")
    more = few.withColumn("keyword", F.lower("label")).join(hits, "keyword").withColumn("b", F.row_number().over(w)).filter(F.col("b") <= per_label)
    every = first.unionByName(more.select("question_id", "chunk_id", F.lit(1).alias("k"), F.col("place").alias("a"), "b"))
    one = every.join(seeds.select("question_id", "chunk_id"), ["question_id", "chunk_id"], "left_anti").groupBy("question_id", "chunk_id").agg(F.min(F.struct("k", "a", "b")).alias("at"))
    w2 = Window.partitionBy("question_id").orderBy("at", "chunk_id")
    return one.withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= limit).drop("at")


def k_hop_subgraph(seeds: DataFrame, edges: DataFrame, hops: int = 1) -> DataFrame:
    """(question_id, name, hop): seeds and what up to `hops` undirected edges reach, with the fewest hops."""
    both = edges.select(F.col("source").alias("name"), F.col("target").alias("next")).unionByName(edges.select(F.col("target").alias("name"), F.col("source").alias("next"))).distinct()
    seen = seeds.select("question_id", "name").distinct().withColumn("hop", F.lit(0))
    edge = seen
    for h in range(1, hops + 1):
        new = edge.join(both, "name").select("question_id", F.col("next").alias("name")).distinct()
        edge = new.join(seen, ["question_id", "name"], "left_anti").withColumn("hop", F.lit(h))
        seen = seen.unionByName(edge)
    return seen


def expand_and_dedupe(ranked: DataFrame, extra: DataFrame, score: float = 0.45) -> DataFrame:
    """(question_id, chunk_id, score): extra chunks get `score`; the best score of each chunk stays."""
    every = ranked.select("question_id", "chunk_id", "score").unionByName(extra.select("question_id", "chunk_id", F.lit(score).alias("score")))
    return every.groupBy("question_id", "chunk_id").agg(F.max("score").alias("score"))


def context_block(path: Column, heading: Column, content: Column) -> Column:
    h = F.when(F.coalesce(heading, F.lit("")) != "", F.concat(F.lit(" § "), heading)).otherwise("")
    return F.concat(F.lit("【来源："), path, h, F.lit("】\n"), F.coalesce(content, F.lit("")))


def build_contexts(ranked: DataFrame, chunks: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(question_id, contexts): graph facts first under a header, if there are any, then a block for each chunk in rank
    order (chunks with rel_path)."""
    c = ranked.join(chunks, "chunk_id").select("question_id", F.col("rank").cast("int").alias("rank"), context_block(F.col("rel_path"), F.col("heading"), F.col("content")).alias("block"))
    if facts is not None:
        told = facts.filter(F.coalesce("facts", F.lit("")) != "")
        c = c.unionByName(told.select("question_id", F.lit(0).alias("rank"), F.concat(F.lit(rules.FACTS_HEADER), F.col("facts")).alias("block")))
    return c.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n\n").alias("contexts"))


def budgeted_contexts(contexts: DataFrame, each: int = 6000, total: int = 60000) -> DataFrame:
    """(question_id, rank, block) cut to `each` characters, up to the first that would pass `total`."""
    w = Window.partitionBy("question_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    c = contexts.withColumn("block", F.substring("block", 1, each)).withColumn("used", F.sum(F.length("block")).over(w))
    return c.filter(F.col("used") <= total).drop("used")


def revision_contexts(evidence: DataFrame, chunks: DataFrame, first: int = 3) -> DataFrame:
    """(artifact_id, chunk_id, location): chunks of the evidence with cell range, else page, else heading; for artifacts
    without any, the first chunks of each source file."""
    loc = F.coalesce(F.col("cell_range"), F.concat(F.lit("p. "), F.col("page_no").cast("string")), F.col("heading_path"), F.lit(""))
    direct = evidence.filter("chunk_id IS NOT NULL").join(chunks.select("chunk_id"), "chunk_id").select("artifact_id", "chunk_id", loc.alias("location"))
    left = evidence.join(direct.select("artifact_id").distinct(), "artifact_id", "left_anti").select("artifact_id", "file_id").distinct()
    w = Window.partitionBy("file_id").orderBy("seq", "chunk_id")
    head = chunks.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= first).select("file_id", "chunk_id", F.coalesce("heading", F.lit("")).alias("location"))
    return direct.unionByName(left.join(head, "file_id").select("artifact_id", "chunk_id", "location"))


def draft_query(drafts: DataFrame, defaults: DataFrame) -> DataFrame:
    """(artifact_id, query): title and instructions, or the type's default keywords (artifact_type, keywords)."""
    blank = F.trim(F.coalesce("instructions", F.lit(""))) == ""
    j = drafts.join(defaults, "artifact_type", "left")
    return j.select("artifact_id", F.concat_ws(" ", "title", F.when(blank, F.col("keywords")).otherwise(F.col("instructions"))).alias("query"))


def global_contexts(ranked: DataFrame, communities: DataFrame) -> DataFrame:
    """(question_id, kind, item, rank): each question's chunks, then all communities by size."""
    q = ranked.select("question_id").distinct()
    a = ranked.select("question_id", F.lit("chunk").alias("kind"), F.col("chunk_id").cast("string").alias("item"), F.col("rank").cast("long").alias("rank"))
    b = q.crossJoin(communities.select(F.col("community_no").cast("string").alias("item"), F.col("community_no").cast("long").alias("rank")))
    return a.unionByName(b.select("question_id", F.lit("community").alias("kind"), "item", "rank"))


def classify_answer(answer: Column, grounded: Column) -> Column:
    """blank, no_answer, provider_failure and retryable of an answer."""
    compact, low = F.regexp_replace(F.coalesce(answer, F.lit("")), r"\s+", ""), F.lower(F.coalesce(answer, F.lit("")))
    blank = compact == ""
    none = blank | any_of(compact, rules.NO_ANSWER)
    return F.struct(blank.alias("blank"), none.alias("no_answer"), (blank | (~grounded & ~none)).alias("provider_failure"), (blank | (~grounded & any_of(low, rules.RETRYABLE))).alias("retryable"))


def citation_threshold(best: Column) -> Column:
    return F.when(best <= 0, F.lit(float("inf"))).otherwise(F.least(best, F.greatest(F.lit(0.35), best * 0.4)))


def names_file(answer: Column, name: Column) -> Column:
    base = F.element_at(F.split(name, r"[/\\]"), -1)
    return (F.coalesce(answer, F.lit("")) != "") & (F.coalesce(name, F.lit("")) != "") & (F.contains(answer, name) | ((base != "") & F.contains(answer, base)))


def select_citations(ranked: DataFrame, answers: DataFrame, most: int = 6) -> DataFrame:
    """(question_id, file_name, chunk_id, score, rank) from scored chunks (question_id, chunk_id, file_name, score): at
    least the question's threshold, or a file that the answer names; the best chunk of a file; none if not grounded."""
    best = ranked.groupBy("question_id").agg(F.max("score").alias("best"))
    j = ranked.join(best, "question_id").join(answers.filter("grounded").select("question_id", "answer"), "question_id")
    j = j.filter((F.col("score") >= citation_threshold(F.col("best"))) | names_file(F.col("answer"), F.col("file_name")))
    one = j.groupBy("question_id", "file_name").agg(F.min_by(F.struct("chunk_id", "score"), F.struct(-F.col("score"), "chunk_id")).alias("x")).select("question_id", "file_name", "x.*")
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id", "file_name")
    return one.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def preview(text: Column, limit: int = 220) -> Column:
    t = strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("..."))).otherwise(t)


def evidence_trace(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """(question_id, chunk_id, rel_path, preview) of distinct chunks."""
    return ranked.select("question_id", "chunk_id").distinct().join(chunks.select("chunk_id", "rel_path", preview(F.col("content")).alias("preview")), "chunk_id")


def ask_history_view(history: DataFrame, project: str | None = None, page: int = 0, size: int = 20) -> DataFrame:
    """history with citations of grounded answers only: those of the best score or of files the answer names, the best
    of each file; newest first, 100 rows a page at most."""
    rows = history.filter(F.col("project_id") == project) if project else history
    cites = F.coalesce(F.from_json("citations_json", CITATIONS), F.array().cast(CITATIONS))
    best = F.array_max(F.transform("c", lambda x: x["score"]))
    named = F.filter("c", lambda x: (x["score"] == best) | names_file(F.col("answer"), x["file_name"]))
    one = F.filter("c", lambda x: ~F.exists("c", lambda y: (y["file_name"] == x["file_name"]) & ((y["score"] > x["score"]) | ((y["score"] == x["score"]) & (y["chunk_id"] < x["chunk_id"])))))
    out = rows.withColumn("c", F.when(F.col("grounded"), cites).otherwise(F.array().cast(CITATIONS))).withColumn("c", named).withColumn("c", one)
    shown = F.when(F.trim(F.coalesce("answer", F.lit(""))) == "", UNAVAILABLE).otherwise(F.col("answer"))
    out = out.withColumn("answer", shown).withColumn("citations", F.col("c")).withColumn("citation_count", F.size("c")).drop("c", "citations_json")
    return out.orderBy(F.desc("created_at"), F.desc("id")).offset(page * min(size, 100)).limit(min(size, 100))


def evidence_scope(drafts: DataFrame, files: DataFrame) -> DataFrame:
    """(artifact_id, scope, file_id) that 'only use …' in the instructions allows: files whose name starts with a number
    listed, or whose stem of four characters or more is in the clause (or holds it). file_id is null where none fits,
    which callers treat as an error; drafts without such a clause are left out."""
    clause = F.regexp_extract("instructions", r"(?:仅|只)(?:使用|依据|基于|引用|采用|保留)?([^。；;\n]{1,120})", 1)
    d = drafts.select("artifact_id", strip(clause).alias("scope")).filter("scope != ''").withColumn("norm", normalize_text(F.col("scope")))
    numbers = F.regexp_extract_all("scope", F.lit(r"(?<![0-9-])(\d{1,3})(?=\s*(?:号|、|,|，|和|及))"), F.lit(1))
    f = files.select("file_id", F.element_at(F.split("rel_path", "/"), -1).alias("fname"))
    f = f.select("file_id", F.nullif(F.regexp_extract("fname", r"^(\d{1,3})(?=\D)", 1), F.lit("")).cast("int").alias("number"), normalize_text(F.regexp_replace("fname", r"\.[^.]+$", "")).alias("stem"))
    f = f.distinct()
    # names in clauses and clauses in names; equal clauses and equal names meet once
    stems, norms = (x.distinct().filter("t != ''") for x in (f.filter(F.length("stem") >= 4).select(F.col("stem").alias("t")), d.select(F.col("norm").alias("t"))))
    pair = lambda needles, texts, a, b: contained(needles.select(F.col("t").alias("needle")), texts.select(F.col("t").alias("id"), "t"), 4).select(F.col("needle").alias(a), F.col("id").alias(b))
    met = stash(pair(stems, norms, "stem", "norm").unionByName(pair(norms, stems, "norm", "stem")).distinct(), "names")
    asked = stash(apart(d.select("artifact_id", "scope", "norm")).join(met, "norm", "left"), "drafts")
    named = dealt_pairs(asked.filter("stem IS NOT NULL").select("artifact_id", "scope", "stem"), f.filter(F.length("stem") >= 4).select("file_id", "stem"), "stem")
    # a file that both number and name allow comes by its name
    again = (F.length("stem") >= 4) & (F.col("norm") != "") & (F.contains("norm", "stem") | F.contains("stem", "norm"))
    listed = d.select("artifact_id", "scope", "norm", F.explode(F.array_distinct(F.transform(numbers, lambda x: x.cast("int")))).alias("number"))
    by_number = stash(apart(listed).join(f.filter("number IS NOT NULL"), "number").filter(~again).select("artifact_id", "scope", "file_id"), "numbered")
    none = asked.filter("stem IS NULL").select("artifact_id", "scope").join(by_number.select("artifact_id"), "artifact_id", "left_anti")
    out = named.select("artifact_id", "scope", "file_id").unionByName(by_number)
    return out.unionByName(none.select("artifact_id", "scope", F.lit(None).cast(out.schema["file_id"].dataType).alias("file_id")))


#: Pairs of a key that one part of dealt_pairs makes, about, and parts of a key at most.
PAIRS, PARTS = 1 << 21, 1 << 14


def dealt_pairs(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left and right joined by key where few keys make most pairs: the left rows of such a key are dealt to parts, each
    of which meets all its right rows; pairs are not shuffled."""
    sizes = left.groupBy(key).agg(F.count(F.lit(1)).alias("a")).join(right.groupBy(key).agg(F.count(F.lit(1)).alias("b")), key)
    sizes = stash(sizes.select(key, F.least(F.ceil(F.col("a") * F.col("b") / PAIRS), F.col("a"), F.lit(PARTS)).cast("int").alias("parts")), "pair-counts")
    n = max(1, min(4096, sizes.agg(F.sum("parts")).first()[0] or 1))
    columns = [c for c in left.columns if c != key]
    a = apart(left).join(sizes, key).withColumn("part", F.pmod(F.xxhash64(*columns), F.col("parts")).cast("int"))
    b = apart(right).join(sizes, key).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # with a number given, parts of few bytes are not put together again
    a, b = (x.drop("parts").repartition(n, key, "part") for x in (a, b))
    return apart(a).join(b, [key, "part"]).drop("part")
