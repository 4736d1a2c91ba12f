"""Queries of retrieval, evidence, evaluation, drafts, reports and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.rules import STOP_WORDS
from ..operators import changes, diff, evaluate, evidence, graph, quality, reports, retrieval, scan
from ..session import stash
from ..streaming import streams
from .fixtures import FILES, HISTORY, REQUESTS, SERVICES, SNAPSHOTS, TREE, customer_tree, files, history, questions, requests, services, table
from .registry import query

# Latin texts only: words are split at white space and ASCII punctuation
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_PUNCT = r"[\s!-/:-@\[-`{-~]+"
KW = rf"kw AS (SELECT item_id AS question_id, list_distinct(list_filter(list_transform(regexp_split_to_array(text, '{_PUNCT}'), lambda x: lower(x)), lambda x: length(x) >= 2 AND NOT list_contains([{_STOP}], x))) AS k FROM benchmark)"


def _norm(column: str) -> str:
    return f"regexp_replace(lower({column}), '{_PUNCT}', '', 'g')"


def _chunks(s, d):
    """Documents as chunks of files of their own."""
    t = table(s, d, "documents")
    return t.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("file_id"), F.lit(0).alias("seq"), F.lit("").alias("heading"), F.col("text").alias("content"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("rel_path"))


def _files(s, d):
    lab = table(s, d, "labels").select(F.col("doc_id").alias("file_id"), F.col("quality").cast("double").alias("relevance_score"), F.when(F.col("toxic") == 1, "OUT_OF_SCOPE").when(F.col("quality") == 0, "REFERENCE").otherwise("IN_SCOPE").alias("status"))
    f = files(s, d).join(lab, "file_id", "left")
    return f.select("file_id", "name", "rel_path", F.lit("").alias("doc_type"), F.lit("").alias("tags"), F.substring("text", 1, 60).alias("summary"), "status", "relevance_score", F.lit("PARSED").alias("parse_status"))


BOOST = "bo AS (SELECT d.doc_id, d.text, CASE WHEN toxic = 0 AND quality = 0 THEN 0.35::DOUBLE WHEN coalesce(quality, 0) <= 0 THEN 1.0::DOUBLE ELSE greatest(0.45::DOUBLE, least(1.2::DOUBLE, quality + 0.25::DOUBLE)) END AS boost FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"


@query("tokenize_question", f"WITH {KW} SELECT question_id, array_to_string(list_sort(k), ',') AS keywords FROM kw")
def _(s, d):
    return questions(s, d).select("question_id", F.array_join(F.array_sort(tx.tokenize_question(F.col("question"), STOP_WORDS)), ",").alias("keywords"))


@query("normalize_text", f"SELECT doc_id, md5({_norm('text')}) AS digest FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(tx.normalize_text(F.col("text"))).alias("digest"))


@query("normalize_query", f"SELECT item_id AS question_id, {_norm('text')} AS core FROM benchmark")
def _(s, d):
    return questions(s, d).select("question_id", tx.normalize_query(F.concat("question", F.lit("有哪些？")), ["有哪些", "是什么"]).alias("core"))


HITS = f"{KW}, w AS (SELECT DISTINCT unnest(k) AS keyword FROM kw), hits AS (SELECT keyword, doc_id AS chunk_id, row_number() OVER (PARTITION BY keyword ORDER BY doc_id) AS r FROM w JOIN documents ON contains(lower(text), keyword)), hc AS (SELECT keyword, chunk_id FROM hits WHERE r <= 30), hd AS (SELECT keyword, count(*) AS df FROM hc GROUP BY 1)"


@query("keyword_hits", f"WITH {HITS} SELECT hc.keyword, chunk_id, df FROM hc JOIN hd ON hd.keyword = hc.keyword")
def _(s, d):
    return retrieval.keyword_hits(questions(s, d), _chunks(s, d))


SCORES = f"""{HITS}, {BOOST}, raw AS (SELECT question_id, chunk_id, CAST(sum(CAST((1.0::DOUBLE / ln(2 + df)) * boost AS DECIMAL(18,9))) AS DOUBLE) AS raw, any_value(length(text)) AS len FROM (SELECT question_id, unnest(k) AS keyword FROM kw) q JOIN hc ON hc.keyword = q.keyword JOIN hd ON hd.keyword = q.keyword JOIN bo ON doc_id = chunk_id GROUP BY 1, 2),
sc AS (SELECT question_id, chunk_id, raw / (1 + ln(1 + len / 200.0::DOUBLE)) AS s FROM raw), lex AS (SELECT question_id, chunk_id, s / max(s) OVER (PARTITION BY question_id) AS score FROM sc)"""


def _lexical(s, d):
    q, c, f = questions(s, d), _chunks(s, d), _files(s, d)
    return retrieval.lexical_scores(q, c, f, retrieval.keyword_hits(q, c))


@query("lexical_scores", f"WITH {SCORES} SELECT question_id, chunk_id, round(score, 6) AS score FROM lex")
def _(s, d):
    return _lexical(s, d).select("question_id", "chunk_id", F.round("score", 6).alias("score"))


@query("retrieval_scope", "SELECT d.doc_id AS file_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE coalesce(toxic, 0) = 0 AND coalesce(quality, 1) = 1")
def _(s, d):
    return retrieval.retrieval_scope(_files(s, d)).filter("NOT reference").select("file_id")


@query("in_scope", """WITH f AS (SELECT d.doc_id, coalesce(toxic, 0) = 0 AS usable, coalesce(toxic, 0) = 0 AND coalesce(quality, 1) = 0 AS reference FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
r AS (SELECT DISTINCT l_orderkey AS question_id, l_suppkey AS file_id FROM lineitem), q AS (SELECT l_orderkey AS question_id, bool_or(l_quantity > 25) AS asks FROM lineitem GROUP BY 1)
SELECT r.question_id, r.file_id FROM r JOIN f ON f.doc_id = r.file_id JOIN q ON q.question_id = r.question_id WHERE usable AND (NOT reference OR asks)""")
def _(s, d):
    # orders as questions, their suppliers' numbers as the files that they hit
    li = table(s, d, "lineitem")
    q = li.select(F.col("l_orderkey").alias("question_id"), F.when(F.col("l_quantity") > 25, "请参考模板").otherwise("in short").alias("question"))
    rows = li.select(F.col("l_orderkey").alias("question_id"), F.col("l_suppkey").alias("file_id")).distinct()
    return retrieval.in_scope(rows, retrieval.retrieval_scope(_files(s, d)), q)


@query("relevance_boost", f"WITH {BOOST} SELECT doc_id AS file_id, boost FROM bo")
def _(s, d):
    return _files(s, d).select("file_id", retrieval.relevance_boost(F.col("status"), F.col("relevance_score")).alias("boost"))


def _slice(n):
    return f"regexp_replace(lower(substr(text, 1, {n})), '{_PUNCT}', '', 'g')"


@query("metadata_score", rf"""WITH {KW}, {BOOST}, m AS (SELECT d.doc_id, {_norm("source || '/' || lang || '/doc_' || d.doc_id || '.md doc_' || d.doc_id || '.md'")} AS nm, {_norm("substr(d.text, 1, 60)")} AS sm, boost FROM documents d JOIN bo ON bo.doc_id = d.doc_id),
kk AS (SELECT q.question_id, {_norm('b.text')} AS core, unnest(q.k) AS w FROM kw q JOIN benchmark b ON b.item_id = q.question_id),
p AS (SELECT question_id, doc_id, any_value(boost) AS boost, sum(CASE WHEN contains(meta, w) THEN CASE WHEN length(w) >= 4 THEN 120 ELSE 45 END ELSE 0 END + CASE WHEN contains(nm, w) THEN CASE WHEN length(w) >= 4 THEN 120 ELSE 45 END ELSE 0 END) / 100.0::DOUBLE + CASE WHEN contains(any_value(meta), any_value(core)) THEN 8 ELSE 0 END + CASE WHEN contains(any_value(nm), any_value(core)) THEN 10 ELSE 0 END AS x FROM kk, (SELECT *, nm || sm AS meta FROM m) GROUP BY 1, 2)
SELECT question_id, doc_id AS chunk_id, round(x * boost, 6) AS score FROM p WHERE x >= 1.8""")
def _(s, d):
    out = retrieval.metadata_scores(questions(s, d), _files(s, d), _chunks(s, d))
    return out.select("question_id", "chunk_id", F.round("score", 6).alias("score"))


@query("length_normalize", "SELECT question_id, chunk_id, round(s / max(s) OVER (PARTITION BY question_id), 6) AS score FROM (SELECT l_orderkey AS question_id, l_linenumber * 1000000 + l_partkey AS chunk_id, l_quantity / (1 + ln(1 + l_suppkey / 200.0::DOUBLE)) AS s FROM (SELECT l_orderkey, l_linenumber, l_partkey, max(l_quantity) AS l_quantity, max(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2, 3))")
def _(s, d):
    li = table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.max("l_quantity").alias("raw"), F.max("l_suppkey").alias("len"))
    out = retrieval.length_normalize(li.select(F.col("l_orderkey").alias("question_id"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("chunk_id"), "raw", "len"))
    return out.select("question_id", "chunk_id", F.round("score", 6).alias("score"))


SIM = rf"""qg AS (SELECT question_id, list_distinct(list_transform(range(1, length(t)), lambda i: substr(t, i, 2))) AS g FROM (SELECT item_id AS question_id, {_norm('text')} AS t FROM benchmark)),
tg AS (SELECT doc_id AS chunk_id, list_distinct(list_transform(range(1, length(t)), lambda i: substr(t, i, 2))) AS g FROM (SELECT doc_id, {_norm('text')} AS t FROM documents)),
qe AS (SELECT question_id, len(g) AS nq, unnest(g) AS g FROM qg), te AS (SELECT chunk_id, len(g) AS nt, unnest(g) AS g FROM tg),
sim AS (SELECT question_id, chunk_id, least(1.0::DOUBLE, 0.35::DOUBLE * (2.0::DOUBLE * count(*) / (any_value(nq) + any_value(nt))) + 0.65::DOUBLE * (count(*)::DOUBLE / any_value(nq))) AS score FROM qe JOIN te ON qe.g = te.g GROUP BY 1, 2)"""


def _similar(s, d):
    t = table(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return retrieval.bigram_similarity(questions(s, d), t, limit=None)


@query("bigram_similarity", f"WITH {SIM} SELECT question_id, chunk_id, round(score, 6) AS score FROM sim")
def _(s, d):
    return _similar(s, d).select("question_id", "chunk_id", F.round("score", 6).alias("score"))


POOL = "pool AS (SELECT question_id, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS r FROM (SELECT question_id, chunk_id, round(score, 9) AS score FROM sim)) WHERE score >= 0.08 AND r <= 80)"


def _pool(s, d):
    t = table(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return retrieval.best_similar(stash(retrieval.question_grams(questions(s, d)), "question-grams"), stash(retrieval.text_grams(t, limit=None), "text-grams"))


@query("pair_similarity", f"WITH {SIM}, hp AS (SELECT DISTINCT item_id AS question_id, l_suppkey AS chunk_id FROM lineitem JOIN benchmark ON item_id = l_orderkey % 1000) SELECT sim.question_id, sim.chunk_id, round(score, 6) AS score FROM sim JOIN hp ON hp.question_id = sim.question_id AND hp.chunk_id = sim.chunk_id")
def _(s, d):
    t = table(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    pairs = table(s, d, "lineitem").select((F.col("l_orderkey") % 1000).alias("question_id"), F.col("l_suppkey").alias("chunk_id")).distinct()
    return retrieval.pair_similarity(pairs, retrieval.question_grams(questions(s, d)), retrieval.text_grams(t, limit=None), 6)


@query("semantic_pool", f"WITH {SIM}, {POOL} SELECT question_id, chunk_id, round(score, 6) AS score FROM pool")
def _(s, d):
    return _pool(s, d).select("question_id", "chunk_id", F.round("score", 6).alias("score"))


RANK = rf"""j AS (SELECT coalesce(l.question_id, p.question_id) AS question_id, coalesce(l.chunk_id, p.chunk_id) AS chunk_id, coalesce(l.score, 0) AS lex, coalesce(p.score, 0) AS sem FROM lex l FULL JOIN pool p ON p.question_id = l.question_id AND p.chunk_id = l.chunk_id),
tx AS (SELECT doc_id, {_norm('text')} AS tn FROM documents), qx AS (SELECT item_id, {_norm('text')} AS qn FROM benchmark),
r0 AS (SELECT j.question_id, chunk_id, round(least(1.0::DOUBLE, 0.52::DOUBLE * lex + 0.33::DOUBLE * sem + 0.15::DOUBLE * CASE WHEN len(k) = 0 THEN 0 ELSE least(1.0::DOUBLE, len(list_filter(k, lambda w: contains(tn, w)))::DOUBLE / greatest(1, least(len(k), 8))) END + CASE WHEN length(qn) >= 3 AND contains(tn, qn) THEN 0.12::DOUBLE ELSE 0 END), 9) AS score
  FROM j JOIN tx ON doc_id = chunk_id JOIN qx ON item_id = j.question_id JOIN kw ON kw.question_id = j.question_id),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM r0 WHERE score >= 0.06) WHERE rank <= 10)"""


def _ranked(s, d):
    t = table(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("file_id"), "text")
    return retrieval.hybrid_rerank(questions(s, d), t, _lexical(s, d), _pool(s, d))


@query("hybrid_rerank", f"WITH {SCORES}, {SIM}, {POOL}, {RANK} SELECT question_id, chunk_id, round(score, 6) AS score, rank FROM ranked")
def _(s, d):
    return _ranked(s, d).select("question_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("keyword_coverage", rf"""WITH {KW}, tx AS (SELECT doc_id, {_norm('text')} AS tn FROM documents) SELECT kw.question_id, doc_id AS chunk_id, round(least(1.0::DOUBLE, len(list_filter(k, lambda w: contains(tn, w)))::DOUBLE / least(len(k), 8)), 6) AS coverage
FROM kw JOIN benchmark b ON b.item_id = kw.question_id JOIN tx ON doc_id = kw.question_id WHERE len(k) > 0""")
def _(s, d):
    # each question with the document of its number
    q = questions(s, d).select("question_id", tx.tokenize_question(F.col("question"), STOP_WORDS).alias("kw")).filter("size(kw) > 0")
    t = table(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), tx.normalize_text(F.col("text")).alias("tn"))
    j = q.join(t, F.col("question_id") == F.col("chunk_id"))
    return j.select("question_id", "chunk_id", F.round(retrieval.keyword_coverage(F.col("kw"), F.col("tn")), 6).alias("coverage"))


@query("keyword_coverage_ranked", rf"""WITH {SCORES}, {SIM}, {POOL}, {RANK} SELECT r.question_id, chunk_id, round(CASE WHEN len(k) = 0 THEN 0 ELSE least(1.0::DOUBLE, len(list_filter(k, lambda w: contains(tn, w)))::DOUBLE / greatest(1, least(len(k), 8))) END, 6) AS coverage
FROM ranked r JOIN tx ON doc_id = chunk_id JOIN kw ON kw.question_id = r.question_id""")
def _(s, d):
    q = questions(s, d).select("question_id", tx.tokenize_question(F.col("question"), STOP_WORDS).alias("kw"))
    t = table(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), tx.normalize_text(F.col("text")).alias("tn"))
    cov = retrieval.keyword_coverage(F.col("kw"), F.col("tn"))
    return _ranked(s, d).select("question_id", "chunk_id").join(q, "question_id").join(t, "chunk_id").select("question_id", "chunk_id", F.round(cov, 6).alias("coverage"))


# the whole retrieval, written from what each step is to give: canonical files in scope, hits and metadata, pool, rerank
RETRIEVE = rf"""{HITS}, {BOOST},
us AS (SELECT doc_id, path, summary, text, boost FROM (SELECT d.doc_id, d.text, boost, d.source || '/' || d.lang || '/doc_' || d.doc_id || '.md' AS path, substr(d.text, 1, 60) AS summary, coalesce(toxic, 0) = 0 AND coalesce(quality, 1) = 1 AS ok,
  row_number() OVER (PARTITION BY d.source, sha256(d.text) ORDER BY coalesce(quality, 0) DESC, length(d.source || d.lang || d.doc_id), d.doc_id) AS r FROM documents d JOIN bo ON bo.doc_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id) WHERE r = 1 AND ok),
m AS (SELECT doc_id, boost, {_norm("path || ' doc_' || doc_id || '.md'")} AS nm, {_norm("summary")} AS sm FROM us),
kk AS (SELECT q.question_id, {_norm('b.text')} AS core, unnest(q.k) AS w FROM kw q JOIN benchmark b ON b.item_id = q.question_id),
me AS (SELECT question_id, doc_id AS chunk_id, x * boost AS w FROM (SELECT question_id, doc_id, any_value(boost) AS boost, sum(CASE WHEN contains(nm || sm, w) THEN CASE WHEN length(w) >= 4 THEN 120 ELSE 45 END ELSE 0 END + CASE WHEN contains(nm, w) THEN CASE WHEN length(w) >= 4 THEN 120 ELSE 45 END ELSE 0 END) / 100.0::DOUBLE
  + CASE WHEN contains(any_value(nm || sm), any_value(core)) THEN 8 ELSE 0 END + CASE WHEN contains(any_value(nm), any_value(core)) THEN 10 ELSE 0 END AS x FROM kk, m GROUP BY 1, 2) WHERE x >= 1.8),
ra AS (SELECT question_id, chunk_id, CAST(sum(w) AS DOUBLE) AS raw FROM (SELECT question_id, hc.chunk_id, CAST((1.0::DOUBLE / ln(2 + df)) * boost AS DECIMAL(18,9)) AS w FROM (SELECT question_id, unnest(k) AS keyword FROM kw) q JOIN hc ON hc.keyword = q.keyword JOIN hd ON hd.keyword = q.keyword JOIN us ON doc_id = hc.chunk_id
  UNION ALL SELECT question_id, chunk_id, CAST(w AS DECIMAL(18,9)) FROM me) GROUP BY 1, 2),
lx AS (SELECT question_id, chunk_id, s / max(s) OVER (PARTITION BY question_id) AS lex FROM (SELECT question_id, chunk_id, raw / (1 + ln(1 + length(text) / 200.0::DOUBLE)) AS s FROM ra JOIN us ON doc_id = chunk_id)),
tx AS (SELECT doc_id, {_norm("path || ' ' || summary || ' ' || text")} AS tn FROM us), qx AS (SELECT item_id, {_norm('text')} AS qn FROM benchmark),
qe AS (SELECT item_id AS question_id, len(g) AS nq, unnest(g) AS g FROM (SELECT item_id, list_distinct(list_transform(range(1, length(qn)), lambda i: substr(qn, i, 2))) AS g FROM qx)),
te AS (SELECT doc_id AS chunk_id, len(g) AS nt, unnest(g) AS g FROM (SELECT doc_id, list_distinct(list_transform(range(1, least(length(tn), 8000)), lambda i: substr(tn, i, 2))) AS g FROM tx)),
si AS (SELECT question_id, chunk_id, round(least(1.0::DOUBLE, 0.35::DOUBLE * (2.0::DOUBLE * count(*) / (any_value(nq) + any_value(nt))) + 0.65::DOUBLE * (count(*)::DOUBLE / any_value(nq))), 9) AS sem FROM qe JOIN te ON qe.g = te.g GROUP BY 1, 2),
po AS (SELECT question_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY sem DESC, chunk_id) AS r FROM si WHERE sem >= 0.08) WHERE r <= 80 UNION SELECT question_id, chunk_id FROM lx),
sc AS (SELECT po.question_id, po.chunk_id, round(least(1.0::DOUBLE, 0.52::DOUBLE * coalesce(lex, 0) + 0.33::DOUBLE * coalesce(sem, 0) + 0.15::DOUBLE * least(1.0::DOUBLE, len(list_filter(k, lambda w: contains(tn, w)))::DOUBLE / least(len(k), 8)) + CASE WHEN length(qn) >= 3 AND contains(tn, qn) THEN 0.12::DOUBLE ELSE 0 END), 9) AS score
  FROM po JOIN kw ON kw.question_id = po.question_id AND len(k) > 0 JOIN tx ON doc_id = po.chunk_id JOIN qx ON item_id = po.question_id LEFT JOIN lx ON lx.question_id = po.question_id AND lx.chunk_id = po.chunk_id LEFT JOIN si ON si.question_id = po.question_id AND si.chunk_id = po.chunk_id)
SELECT question_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM sc WHERE score >= 0.06) WHERE rank <= 10"""


@query("retrieve", f"WITH {RETRIEVE}")
def _(s, d):
    f = _files(s, d).join(files(s, d).select("file_id", "project", "sha256", "deleted"), "file_id")
    return retrieval.retrieve(questions(s, d), _chunks(s, d), f).select("question_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("naive_keyword_topk", rf"""WITH {KW}, w AS (SELECT question_id, unnest(k) AS w FROM kw), c AS (SELECT question_id, doc_id AS chunk_id, sum((length(t) - length(replace(t, w, ''))) // length(w)) AS hits FROM w JOIN (SELECT doc_id, lower(text) AS t FROM documents) ON contains(t, w) GROUP BY 1, 2)
SELECT question_id, chunk_id, CAST(hits AS BIGINT) AS hits, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY hits DESC, chunk_id) AS rank FROM c) WHERE rank <= 3""")
def _(s, d):
    return retrieval.naive_keyword_topk(questions(s, d), _chunks(s, d))


@query("char_hash_embedding", """WITH c AS (SELECT item_id, i, unicode(substr(text, i + 1, 1)) % 31 AS v FROM (SELECT item_id, text, unnest(range(0, length(text))) AS i FROM benchmark)),
v AS (SELECT item_id, i % 8 AS k, sum(v) AS x FROM c GROUP BY 1, 2) SELECT item_id AS question_id, k, round(x / sqrt(sum(x * x) OVER (PARTITION BY item_id)), 6) AS value FROM v""")
def _(s, d):
    q = questions(s, d).select("question_id", F.posexplode(tx.char_hash_embedding(F.col("question"))).alias("k", "v"))
    return q.select("question_id", "k", F.round("v", 6).alias("value"))


def _entities(s, d):
    """Words of part names as entities."""
    p = table(s, d, "part")
    return p.select(F.explode(F.split("p_name", " ")).alias("name"), "p_type").groupBy("name").agg(F.min("p_type").alias("type"), F.count(F.lit(1)).cast("string").alias("summary"), F.min("p_type").alias("description"))


ENT = "ent AS (SELECT name, min(p_type) AS type, CAST(count(*) AS VARCHAR) AS summary FROM (SELECT unnest(string_split(p_name, ' ')) AS name, p_type FROM part) GROUP BY 1), pq AS (SELECT p_partkey AS question_id, 'Is the ' || p_name || ' good?' AS question FROM part)"
SEED = f"{ENT}, seed AS (SELECT question_id, name, 150 AS score, row_number() OVER (PARTITION BY question_id ORDER BY name) AS rank FROM pq JOIN ent ON contains(lower(question), lower(name)) QUALIFY rank <= 4)"


def _part_questions(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("question_id"), F.concat(F.lit("Is the "), "p_name", F.lit(" good?")).alias("question"))


@query("seed_entities", f"WITH {SEED} SELECT question_id, name, score, rank FROM seed")
def _(s, d):
    return evidence.seed_entities(_part_questions(s, d), _entities(s, d))


@query("seed_entities_alias", f"WITH {ENT} SELECT DISTINCT question_id, name FROM pq JOIN ent ON contains(question, name)")
def _(s, d):
    return evidence.seed_entities_alias(_part_questions(s, d), _entities(s, d))


RELN = "rel AS (SELECT split_part(p_name, ' ', 1) AS source, split_part(p_name, ' ', 2) AS target, p_brand AS edge_type, max(p_size)::DOUBLE AS weight FROM part GROUP BY 1, 2, 3)"
LOCAL = f"{SEED}, {RELN}, loc AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY weight DESC, source, target, edge_type) AS rank FROM (SELECT DISTINCT question_id, source, target, edge_type, weight FROM rel JOIN seed ON name = source OR name = target) QUALIFY rank <= 18)"


def _relations(s, d):
    return table(s, d, "part").groupBy(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("source"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("target"), F.col("p_brand").alias("edge_type")).agg(F.max("p_size").cast("double").alias("weight"))


@query("local_relations", f"WITH {LOCAL} SELECT question_id, source, target, edge_type, weight, rank FROM loc")
def _(s, d):
    return evidence.local_relations(evidence.seed_entities(_part_questions(s, d), _entities(s, d)), _relations(s, d)).select("question_id", "source", "target", "edge_type", "weight", "rank")


@query("graph_facts", f"""WITH {LOCAL}, l AS (SELECT question_id, 0 AS k, rank, 'Seed entity: ' || seed.name || '; type=' || type || '; summary=' || summary AS line FROM seed JOIN ent ON ent.name = seed.name UNION ALL SELECT question_id, 1, rank, 'Relation: ' || source || ' --[' || edge_type || ']--> ' || target FROM loc)
SELECT question_id, string_agg(line, chr(10) ORDER BY k, rank) AS facts FROM l GROUP BY 1""")
def _(s, d):
    seeds, e = evidence.seed_entities(_part_questions(s, d), _entities(s, d)), _entities(s, d)
    return evidence.graph_facts(seeds, e, evidence.local_relations(seeds, _relations(s, d)))


# the first two words of each benchmark text as a label, and the item itself as evidence
@query("local_evidence_chunks", r"""WITH l AS (SELECT item_id AS q, lower(split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2)) AS label FROM benchmark),
h AS (SELECT q, doc_id AS c, row_number() OVER (PARTITION BY q ORDER BY doc_id) AS b FROM l JOIN documents ON contains(lower(text), label) WHERE label <> ' '), x AS (SELECT item_id AS q, item_id AS c, 0 AS k, 1 AS a, 0 AS b FROM benchmark UNION ALL SELECT q, c, 1, 0, b FROM h WHERE b <= 2),
o AS (SELECT q, c, min((k, a, b)) AS place FROM x GROUP BY 1, 2) SELECT q AS question_id, c AS chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY place, c) AS rank FROM o) WHERE rank <= 8""")
def _(s, d):
    q = questions(s, d)
    labels = q.select("question_id", F.concat_ws(" ", F.split_part("question", F.lit(" "), F.lit(1)), F.split_part("question", F.lit(" "), F.lit(2))).alias("label"), F.lit(0).alias("place")).filter("label != ' '")
    rel = q.select("question_id", F.lit(1).alias("rank"), F.col("question_id").alias("evidence_chunk_id"))
    return evidence.local_evidence_chunks(rel, labels, _chunks(s, d), q.select("question_id", F.lit(-1).cast("long").alias("chunk_id")))


@query("k_hop_subgraph", """WITH RECURSIVE e AS (SELECT DISTINCT c_custkey AS a, 'n' || c_nationkey AS b FROM customer), u AS (SELECT 'c' || a AS x, b AS y FROM e UNION SELECT b, 'c' || a FROM e),
w AS (SELECT r_regionkey AS question_id, 'n' || n_nationkey AS name, 0 AS hop FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey = r_regionkey OR true UNION SELECT w.question_id, y, hop + 1 FROM w JOIN u ON x = name WHERE hop < 2)
SELECT question_id, name, min(hop) AS hop FROM w GROUP BY 1, 2""")
def _(s, d):
    n, c = table(s, d, "nation"), table(s, d, "customer")
    seeds = n.select(F.col("n_regionkey").alias("question_id"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("name"))
    e = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("source"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("target"))
    return evidence.k_hop_subgraph(seeds, e, hops=2)


@query("expand_and_dedupe", "SELECT question_id, chunk_id, max(score) AS score FROM (SELECT l_orderkey AS question_id, l_partkey AS chunk_id, l_discount * 10 AS score FROM lineitem UNION ALL SELECT l_orderkey, l_suppkey, 0.45::DOUBLE FROM lineitem) GROUP BY 1, 2")
def _(s, d):
    li = table(s, d, "lineitem")
    return evidence.expand_and_dedupe(li.select(F.col("l_orderkey").alias("question_id"), F.col("l_partkey").alias("chunk_id"), (F.col("l_discount") * 10).alias("score")), li.select(F.col("l_orderkey").alias("question_id"), F.col("l_suppkey").alias("chunk_id")))


_ANSWERS = f"{SCORES}, {SIM}, {POOL}, {RANK}"


@query("build_contexts", f"WITH {_ANSWERS} SELECT question_id, md5(string_agg('【来源：' || source || '/' || lang || '/' || doc_id || '】' || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS digest FROM ranked JOIN documents ON doc_id = chunk_id GROUP BY 1")
def _(s, d):
    return evidence.build_contexts(_ranked(s, d).select("question_id", "chunk_id", "rank"), _chunks(s, d)).select("question_id", F.md5("contexts").alias("digest"))


def _conversation_blocks(s, d):
    return table(s, d, "conversations").groupBy(F.col("conv_id").alias("question_id"), F.col("turn").alias("rank")).agg(F.min("text").alias("block"))


@query("budgeted_contexts", "WITH c AS (SELECT conv_id AS question_id, turn AS rank, substr(min(text), 1, 100) AS block FROM conversations GROUP BY 1, 2) SELECT question_id, rank, block FROM (SELECT *, sum(length(block)) OVER (PARTITION BY question_id ORDER BY rank) AS used FROM c) WHERE used <= 350")
def _(s, d):
    return evidence.budgeted_contexts(_conversation_blocks(s, d), each=100, total=350)


@query("revision_contexts", """WITH e AS (SELECT o_custkey AS artifact_id, CASE WHEN o_orderstatus = 'F' THEN o_orderkey END AS chunk_id, o_orderkey AS file_id FROM orders), c AS (SELECT DISTINCT l_orderkey AS chunk_id, l_orderkey AS file_id FROM lineitem),
a AS (SELECT artifact_id, e.chunk_id, 'p. 1' AS location FROM e JOIN c ON c.chunk_id = e.chunk_id)
SELECT * FROM a UNION ALL SELECT DISTINCT artifact_id, c.chunk_id, '' FROM e JOIN c ON c.file_id = e.file_id WHERE artifact_id NOT IN (SELECT artifact_id FROM a)""")
def _(s, d):
    o = table(s, d, "orders")
    e = o.select(F.col("o_custkey").alias("artifact_id"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")).alias("chunk_id"), F.col("o_orderkey").alias("file_id"), F.lit(None).cast("string").alias("cell_range"), F.lit(1).alias("page_no"), F.lit("h").alias("heading_path"))
    c = table(s, d, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_orderkey").alias("file_id"), F.lit(0).alias("seq"), F.lit(None).cast("string").alias("heading")).distinct()
    return evidence.revision_contexts(e, c)


@query("draft_query", "SELECT p_partkey AS artifact_id, p_name || ' ' || CASE WHEN p_size < 25 THEN 'size ' || p_size ELSE 'default ' || p_type END AS query FROM part")
def _(s, d):
    p = table(s, d, "part")
    drafts = p.select(F.col("p_partkey").alias("artifact_id"), F.col("p_type").alias("artifact_type"), F.col("p_name").alias("title"), F.when(F.col("p_size") < 25, F.concat(F.lit("size "), F.col("p_size").cast("string"))).otherwise(" ").alias("instructions"))
    return evidence.draft_query(drafts, p.select(F.col("p_type").alias("artifact_type"), F.concat(F.lit("default "), "p_type").alias("keywords")).distinct())


@query("global_contexts", "SELECT DISTINCT l_orderkey AS question_id, 'chunk' AS kind, CAST(l_partkey AS VARCHAR) AS item, CAST(l_linenumber AS BIGINT) AS rank FROM lineitem UNION ALL SELECT o, 'community', CAST(r_regionkey AS VARCHAR), CAST(r_regionkey AS BIGINT) FROM (SELECT DISTINCT l_orderkey AS o FROM lineitem), region")
def _(s, d):
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.col("l_partkey").alias("chunk_id"), F.col("l_linenumber").alias("rank")).distinct()
    return evidence.global_contexts(li, table(s, d, "region").select(F.col("r_regionkey").alias("community_no")))


@query("classify_answer", f"WITH {HISTORY} SELECT conv_id, turn, a = '' AS blank, a = '' OR contains(a, '无法判断') AS no_answer, a = '' OR (NOT g AND NOT contains(a, '无法判断')) AS provider_failure, a = '' OR (NOT g AND contains(lower(coalesce(answer, '')), '502')) AS retryable FROM (SELECT *, regexp_replace(coalesce(answer, ''), '\\s+', '', 'g') AS a, length(question) >= 100 AS g FROM h)")
def _(s, d):
    h = history(s, d)
    return h.select("conv_id", "turn", evidence.classify_answer(F.col("answer"), F.length("question") >= 100).alias("c")).select("conv_id", "turn", "c.*")


@query("citation_threshold", "SELECT o_orderkey, CASE WHEN m <= 0 THEN 1000000 ELSE least(m, greatest(0.35::DOUBLE, m * 0.4::DOUBLE)) END AS threshold FROM (SELECT l_orderkey AS o_orderkey, max(l_discount) * 20 - 1 AS m FROM lineitem GROUP BY 1)")
def _(s, d):
    m = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.max("l_discount") * 20 - 1).alias("m"))
    return m.select("o_orderkey", F.least(evidence.citation_threshold(F.col("m")), F.lit(1000000.0)).alias("threshold"))


CITED = """r AS (SELECT l_orderkey AS q, 'dir/p' || l_partkey || '.md' AS file_name, l_linenumber * 1000000 + l_suppkey AS chunk_id, max(l_quantity) / 50 AS score FROM lineitem GROUP BY 1, 2, 3), an AS (SELECT o_orderkey AS q, 'see p' || o_custkey || '.md' AS answer FROM orders WHERE o_orderstatus <> 'P'),
m AS (SELECT r.*, answer, max(score) OVER (PARTITION BY r.q) AS best FROM r JOIN an ON an.q = r.q),
o AS (SELECT *, row_number() OVER (PARTITION BY q, file_name ORDER BY score DESC, chunk_id) AS k FROM m WHERE score >= least(best, greatest(0.35::DOUBLE, best * 0.4::DOUBLE)) OR contains(answer, split_part(file_name, '/', 2))),
ct AS (SELECT q AS question_id, file_name, chunk_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, chunk_id, file_name) AS rank FROM o WHERE k = 1 QUALIFY rank <= 6)"""


def _scored(s, d):
    li = table(s, d, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("question_id"), F.concat(F.lit("dir/p"), F.col("l_partkey").cast("string"), F.lit(".md")).alias("file_name"), (F.col("l_linenumber") * 1_000_000 + F.col("l_suppkey")).alias("chunk_id")).agg((F.max("l_quantity") / 50).alias("score"))


def _order_answers(s, d):
    o = table(s, d, "orders")
    return o.select(F.col("o_orderkey").alias("question_id"), F.concat(F.lit("see p"), F.col("o_custkey").cast("string"), F.lit(".md")).alias("answer"), (F.col("o_orderstatus") != "P").alias("grounded"))


@query("select_citations", f"WITH {CITED} SELECT question_id, file_name, chunk_id, round(score, 6) AS score, rank FROM ct")
def _(s, d):
    return evidence.select_citations(_scored(s, d), _order_answers(s, d)).select("question_id", "file_name", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("evidence_trace", rf"WITH {_ANSWERS} SELECT question_id, chunk_id, source || '/' || lang || '/' || doc_id AS rel_path, CASE WHEN length(t) > 220 THEN substr(t, 1, 220) || '...' ELSE t END AS preview FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM ranked JOIN documents ON doc_id = chunk_id)")
def _(s, d):
    return evidence.evidence_trace(_ranked(s, d), _chunks(s, d))


@query("ask_history_view", """WITH h AS (SELECT o_orderkey AS id, o_orderdate AS created_at, CASE WHEN o_orderstatus = 'F' THEN 'named b.md' ELSE '' END AS answer, o_orderstatus <> 'P' AS g, o_totalprice FROM orders)
SELECT id, CASE WHEN answer = '' THEN 'The model is not available at present.' ELSE answer END AS answer, CASE WHEN NOT g THEN 0 WHEN answer = '' THEN 1 ELSE 2 END AS citation_count FROM h ORDER BY created_at DESC, id DESC LIMIT 100""")
def _(s, d):
    o = table(s, d, "orders")
    cites = '[{"file_name":"x/a.md","heading_path":"","chunk_id":1,"score":1.0},{"file_name":"x/b.md","heading_path":"","chunk_id":2,"score":0.4},{"file_name":"x/b.md","heading_path":"","chunk_id":3,"score":0.2}]'
    h = o.select(F.col("o_orderkey").alias("id"), F.lit("p").alias("project_id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "F", "named b.md").otherwise("").alias("answer"), (F.col("o_orderstatus") != "P").alias("grounded"), F.lit(cites).alias("citations_json"))
    return evidence.ask_history_view(h, "p", size=200).select("id", "answer", "citation_count")


@query("split_expectations", r"SELECT item_id, array_to_string(list_distinct(list_filter(list_transform(regexp_split_to_array(text, '[\n,;]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')).list_sort(), '|') AS parts FROM benchmark")
def _(s, d):
    return table(s, d, "benchmark").select("item_id", F.array_join(F.array_sort(evaluate.split_expectations(F.col("text"))), "|").alias("parts"))


GOLD = """g AS (SELECT o_orderkey AS q, 'p' || o_custkey || ',see' AS kw, 'p' || (o_custkey + 1) || '.md' AS src FROM orders), cf AS (SELECT question_id AS q, list(file_name) AS files FROM ct GROUP BY 1),
sa AS (SELECT g.q AS question_id, 1.0::DOUBLE AS k, CASE WHEN len(list_filter(coalesce(files, []), lambda f: contains(f, g.src))) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS s, o_orderstatus <> 'P' AS gr FROM g JOIN orders ON o_orderkey = g.q LEFT JOIN cf ON cf.q = g.q)"""


def _golden(s, d):
    o = table(s, d, "orders")
    k = F.col("o_custkey")
    return o.select(F.col("o_orderkey").alias("question_id"), F.concat(F.lit("p"), k.cast("string"), F.lit(",see")).alias("expected_keywords"), F.concat(F.lit("p"), (k + 1).cast("string"), F.lit(".md")).alias("expected_source_patterns"))


def _with_citations(s, d):
    a = _order_answers(s, d)
    c = evidence.select_citations(_scored(s, d), a).groupBy("question_id").agg(F.collect_list(F.struct("file_name")).alias("citations"))
    return a.join(c, "question_id", "left")


@query("score_answers", f"WITH {CITED}, {GOLD} SELECT question_id, k AS keyword_coverage, s AS source_coverage, round(0.65::DOUBLE * k + 0.25::DOUBLE * s + CASE WHEN gr THEN 0.1::DOUBLE ELSE 0 END, 6) AS score, gr AND k >= 0.7 AND s >= 0.5 AS passed FROM sa")
def _(s, d):
    out = evaluate.score_answers(_golden(s, d), _with_citations(s, d))
    return out.select("question_id", "keyword_coverage", "source_coverage", F.round("score", 6).alias("score"), "passed")


@query("evaluation_run", f"WITH {CITED}, {GOLD} SELECT count(*) AS total, count(*) FILTER (gr AND s >= 0.5) AS passed, round(CAST(avg(0.65::DOUBLE * k + 0.25::DOUBLE * s + CASE WHEN gr THEN 0.1::DOUBLE ELSE 0 END) AS DOUBLE), 6) AS mean_score, 'COMPLETED' AS status FROM sa")
def _(s, d):
    out = evaluate.evaluation_run(evaluate.score_answers(_golden(s, d), _with_citations(s, d)))
    return out.select("total", "passed", F.round("mean_score", 6).alias("mean_score"), "status")


@query("experiment_cases", """SELECT c_custkey::VARCHAR AS id, m AS mode, m = 'local' OR c_acctbal >= 0 AS grounded_ok, c_mktsegment = 'BUILDING' OR c_nationkey > 5 AS any_file_ok, contains(lower(c_mktsegment), 'ing') AS any_term_ok,
(m = 'local' OR c_acctbal >= 0) AND (c_mktsegment = 'BUILDING' OR c_nationkey > 5) AND contains(lower(c_mktsegment), 'ing') AS passed FROM customer, (SELECT unnest(['standard', 'local']) AS m)""")
def _(s, d):
    c = table(s, d, "customer")
    none = F.lit(None).cast("string")
    cases = c.select(F.col("c_custkey").cast("string").alias("id"), F.array(F.lit("standard"), F.lit("local")).alias("modes"), none.alias("expectedFirstFileContains"), F.when(F.col("c_mktsegment") != "BUILDING", "deep").alias("expectedAnyCitationFileContains"), F.array(F.lit("ING")).alias("mustContainAny"), F.array().cast("array<string>").alias("mustContainAll"), F.lit(1).alias("minCitations"), F.lit(None).cast("int").alias("minEvidence"))
    r = c.select(F.col("c_custkey").cast("string").alias("id"), F.explode(F.array(F.lit("standard"), F.lit("local"))).alias("mode"), F.col("c_mktsegment").alias("answer"), F.col("c_acctbal").alias("bal"), F.array(F.when(F.col("c_nationkey") > 5, "x/deep.md").otherwise("x/flat.md")).alias("files"), F.lit(0).alias("n_evidence"))
    out = evaluate.experiment_cases(cases, r.withColumn("grounded", (F.col("mode") == "local") | (F.col("bal") >= 0)))
    return out.select("id", "mode", "grounded_ok", "any_file_ok", "any_term_ok", "passed")


@query("latest_runs", "SELECT o_custkey AS project, o_orderkey AS run_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders QUALIFY place <= 20")
def _(s, d):
    return evaluate.latest_runs(table(s, d, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("created_at"))).select("project", "run_id", "place")


FACT = r"fa AS (SELECT doc_id, list_distinct(list_concat(list_concat(regexp_extract_all(text, '\b20\d{2}[-/.](?:0?[1-9]|1[0-2])[-/.](?:0?[1-9]|[12]\d|3[01])\b'), regexp_extract_all(text, '\b(?:\d{1,3}\.){3}\d{1,3}(?::\d{2,5})?\b')), list_concat(regexp_extract_all(text, '(?i)https?://[^\s)>,]+'), regexp_extract_all(text, '\b[A-Z]{2,}(?:-[A-Z0-9]+)+\b')))) AS f, text FROM documents)"


@query("extract_facts", f"WITH {FACT} SELECT doc_id, array_to_string(f[1:40], '|') AS facts FROM fa")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.array_join(quality.extract_facts(F.col("text")), "|").alias("facts"))


@query("extract_assertions", "SELECT doc_id, '证明' || source || '|' || CASE WHEN doc_id % 2 = 0 THEN '唯一的办法' || n_chars || '|' ELSE '' END || '已确认第' || doc_id || '号' AS found FROM documents")
def _(s, d):
    # assertions before and behind each whole text, which has none of its own
    k = F.col("doc_id").cast("string")
    lead = F.concat(F.lit("已确认第"), k, F.lit("号。"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("唯一的办法"), F.col("n_chars").cast("string"), F.lit("；"))).otherwise(""))
    t = F.concat(lead, F.coalesce("text", F.lit("")), F.lit("；证明"), "source", F.lit("；"))
    return table(s, d, "documents").select("doc_id", F.array_join(quality.extract_assertions(t), "|").alias("found"))


def _drafts(s, d):
    t = table(s, d, "documents")
    return t.select(F.col("doc_id").alias("artifact_id"), F.lit("T").alias("title"), F.lit("").alias("instructions"), F.col("text").alias("content")), t.join(table(s, d, "labels"), "doc_id").filter("toxic = 0").select(F.col("doc_id").alias("artifact_id"), F.when(F.col("quality") == 1, F.col("text")).otherwise("none").alias("excerpt"))


DRAFT = rf"""{FACT}, u AS (SELECT fa.doc_id, l.quality, l.toxic, len(f[1:40]) AS n, CASE WHEN toxic = 0 AND quality = 1 THEN 0 ELSE len(list_distinct(list_transform(f[1:40], lambda x: x))) END AS bad, text FROM fa LEFT JOIN labels l ON l.doc_id = fa.doc_id)"""


@query("unsupported_claims", f"WITH {DRAFT} SELECT doc_id AS artifact_id, n AS n_claims, least(bad, 12) AS n_unsupported FROM u")
def _(s, d):
    return quality.unsupported_claims(*_drafts(s, d)).select("artifact_id", "n_claims", "n_unsupported")


@query("quality_score", rf"""WITH {DRAFT}, c AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t, coalesce(toxic = 0, false) AS ev FROM u),
x AS (SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE 100 - CASE WHEN length(t) < 120 THEN 25 ELSE 0 END - CASE WHEN regexp_matches(t, '(\.\.\.|,)$') THEN 30 ELSE 0 END END AS completeness, n, least(bad, 12) AS bad, ev,
  len(list_filter(regexp_split_to_array(text, '\r\n|[\n\x0b\x0c\r]'), lambda l: regexp_matches(l, '(?i)TODO|TBD'))) AS pending FROM c)
SELECT doc_id AS artifact_id, completeness, CASE WHEN NOT ev THEN 0 WHEN n = 0 THEN 80 ELSE CAST(floor(100.0 * (n - bad) / n + 0.5) AS INTEGER) END AS coverage, pending, bad AS n_unsupported, CASE WHEN completeness < 60 THEN 'FAILED' WHEN pending > 0 OR bad > 0 OR NOT ev THEN 'WARNING' ELSE 'PASSED' END AS status FROM x""")
def _(s, d):
    return quality.quality_score(*_drafts(s, d)).select("artifact_id", "completeness", "coverage", "pending", "n_unsupported", "status")


@query("evidence_items", f"WITH {_ANSWERS} SELECT question_id AS artifact_id, rank, chunk_id, md5(substr(text, 1, 1200)) AS digest FROM ranked JOIN documents ON doc_id = chunk_id")
def _(s, d):
    r = _ranked(s, d).select(F.col("question_id").alias("artifact_id"), "chunk_id", "rank")
    return quality.evidence_items(r, _chunks(s, d)).select("artifact_id", "rank", "chunk_id", F.md5("excerpt").alias("digest"))


@query("source_files", "SELECT artifact_id, file_id, row_number() OVER (PARTITION BY artifact_id ORDER BY rank, file_id) AS place FROM (SELECT o_custkey AS artifact_id, l_partkey AS file_id, min(l_linenumber) AS rank FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2) QUALIFY place <= 12")
def _(s, d):
    j = table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return quality.source_files(j.select(F.col("o_custkey").alias("artifact_id"), F.col("l_partkey").alias("file_id"), F.col("l_linenumber").alias("rank")))


@query("evidence_scope", "SELECT n_nationkey AS artifact_id, c_custkey AS file_id FROM nation JOIN customer ON c_custkey IN (n_nationkey + 10, n_nationkey + 40)")
def _(s, d):
    k = F.col("n_nationkey")
    ask = F.concat(F.lit("仅使用"), (k + 10).cast("string"), F.lit("、"), (k + 40).cast("string"), F.lit("号文件。其他"))
    f = table(s, d, "customer").select(F.col("c_custkey").alias("file_id"), F.concat(F.lit("d/"), F.col("c_custkey").cast("string"), F.lit("_c.md")).alias("rel_path"))
    return evidence.evidence_scope(table(s, d, "nation").select(k.alias("artifact_id"), ask.alias("instructions")), f).select("artifact_id", "file_id")


@query("evidence_scope_names", """WITH dr AS (SELECT c_custkey AS artifact_id, lower(c_mktsegment) || 'nation' || c_nationkey AS norm FROM customer),
fs AS (SELECT s_suppkey AS file_id, CASE s_suppkey % 3 WHEN 0 THEN 'nation' || s_nationkey WHEN 1 THEN 'xhouseholdnation' || s_nationkey || 'v2' ELSE 'zz' END AS stem FROM supplier)
SELECT artifact_id, file_id FROM dr LEFT JOIN fs ON length(stem) >= 4 AND (contains(norm, stem) OR contains(stem, norm))""")
def _(s, d):
    # suppliers as files: some names stand in customers' clauses, some hold them, some are too short
    ask = F.concat(F.lit("只引用 "), "c_mktsegment", F.lit(" nation_"), F.col("c_nationkey").cast("string"), F.lit("；其他"))
    k = F.col("s_nationkey").cast("string")
    name = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("NATION_"), k)).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("x Household Nation_"), k, F.lit(" v2"))).otherwise("zz")
    f = table(s, d, "supplier").select(F.col("s_suppkey").alias("file_id"), F.concat(F.lit("d/"), name, F.lit(".md")).alias("rel_path"))
    return evidence.evidence_scope(table(s, d, "customer").select(F.col("c_custkey").alias("artifact_id"), ask.alias("instructions")), f).select("artifact_id", "file_id")


@query("version_diff", r"""WITH l AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY 1, 2)),
p AS (SELECT conv_id * 1000 + turn AS pair_id, text AS base, nxt AS target FROM l WHERE nxt IS NOT NULL), b AS (SELECT pair_id, line, count(*) AS n FROM (SELECT pair_id, unnest(string_split(regexp_replace(base, '\n+$', ''), chr(10))) AS line FROM p) GROUP BY 1, 2), t AS (SELECT pair_id, line, count(*) AS n FROM (SELECT pair_id, unnest(string_split(regexp_replace(target, '\n+$', ''), chr(10))) AS line FROM p) GROUP BY 1, 2),
j AS (SELECT coalesce(b.pair_id, t.pair_id) AS pair_id, coalesce(b.n, 0) AS x, coalesce(t.n, 0) AS y FROM b FULL JOIN t ON b.pair_id = t.pair_id AND b.line = t.line)
SELECT pair_id, CAST(sum(greatest(y - x, 0)) AS BIGINT) AS added, CAST(sum(greatest(x - y, 0)) AS BIGINT) AS removed, CAST(sum(least(x, y)) AS BIGINT) AS unchanged FROM j GROUP BY 1""")
def _(s, d):
    from pyspark.sql import Window

    t = table(s, d, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("base"))
    t = t.withColumn("target", F.lead("base").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("target IS NOT NULL")
    return diff.version_diff(t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), "base", "target"))


# an order's lines by number, and the same by part: what keeps its order is the longest rising sequence of places
@query("version_diff_moved", """WITH RECURSIVE u AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p, l_linenumber AS l FROM lineitem), r AS (SELECT o, row_number() OVER (PARTITION BY o ORDER BY l, p) AS i, row_number() OVER (PARTITION BY o ORDER BY p, l) AS j FROM u),
c AS (SELECT o, i, j, 1 AS n FROM r UNION SELECT r.o, r.i, r.j, c.n + 1 FROM c JOIN r ON r.o = c.o AND r.i > c.i AND r.j > c.j), m AS (SELECT o, max(n) AS same FROM c GROUP BY 1)
SELECT m.o AS pair_id, CAST(count(*) - any_value(same) AS BIGINT) AS added, CAST(count(*) - any_value(same) AS BIGINT) AS removed, CAST(any_value(same) AS BIGINT) AS unchanged FROM r JOIN m ON m.o = r.o GROUP BY 1""")
def _(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber").distinct()
    line = F.concat(F.col("l_partkey").cast("string"), F.lit(":"), F.col("l_linenumber").cast("string")).alias("line")
    text = lambda *by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*by, line))), lambda x: x["line"]), "\n")
    return diff.version_diff(li.groupBy(F.col("l_orderkey").alias("pair_id")).agg(text("l_linenumber", "l_partkey").alias("base"), text("l_partkey", "l_linenumber").alias("target")))


def _artifacts(s, d):
    o = table(s, d, "orders")
    return o.select(F.col("o_custkey").alias("root_id"), F.col("o_orderkey").alias("artifact_id"), F.year("o_orderdate").alias("version_no"), F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate")).alias("deleted_at"), F.concat(F.lit("r/"), "o_orderpriority", F.lit("/"), "o_orderstatus", F.lit("/a.md")).alias("rel_path"))


@query("latest_versions", "SELECT o_custkey AS root_id, arg_max(o_orderkey, (year(o_orderdate), o_orderkey)) AS artifact_id, max(year(o_orderdate)) AS version_no FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def _(s, d):
    return quality.latest_versions(_artifacts(s, d))


@query("next_version", "SELECT o_custkey AS root_id, max(year(o_orderdate)) + 1 AS next_version FROM orders GROUP BY 1")
def _(s, d):
    return quality.next_version(_artifacts(s, d))


@query("trash", "SELECT o_orderkey AS artifact_id FROM orders WHERE o_orderstatus = 'P'")
def _(s, d):
    return quality.trash(_artifacts(s, d)).select("artifact_id")


@query("folder_counts", "WITH a AS (SELECT 'r/' || o_orderpriority AS p, 'r/' || o_orderpriority || '/' || o_orderstatus AS f FROM orders WHERE o_orderstatus <> 'P') SELECT 'r' AS folder, count(*) AS n FROM a UNION ALL SELECT p, count(*) FROM a GROUP BY 1 UNION ALL SELECT 'empty', 0")
def _(s, d):
    p = table(s, d, "orders").select(F.concat(F.lit("r/"), "o_orderpriority").alias("folder")).distinct()
    folders = p.unionByName(table(s, d, "region").select(F.explode(F.array(F.lit("r"), F.lit("empty"))).alias("folder")).distinct())
    return quality.folder_counts(folders, _artifacts(s, d))


@query("approval_gate", "SELECT o_orderkey, o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT' AS ok FROM orders")
def _(s, d):
    st = F.when(F.col("o_orderpriority") == "1-URGENT", "FAILED").otherwise("WARNING")
    return table(s, d, "orders").select("o_orderkey", quality.approval_gate(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")), st).alias("ok"))


@query("rewrite_paths", f"WITH {FILES} SELECT file_id, CASE WHEN starts_with(rel_path, 'src1/') THEN 'new/place' || substr(rel_path, 5) ELSE rel_path END AS rel_path FROM f")
def _(s, d):
    return files(s, d).select("file_id", quality.rewrite_paths(F.col("rel_path"), "src1", "new/place").alias("rel_path"))


REPORT = f"""WITH {TREE}, {SERVICES}, p AS (SELECT rel_path, CASE WHEN eligible THEN 'PARSED' ELSE 'FAILED' END AS st, dir FROM t),
r AS (SELECT 'parse' AS section, st AS name, count(*) AS n FROM p GROUP BY 2 UNION ALL SELECT 'files', 'NEW', count(*) FROM p WHERE dir < 'NATION_2' UNION ALL SELECT 'config_type', 'PART', count(*) FROM s UNION ALL SELECT 'config_status', review_status, count(*) FROM s GROUP BY 2
 UNION ALL SELECT 'node', 'DIR', count(DISTINCT (project, dir)) FROM t UNION ALL SELECT 'edge', 'CONTAINS', count(*) FROM t UNION ALL SELECT 'risk', 'PARSE_FAILED', count(*) FROM p WHERE st = 'FAILED' UNION ALL SELECT 'risk', 'UNCONFIRMED_CONFIG', count(*) FROM s WHERE review_status = 'PENDING')"""


def _report(s, d):
    t = customer_tree(s, d)
    f = t.select("rel_path", F.when(F.col("eligible"), "PARSED").otherwise("FAILED").alias("parse_status"), F.when(F.split_part("rel_path", F.lit("/"), F.lit(1)) < "NATION_2", 7).otherwise(6).alias("first_seen_scan"))
    return reports.scan_report(f, services(s, d), graph.graph_dir_nodes(t).select(F.lit("DIR").alias("node_type")), graph.edges_contains(t), 7)


@query("scan_report", f"{REPORT} SELECT section, name, n, CASE WHEN name = 'PARSE_FAILED' THEN (SELECT string_agg(rel_path, '|' ORDER BY rel_path) FROM (SELECT rel_path FROM p WHERE st = 'FAILED' ORDER BY 1 LIMIT 20)) END AS detail FROM r")
def _(s, d):
    return _report(s, d)


@query("scan_report_json", f"""{REPORT}, g AS (SELECT section, '{{' || string_agg('"' || coalesce(name, '') || '":' || n, ',' ORDER BY coalesce(name, '')) || '}}' AS m FROM r GROUP BY 1) SELECT '{{' || string_agg('"' || section || '":"' || replace(m, '"', '\\"') || '"', ',' ORDER BY section) || '}}' AS json FROM g""")
def _(s, d):
    return reports.scan_report_json(_report(s, d))


@query("file_list", f"WITH {FILES} SELECT file_id FROM f ORDER BY rel_path, file_id LIMIT 100 OFFSET 100")
def _(s, d):
    f = files(s, d).withColumn("doc_type", F.lit("note")).withColumn("parse_status", F.lit("PARSED"))
    return reports.file_list(f, doc_type="note", parse_status="PARSED", page=1, size=500).select("file_id")


@query("file_stats", "SELECT CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' ELSE '(none)' END AS doc_type, count(*) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1")
def _(s, d):
    lab = table(s, d, "labels").select(F.col("doc_id").alias("file_id"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("doc_type"))
    return reports.file_stats(files(s, d).join(lab, "file_id", "left"))


@query("latest_report", "SELECT o_custkey AS project, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS report_id FROM orders GROUP BY 1")
def _(s, d):
    return reports.latest_report(table(s, d, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("report_id"), F.col("o_orderdate").alias("created_at"))).select("project", "report_id")


@query("visible_projects", "SELECT c_custkey AS project FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def _(s, d):
    c, sup = table(s, d, "customer"), table(s, d, "supplier").filter("s_acctbal < 0")
    owned = c.join(sup, F.col("c_nationkey") == F.col("s_nationkey"), "left_semi").select(F.col("c_custkey").alias("project"))
    return reports.visible_projects(c.select(F.col("c_custkey").alias("project")), owned)


@query("route_metrics", f"WITH {REQUESTS} SELECT route, count(*) AS requests, count(*) FILTER (status >= 400) AS errors, CAST(sum(duration_ms) AS BIGINT) // count(*) AS average_ms, max(duration_ms) AS max_ms FROM q GROUP BY 1")
def _(s, d):
    return reports.route_metrics(requests(s, d)).drop("total")


@query("overall_metrics", f"WITH {REQUESTS}, r AS (SELECT route, count(*) AS n, count(*) FILTER (status >= 400) AS e, CAST(sum(duration_ms) AS BIGINT) AS t FROM q GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS requests, CAST(sum(e) AS BIGINT) AS errors, CAST(sum(n * (t // n)) AS BIGINT) // CAST(sum(n) AS BIGINT) AS average_ms, round(CAST(sum(t) AS DOUBLE) / CAST(sum(n) AS DOUBLE), 6) AS exact_ms FROM r")
def _(s, d):
    return reports.overall_metrics(reports.route_metrics(requests(s, d))).withColumn("exact_ms", F.round("exact_ms", 6))


@query("recent_audits", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def _(s, d):
    return reports.recent_audits(requests(s, d)).select("event_id")


@query("scans_by_project", "SELECT event_id AS scan_id FROM events WHERE event_type = 'view'")
def _(s, d):
    e = table(s, d, "events").select(F.col("event_type").alias("project"), F.col("ts").alias("created_at"), F.col("event_id").alias("scan_id"))
    return reports.scans_by_project(e, "view").select("scan_id")


@query("recent_failures", f"WITH {REQUESTS} SELECT event_id, route FROM q WHERE status >= 500 ORDER BY ts DESC, event_id DESC LIMIT 30")
def _(s, d):
    return reports.recent_failures(requests(s, d)).select("event_id", reports.normalize_route(F.concat(F.lit("GET "), "route")).alias("route"))


@query("route_metrics_stream", f"WITH {REQUESTS} SELECT route, count(*) AS requests, count(*) FILTER (status >= 400) AS errors, CAST(sum(duration_ms) AS BIGINT) AS total, max(duration_ms) AS max_ms FROM q GROUP BY 1")
def _(s, d):
    from ..session import fresh_path

    # complete mode keeps every window, so that sums over windows are the batch's numbers
    feed = requests(s, d)
    path = fresh_path(s, "requests")
    feed.write.parquet(path)
    live = streams.route_metrics_stream(s.readStream.schema(feed.schema).parquet(path))
    out = fresh_path(s, "windows")

    def keep(batch, n):
        batch.write.mode("overwrite").parquet(out)

    q = live.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", fresh_path(s, "stream")).trigger(availableNow=True).start()
    q.awaitTermination()
    w = s.read.parquet(out)
    return w.groupBy("route").agg(F.sum("requests").alias("requests"), F.sum("errors").alias("errors"), F.sum("total").alias("total"), F.max("max_ms").alias("max_ms"))


def _two_scans(s, d, addresses=False):
    """A store after the stream has applied both listings, each of several files in a folder of its own; with addresses
    each text names one more, after its digest."""
    from ..session import fresh_path
    from .fixtures import listings

    manifests, store = fresh_path(s, "manifests"), scan.ScanStore(s, fresh_path(s, "store"))
    for n, listing in enumerate(listings(s, d), 1):
        at = fresh_path(s, "listing")
        own = F.concat("text", F.lit("\nsee https://s"), F.substring("sha256", 1, 8), F.lit(".corp/x"))
        (listing.withColumn("text", own) if addresses else listing).write.parquet(at)
        s.createDataFrame([(n, at)], streams.MANIFEST).coalesce(1).write.mode("append").parquet(manifests)
    streams.incremental_scan_stream(s, manifests, store, fresh_path(s, "stream")).awaitTermination()
    return store


@query("incremental_scan_stream", f"WITH {SNAPSHOTS} SELECT 1::BIGINT AS scan_id, project, rel_path, 'ADDED' AS change_type, NULL AS old_rel_path FROM prev UNION ALL SELECT 2, project, rel_path, change_type, old_rel_path FROM diff WHERE change_type <> 'UNCHANGED'")
def _(s, d):
    return _two_scans(s, d).table("log").select("scan_id", "project", "rel_path", "change_type", "old_rel_path")


@query("scan_files", f"""WITH {SNAPSHOTS} SELECT project, rel_path, size::BIGINT AS size, sha256, 'PARSED' AS parse_status, CASE WHEN change_type = 'ADDED' THEN 2 ELSE 1 END::BIGINT AS first_seen_scan, CASE WHEN change_type = 'DELETED' THEN 1 ELSE 2 END::BIGINT AS last_seen_scan,
CASE WHEN change_type IN ('ADDED', 'MODIFIED') THEN 2 ELSE 1 END::BIGINT AS content_scan, change_type = 'DELETED' AS deleted FROM diff""")
def _(s, d):
    return _two_scans(s, d).files().select("project", "rel_path", "size", "sha256", "parse_status", "first_seen_scan", "last_seen_scan", "content_scan", "deleted")


# texts of the second listing, and their chunks and addresses
_NOW = SNAPSHOTS + """, now AS (SELECT project, CASE WHEN lang = 'fr' AND quality = 1 THEN 'moved/' || rel_path ELSE rel_path END AS rel_path, CASE WHEN quality = 0 THEN text || '!' ELSE text END AS text
  FROM f LEFT JOIN labels l ON l.doc_id = f.file_id WHERE toxic IS NULL OR toxic = 0)"""


@query("scan_chunks", "WITH RECURSIVE " + _NOW + r""", l AS (SELECT project, rel_path, string_split(regexp_replace(text, '\n+$', ''), chr(10)) AS a FROM now WHERE trim(text) <> ''),
w AS (SELECT project, rel_path, a, 1 AS i, 0 AS n, 0 AS held FROM l UNION ALL SELECT project, rel_path, a, i + 1, CASE WHEN held + length(a[i]) + 1 >= 1600 THEN n + 1 ELSE n END, CASE WHEN held + length(a[i]) + 1 >= 1600 THEN 0 ELSE held + length(a[i]) + 1 END FROM w WHERE i <= len(a)),
c AS (SELECT project, rel_path, n AS seq, regexp_replace(string_agg(a[i], chr(10) ORDER BY i), '^[\s　]+|[\s　]+$', '', 'g') AS content FROM w WHERE i <= len(a) GROUP BY 1, 2, 3)
SELECT project, rel_path, seq, md5(content) AS digest FROM c WHERE content <> ''""")
def _(s, d):
    return _two_scans(s, d).current("chunks").select("project", "rel_path", "seq", F.md5("content").alias("digest"))


@query("scan_items", "WITH " + _NOW + r""", v AS (SELECT DISTINCT project, rel_path, 'IP_PORT' AS key_type, v AS key_value FROM (SELECT project, rel_path, unnest(regexp_extract_all(text, '\b(?:\d{1,3}\.){3}\d{1,3}(?::\d{2,5})?\b')) AS v FROM now WHERE regexp_matches(text, '\d\.\d'))
  WHERE NOT regexp_matches(v, '^(127\.0\.0\.1|0\.0\.0\.0)') AND len(list_filter(string_split(split_part(v, ':', 1), '.'), lambda p: CAST(p AS INTEGER) > 255)) = 0 AND (contains(v, ':') OR regexp_matches(v, '^(10\.|127\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)')))
SELECT *, 'PENDING' AS review_status FROM v UNION ALL SELECT project, rel_path, 'URL', 'https://s' || substr(sha256, 1, 8) || '.corp/x', CASE WHEN substr(sha256, 1, 1) = '0' THEN 'REJECTED' ELSE 'PENDING' END FROM diff WHERE change_type <> 'DELETED'""")
def _(s, d):
    store = _two_scans(s, d, addresses=True)
    store.review(store.items().filter("key_value LIKE 'https://s0%'").withColumn("review_status", F.lit("REJECTED")))
    return store.items().select("project", "rel_path", "key_type", "key_value", "review_status")


@query("scan_graph", "WITH " + SNAPSHOTS + r""", live AS (SELECT project, rel_path, regexp_replace(rel_path, '/[^/]*$', '') AS dir FROM diff WHERE change_type <> 'DELETED')
SELECT project, 'file:' || rel_path AS target_key, 'dir:' || dir AS source_key, 'CONTAINS' AS edge_type FROM live UNION SELECT project, 'dir:' || dir, 'project:' || project, 'PROJECT_CONTAINS' FROM live""")
def _(s, d):
    # the documents' few services are in scan_items
    store = _two_scans(s, d)
    return store.table("edges").filter((F.col("scan_id") == 2) & (F.col("edge_type") != "MENTIONS")).select("project", "target_key", "source_key", "edge_type")


@query("stream_equals_batch", "SELECT 0 AS differing WHERE false")
def _(s, d):
    from .fixtures import snapshots
    from .registry import QUERIES

    streamed = QUERIES["incremental_scan_stream"](s, d).filter("scan_id = 2").drop("scan_id")
    batch = changes.snapshot_diff(*snapshots(s, d)).filter("change_type != 'UNCHANGED'").select(streamed.columns)
    return streamed.exceptAll(batch).unionByName(batch.exceptAll(streamed)).select(F.lit(0).alias("differing"))
