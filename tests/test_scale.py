"""Operators compared with plain versions of themselves, and on single keys and texts that are very large."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from corpusloom.operators import chunks, diff, endpoints, graph, retrieval
from corpusloom.session import stash
from corpusloom.sources.files import rank_in_groups


def test_best_similar_is_the_pool_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "PILOT", 40)
    monkeypatch.setattr(retrieval, "LEVEL", 3)
    monkeypatch.setattr(retrieval, "PART", 50)
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 7))) for _ in range(120)]
    texts = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for i in range(300)] + [(700, None), (701, "")], "chunk_id long, text string")
    questions = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))) for i in range(25)] + [(25, "?"), (26, None), (27, "zqzq qzz")], "question_id long, question string")
    q, t = stash(retrieval.question_grams(questions), "q"), stash(retrieval.text_grams(texts), "t")
    for most in (5,):
        want = retrieval.semantic_pool(retrieval.bigram_similarity(questions, texts).withColumn("score", F.round("score", 9)), most=most)
        got = retrieval.best_similar(q, t, most=most)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("question_id", "chunk_id", "score").collect()))
    # with the bounds of the best 5, few pairs are looked at
    counts = t.select(F.explode("tg").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    bounds = got.groupBy("question_id").agg(F.min("score").alias("bound"))
    pairs = retrieval.similar_candidates(q, t, counts, bounds).join(bounds, "question_id").count()
    every = retrieval.bigram_similarity(questions, texts).count()
    assert pairs < every / 5


def test_contained(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("ab%_.\\") for _ in range(n))
    needles = {word(rng.randrange(0, 6)) for _ in range(60)} | {"zz", "", "c"}
    texts = {i: word(rng.randrange(0, 40)) for i in range(80)}
    got = retrieval.contained(spark.createDataFrame([(x,) for x in needles], "needle string"), spark.createDataFrame(list(texts.items()), "id long, t string"))
    assert sorted((r["needle"], r["id"]) for r in got.collect()) == sorted((x, i) for x in needles for i, t in texts.items() if x and x in t)


def fold(sizes, heads, limit):
    out, held, last = [], 0, 0
    for i, (n, h) in enumerate(zip(sizes, heads, strict=True), 1):
        last = i if h else last
        if held == 0:
            out.append((i, last))
        held = 0 if held + n >= limit else held + n
    return out


def test_chunk_places():
    rng = np.random.default_rng(3)
    for n in [0, 1, 2, 5, 50, 400] * 20:
        sizes, heads = rng.integers(1, 40, n), rng.random(n) < 0.1
        limit = int(rng.integers(1, 120))
        assert list(zip(*(x.tolist() for x in chunks.chunk_places(sizes, heads, limit)), strict=True)) == fold(sizes, heads, limit)
    took = []
    for n in (1_000_000, 2_000_000):
        start = time.process_time()
        chunks.chunk_places(np.full(n, 30), np.zeros(n, bool), 1600)
        took.append(time.process_time() - start)
    assert took[1] < 5 * took[0] + 0.5


def test_one_text_of_many_lines(spark):
    n = 300_000
    text = spark.range(1).select(F.col("id").alias("file_id"), F.expr(f"array_join(transform(sequence(1, {n}), i -> concat(if(i % 1000 = 1, '# part ', 'line '), i)), '\n')").alias("text"))
    got = chunks.line_chunks(text).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(F.split("content", "\n"))).alias("lines"), F.max("heading").alias("h")).first()
    assert got["lines"] == n and got["n"] > 2000 and got["h"].startswith("part ")


def test_one_text_of_many_endpoints(spark):
    def timed(n):
        text = spark.range(1).select(F.col("id").alias("file_id"), F.expr(f"array_join(transform(sequence(1, {n}), i -> concat('see https://svc', i, '.corp/api for it')), '\n')").alias("text"))
        start = time.perf_counter()
        assert endpoints.extract_endpoints(text).count() == n
        return time.perf_counter() - start

    timed(1000)
    assert timed(100_000) < 30


def test_fences_and_contexts_as_at_single_places(spark):
    rng = random.Random(4)
    parts = ["https://a.corp/x", "redis://b.corp:1/", "```", "\n## head ", "\n", " api ", "example ", "text " * 20, "漢字😀 ", "````", "10.1.2.3:80"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 60)))) for i in range(60)]
    df = spark.createDataFrame(rows, "file_id long, text string")
    m = endpoints.endpoint_matches(df).join(df, "file_id")
    fenced = F.col("lead").isNotNull() & endpoints._in_example(F.col("lead"), F.col("context"))
    plain = endpoints.example_code_block(F.col("text"), F.col("start"), F.col("context"))
    got = m.select("context", endpoints.endpoint_context(F.col("text"), F.col("start"), F.col("size")).alias("c2"), fenced.alias("f"), plain.alias("f2")).collect()
    assert len(got) > 200 and any(r["f"] for r in got)
    assert all(r["context"] == r["c2"] and r["f"] == r["f2"] for r in got)


def test_ranks_of_a_hot_group(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise((F.col("id") % 997).cast("string")).alias("g"), F.format_string("%06d", (F.col("id") * 7919) % 40_000).alias("p"))
        ranked = stash(rank_in_groups(rows, ["g"], ["p"], "k").withColumn("part", F.spark_partition_id()), "ranked")
        want = sorted((r["g"], r["p"]) for r in rows.collect())
        place, out = {}, []
        for g, p in want:
            place[g] = place.get(g, 0) + 1
            out.append((g, p, place[g]))
        assert sorted((r["g"], r["p"], r["k"]) for r in ranked.collect()) == out
        largest = ranked.filter("g = 'hot'").groupBy("part").count().agg(F.max("count")).first()[0]
        assert largest < 15_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def table_diff(a, b):
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out = []
    while i < n and j < m:
        if a[i] == b[j]:
            out.append(("UNCHANGED", a[i]))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            out.append(("REMOVED", a[i]))
            i += 1
        else:
            out.append(("ADDED", b[j]))
            j += 1
    return out + [("REMOVED", x) for x in a[i:]] + [("ADDED", x) for x in b[j:]]


def test_diff_lines(spark):
    rng = random.Random(5)
    lines = lambda: [rng.choice("abcdef") for _ in range(rng.randrange(0, 25))]
    pairs = {i: (lines(), lines()) for i in range(200)}
    for i in range(200, 240):
        a = [str(k) for k in range(30)]
        b = a[:]
        rng.shuffle(b)
        pairs[i] = (a, b if i % 2 else a[20:] + a[:20])
    df = spark.createDataFrame([(i, "\n".join(a), "\r\n".join(x + "  " for x in b)) for i, (a, b) in pairs.items()] + [(900, None, "x\n\ny\n"), (901, None, "")], "pair_id long, base string, target string")
    got = {}
    for r in diff.diff_lines(df).orderBy("pair_id", "place").collect():
        got.setdefault(r["pair_id"], []).append((r["kind"], r["line"]))
    for i, (a, b) in pairs.items():
        assert got.get(i, []) == table_diff(a, b)
    assert got[900] == [("ADDED", "x"), ("ADDED", ""), ("ADDED", "y")] and 901 not in got
    counts = {r["pair_id"]: (r["added"], r["removed"], r["unchanged"]) for r in diff.version_diff(df).collect()}
    assert counts[901] == (0, 0, 0)
    assert all(counts[i] == tuple(sum(k == kind for k, _ in table_diff(a, b)) for kind in ("ADDED", "REMOVED", "UNCHANGED")) for i, (a, b) in pairs.items())


def test_long_diff():
    rng = random.Random(6)
    a = [rng.randrange(5000) for _ in range(20_000)]
    b = a[9000:] + a[:9000]
    start = time.process_time()
    same = sum(k == "UNCHANGED" for k, _ in diff.common_order(a, b))
    assert same >= 11_000 and time.process_time() - start < 20


def test_label_propagation_as_full_votes(spark):
    """Every half-step by votes of all nodes gives the same labels."""
    rng = random.Random(7)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(110)]
    e = spark.createDataFrame(edges, "source long, target long")
    nodes = sorted({x for p in edges for x in p})
    turns = {s: {r["id"] for r in spark.range(60).filter(F.pmod(F.xxhash64("id", F.lit(s)), F.lit(2)) == 0).collect()} for s in range(24)}
    label = {x: x for x in nodes}
    near = {x: [] for x in nodes}
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)

    def wish(x):
        votes = {}
        for y in near[x]:
            votes[label[y]] = votes.get(label[y], 0) + 1
        return min(votes, key=lambda k: (-votes[k], k))

    for step in range(24):
        want = {x: wish(x) for x in nodes}
        if want == label:
            break
        label = {x: want[x] if x in turns[step] else label[x] for x in nodes}
    assert {r["node"]: r["label"] for r in graph.label_propagation(e).collect()} == label
