import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as cp
from corpusloom.llm import cotrain, mixing, prefix_bpe
from corpusloom.llm.prefix_bpe import parse_ranks


def pareto_brute(rows, weights=(5, 2, 1), budget=1.5, most=2):
    """Plain version of the mix: rows (key, source, size) -> {key: copies}."""
    total = {}
    for _, s, n in rows:
        total[s] = total.get(s, 0) + n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full: set = set()
    while True:
        level = (budget * sum(total.values()) - sum(most * total[s] for s in full)) / sum(w[s] for s in order if s not in full)
        now = {s for s in order if most * total[s] <= w[s] * level}
        if now == full:
            break
        full = now
    out = {}
    for s in order:
        target = min(most * total[s], w[s] * level)
        e = target / total[s] if total[s] else 0
        sure, p = int(e), e - int(e)
        want, cum = target - sure * total[s], 0
        u = {k: (int(hashlib.md5(f"0:{k}:{n}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48 for k, x, n in rows if x == s}
        for k, _, n in sorted((r for r in rows if r[1] == s), key=lambda r: u[r[0]] / (1 - u[r[0]])):
            out[k] = sure + (p > 0 and cum + n / 2 <= want)
            cum += n
    return out, {s: min(most * total[s], w[s] * level) for s in order}


def test_mix_same_as_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", "b", "b", "b", "c", None, "d"]), rng.choice([0, 1, 5, 40, 300])) for i in range(500)]
    df = spark.createDataFrame([(i, s, "w " * n if n else None, "x", 1.0) for i, s, n in rows], "doc_id long, source string, text string, size string, target double")
    want, targets = pareto_brute(rows)
    out = mixing.pareto_mix(df).collect()
    assert {r.doc_id: r.copies for r in out} == want
    taken = Counter()
    for r in out:
        taken[r.source] += r.taken
        assert r.taken <= 2 * r.size and abs(r.target - targets[r.source]) < 1e-6
    assert all(abs(taken[s] - t) <= 300 for s, t in targets.items())
    again = mixing.repeat_taken(df)
    assert again.columns == df.columns
    assert Counter(r.doc_id for r in again.collect()) == Counter({k: n for k, n in want.items() if n})
    assert mixing.pareto_mix(df.limit(0)).count() == 0


def test_favoured_rows(spark):
    df = spark.createDataFrame([(i, "s" if i % 2 else "t", "w " * 10, 0.2 + (i % 5)) for i in range(1000)] + [(2000, "s", "w", None)], "doc_id long, source string, text string, score double")
    out = mixing.pareto_mix(df, weights=(1.0,), budget=0.5, favour=F.col("score")).collect()
    by = Counter()
    for r in out:
        assert r.copies <= 2
        by[r.doc_id % 5 if r.doc_id < 2000 else "none"] += r.copies
    assert by["none"] == 0 and by[0] < by[1] < by[2] < by[4]
    assert abs(sum(r.taken for r in out) - 5000) < 50


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cols, before, tables = docs.columns, docs.count(), [docs]
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == cols, name
        tables.append(docs)
    sizes = [t.count() for t in tables]
    assert before >= sizes[1] >= sizes[2] >= sizes[3] > 0
    # every stage returns rows of its input only
    for a, b in zip(tables, tables[1:], strict=False):
        assert b.select("doc_id", "text").exceptAll(a.unionAll(a).select("doc_id", "text")).count() == 0
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=parse_ranks(f.read()), special_tokens={})
    want = Counter((r.doc_id, hashlib.sha256(np.array(enc.encode_ordinary(r.text), "<u4").tobytes()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()) for r in docs.collect())
    got = Counter((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in cp.token_ids(spark, docs, sf).collect())
    assert got == want
    assert Counter((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in cp.run(spark, sf).collect()) == want


def test_stages_bound_what_a_worker_holds(spark):
    other = spark.newSession()
    names = [f"spark.sql.execution.arrow.{x}" for x in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    docs = other.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for rows, size, want in (("10000", "256m", [2000, 64 << 20]), ("500", "1000000", [500, 1_000_000])):
        other.conf.set(names[0], rows)
        other.conf.set(names[1], size)
        cp.token_ids(other, docs, "/root/testdata/sf0.001")
        assert [int(other.conf.get(n)) for n in names] == want
    # a vocabulary and its memos do not stay in a worker that makes views
    before = prefix_bpe._vocabulary(b"YQ== 0", "a")
    assert prefix_bpe._vocabulary(b"YQ== 0", "a") is before
    list(cotrain._view_rows(iter([])))
    assert prefix_bpe._vocabulary(b"YQ== 0", "a") is not before
