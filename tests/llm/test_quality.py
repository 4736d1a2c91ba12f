import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import cotrain, isolation
from corpusloom.llm.rule_stats import STATS, text_stats

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    words = re.findall(WORD, text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    spans = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {j for i, s in enumerate(spans) if spans.count(s) > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\té\xa0#|", max_size=80)), max_size=6))
def test_counts(texts):
    got = text_stats(texts)
    assert [tuple(r[:5]) for r in got] == [brute(t) for t in texts]


def clean(rng, n=80):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(n)) + "."


def corpus(n=400):
    rng, rows = random.Random(3), []
    for i in range(n):
        t = clean(rng)
        bad = i % 6 == 0
        rows.append((i, t.replace(" ", "*** ") if bad else t, f"s{i % 5}", "en", len(t), int(not bad)))
    return rows


def test_forest_rules(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:5] for r in rows] + [(1000, None, None, None, None), (1001, "", "s", "en", 0), (1002, "a b " * 40, "s", "en", 160), (3, rows[3][1], "s", "en", 1)], "doc_id long, text string, source string, lang string, score long")
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows if r[0] % 2 == 0] + [(7, None)], "doc_id long, quality int")
    out = {(r.doc_id, r.kept) for r in isolation.quality_rules(docs, labels).collect()}
    assert {k for k, kept in out if kept} == {r[0] for r in rows if r[5]}
    assert isolation.quality_rules(docs.limit(0), labels).count() == 0
    none = isolation.quality_rules(docs, labels.limit(0)).filter("NOT kept").select("doc_id").collect()
    assert sorted(r.doc_id for r in none) == [1000, 1001, 1002]
    kept = isolation.keep_quality(docs, labels)
    assert kept.columns == docs.columns and kept.filter("doc_id = 3").count() == 2


def test_path_lengths_isolate_outliers():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 1, (1000, 7)), np.full((3, 7), 9.0)])
    s = isolation.fit_forest(x).scores(x)
    assert set(np.argsort(s)[-3:]) == {1000, 1001, 1002}


def test_path_lengths_by_walking():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (700, 4))
    forest = isolation.fit_forest(x, trees=8, points=64, seed=5)

    def path(t, row, node=0, depth=0):
        f = forest.feature[t, node]
        if f < 0:
            return forest.path[t, node], depth
        return path(t, row, 2 * node + 1 + int(row[f] >= forest.split[t, node]), depth + 1)

    # a point at depth d among n points has the path d and what a tree of n points has on average
    mean = lambda n: 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n
    walked = [[path(t, row) for t in range(8)] for row in x]
    assert np.allclose(forest.scores(x), [2 ** (-np.mean([p for p, _ in w]) / mean(64)) for w in walked])
    assert all(p >= d for w in walked for p, d in w) and forest.norm == mean(64)


def test_threshold():
    counts = [(100, 1, 990), (900, 1, 10), (800, 0, 50), (950, 0, 50)]
    assert 0.8 < isolation.choose_threshold(counts, 0.001) <= 0.95
    assert 0.1 < isolation.choose_threshold(counts, 0.02) <= 0.8
    assert isolation.choose_threshold([(5, 1, 5)], 0.1) == float("inf")
    assert len(STATS) == 11


def test_co_training(spark):
    rows = corpus(900)
    docs = spark.createDataFrame([r[:5] for r in rows] + [(2000, None, None, None, None), (1, rows[1][1], None, "en", 3)], "doc_id long, text string, source string, lang string, n_chars long").withColumn("p_bad", F.lit("x")).withColumn("quality", F.lit(0)).withColumn("kept", F.lit(False))
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows if r[0] % 3 == 0], "doc_id long, quality int")
    out = cotrain.classify_quality(docs, labels).collect()
    assert len(out) == 902
    truth = {r[0]: bool(r[5]) for r in rows}
    held = [r for r in out if r.doc_id % 3 and r.doc_id < 900]
    assert np.mean([truth[r.doc_id] == r.kept for r in held]) > 0.99
    assert cotrain.classify_quality(docs.limit(0), labels).count() == 0
    assert cotrain.classify_quality(docs, labels.limit(0)).filter("NOT kept").count() == 0
    assert cotrain.keep_classified(docs, labels).columns == docs.columns


def test_views_teach_each_other():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 3000)
    a = rng.normal(0, 0.5, (3000, 4)) + y[:, None] * 2
    b = rng.normal(0, 0.5, (3000, 4)) + y[:, None] * 2
    views = cotrain.co_train(a[:100], b[:100], y[:100], cotrain.surest_of(np.arange(100, 3000), a[100:], b[100:]))
    assert views.exchanged[-1][0] > 200 and views.exchanged[-1][1] > 200
    assert ((views.score(a, b)[100:, 2] > 0.5) == y[100:]).mean() > 0.99


def test_rounds_over_a_table_are_those_in_memory(spark, monkeypatch):
    """Every unlabelled row takes part: the table's exchange picks what one over all rows in memory picks."""
    rows = corpus(600)
    docs = spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4]) for r in rows], "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows if r[0] % 4 == 0], "doc_id long, quality int")
    seen, real = [], cotrain._surest_in

    def spy(table, known, sure, most):
        inner = real(table, known, sure, most)
        names = {r["name"]: r for r in table.join(known, F.col("key") == F.col("__k"), "left_anti").collect()}
        order = sorted(names)
        x = [np.stack([np.frombuffer(names[n][c], np.float32) for n in order]) for c in ("text", "page")]
        plain = cotrain.surest_of(np.array(order), *x, sure, most)

        def find(models, calibrations):
            got, want = inner(models, calibrations), plain(models, calibrations)
            seen.append([sorted((n, k) for n, k, *_ in v) for v in got])
            assert seen[-1] == [sorted((n, k) for n, k, *_ in v) for v in want]
            assert all(np.array_equal(g[2], w[2]) and np.array_equal(g[3], w[3]) for u, v in zip(got, want, strict=True) for g, w in zip(sorted(u, key=lambda r: r[0]), sorted(v, key=lambda r: r[0]), strict=True))
            return got

        return find

    monkeypatch.setattr(cotrain, "_surest_in", spy)
    assert cotrain.classify_quality(docs, labels, sure=0.9, most=40).count() == len(rows)
    assert len(seen) == 4 and sum(map(len, seen[0])) > 20
