import hashlib
import random
from collections import Counter

import numpy as np

from corpusloom.llm import debruijn, queries
from corpusloom.llm.rule_stats import word_hashes


def expected(rows):
    """(doc_id, n_words, n_removed, kept_sha256) of every row by a table of all windows."""
    split = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
    out = []
    for (key, _), w in zip(rows, split, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((key, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()), key=str)


def found(spark, rows, path):
    df = spark.createDataFrame([(k, t, 1, "x", 2) for k, t in rows], "doc_id long, text string, rid int, key string, n int")
    df.write.parquet(f"{path}/documents.parquet")
    return queries.op11_de_bruijn_repeats(spark, str(path))


def corpus(seed, n):
    """Documents that share passages of about a window, with changed words, repeats within a text and copies."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    passages = [[rng.choice(words) for _ in range(rng.choice([30, 34, 35, 36, 50, 90, 400]))] for _ in range(12)]
    out = []
    for i in range(n):
        text = []
        for _ in range(rng.randrange(0, 5)):
            p = rng.choice(passages)
            a, b = (0, len(p)) if rng.random() < 0.5 else sorted((rng.randrange(len(p)), rng.randrange(len(p))))
            p = p[a:b]
            for _ in range(rng.randrange(0, 3)):
                if p:
                    p[rng.randrange(len(p))] = rng.choice([*words, "new"])
            text += p + [rng.choice(words) for _ in range(rng.randrange(0, 50))]
        out.append((i, rng.choice([" ", "\n", " \t"]).join(text)))
    return out


def test_against_all_windows(spark, tmp_path):
    rows = corpus(1, 150)
    rows += [(500 + i, t.replace("\n", " ")) for i, (_, t) in enumerate(rows[:10])]
    rows += [(600, None), (601, ""), (602, " \n"), (603, "a " * 34), (604, "a " * 35), (605, "a " * 36), (606, "b c " * 100), (607, "one two " * 17 + "one"), (608, "one two " * 17 + "one")]
    rows += [(7, rows[7][1]), (7, "another text of the same number " * 9), (None, rows[20][1] + " tail"), (None, rows[21][1] + " tail"), (None, None)]
    want = expected(rows)
    assert sum(r[2] > 0 for r in want) > 50
    assert sum(0 < r[2] < r[1] for r in want) > 30
    assert result(found(spark, rows, tmp_path)) == want


def test_few_words_many_repeats(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("ab") * rng.randrange(1, 30) for _ in range(rng.randrange(0, 120)))) for i in range(40)]
    rows += [(100 + i, " ".join(rng.choice("ab") for _ in range(300)) + " c" * rng.randrange(30, 80)) for i in range(30)]
    assert result(found(spark, rows, tmp_path)) == expected(rows)


def test_long_text(spark, tmp_path):
    rng = random.Random(3)
    long = [str(rng.randrange(10**6)) for _ in range(200_000)]
    rows = [(1, " ".join(long)), (2, " ".join(["x", *long[1000:1060], "y"])), (3, " ".join(long[:100_000] + ["z"] + long[100_000:])), (4, "plain " * 20)]
    assert result(found(spark, rows, tmp_path)) == expected(rows)


def test_empty(spark):
    assert debruijn.repeated_spans(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_nodes_depend_on_windows_alone():
    rng = np.random.default_rng(4)
    words = rng.integers(0, 3, 3000)
    text = " ".join(map(str, words))
    h, counts = word_hashes([text, text], lower=False)
    starts, at, places, _ = debruijn.graph_nodes(debruijn.Digests(h), counts)
    node = {}
    for i, s in zip(starts.tolist(), at.tolist(), strict=True):
        assert node.setdefault(tuple(words[np.arange(i, i + 35) % 3000].tolist()), s - i) == s - i
    assert set(at.tolist()) == set(places.tolist())
