import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from corpusloom.llm import queries, runs
from corpusloom.llm.rule_stats import word_hashes


def all_runs(words):
    """Every stretch of its smallest period q with length >= max(24, 3 * q) that cannot be extended."""
    out, n = [], len(words)
    for q in range(1, n // 3 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            start, length = i - q, j - i + q
            part = words[start : start + length]
            smallest = next(p for p in range(1, q + 1) if part[p] == part[0] and part[p:] == part[:-p]) if length >= max(24, 3 * q) else 0
            if length >= max(24, 3 * q) and smallest == q:
                out.append((start, length, q))
            i = j
    return sorted(out, key=lambda x: (x[0], x[2]))


def altered(key, words):
    h = zlib.crc32(str(key).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(key, text):
    words = altered(key, (text or "").encode().split())
    found = all_runs(words)
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    best = max(found, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    return (key, len(found), *(best[:1] + best[1:2] + best[2:] + (1000 * best[1] // best[2],) if best else (None,) * 4), hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def texts(rng):
    """Random word sequences full of runs: repeated pieces of pieces, cut and joined."""
    letters = [chr(97 + i) for i in range(rng.choice([2, 3, 30]))]
    out = []
    while len(out) < rng.randrange(0, 200):
        piece = [rng.choice(letters) for _ in range(rng.randrange(1, 40))]
        for _ in range(rng.randrange(1, 3)):
            piece = piece * rng.randrange(1, 6)
            piece = piece[rng.randrange(len(piece)) :] or piece
        out += piece[:300]
    return out


def test_against_brute_force():
    rng = random.Random(3)
    many = [texts(rng) for _ in range(800)] + [["a"] * 23, ["a"] * 24, list("ab") * 12, list("abcdefghi") * 3, list("abcdefghi") * 3 + ["a"], []]
    h, counts = word_hashes([" ".join(t) for t in many], lower=False)
    found = runs.text_runs(h, counts)
    assert sum(map(len, found)) > 300
    for t, got in zip(many, found, strict=True):
        assert got == all_runs(t)


def test_long_texts_are_linear():
    n = 300_000
    rng = np.random.default_rng(1)
    one = ["x"] * n
    nested = (["a"] * 30 + ["b"]) * (n // 31)
    mixed = [f"w{i}" for i in rng.zipf(1.3, n).clip(0, 5000).tolist()]
    h, counts = word_hashes([" ".join(t) for t in (one, nested, mixed)], lower=False)
    a, b, _ = runs.text_runs(h, counts)
    assert a == [(0, n, 1)]
    assert (0, len(nested), 31) in b and len(b) == 1 + n // 31


def test_query(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " \n".join(texts(rng))) for i in range(150)] + [(150, None), (151, ""), (152, " \t\n"), (7, "again " * 40), (7, "again " * 40), (153, "é b " * 30), (154, "word " * 20_000)]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, runs int, collapsed string").write.parquet(path)
    got = queries.op13_periodic_runs(spark, str(tmp_path))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    small = [r for r in rows if len(r[1] or "") < 50_000]
    rows = got.collect()
    assert sorted((tuple(r[c] for c in names) for r in rows if r["doc_id"] != 154), key=str) == sorted((expected(*r) for r in small), key=str)
    long = next(r for r in rows if r["doc_id"] == 154)
    assert (long["n_runs"], long["start"], long["length"], long["period"]) == (1, 0, 20_000, 1)


def test_empty_and_null_keys(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert runs.collapse_runs(empty).collect() == []
    one = spark.createDataFrame([(None, "a b " * 20)], "doc_id long, text string")
    assert queries.period_columns(runs.collapse_runs(one, order=queries.planted_period)).first()["n_runs"] == 1


@pytest.mark.parametrize("key", [0, 3, 11, 40, 77])
def test_planted_period(key):
    words = [str(i) for i in range(57)]
    places = queries.planted_period(key, len(words))
    assert altered(key, words) == (words if places is None else [words[i] for i in places])
