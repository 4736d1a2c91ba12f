import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pandas as pd
import pytest

from corpusloom.llm import conversation_trie as ct
from corpusloom.llm import queries

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(rows):
    """The trie by plain dictionaries; rows (conv_id, turn, role, text) without ties of turns in a conversation."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = own.get(c - c % 20, [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in made.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        saved = (len(members[p]) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        ends = ",".join(map(str, sorted(c for c in members[p] if len(made[c]) == len(p))))
        kids = [out[k] for k in children[p]]
        out[p] = (min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids), sum(k[5] for k in kids) or 1, saved + sum(k[6] for k in kids), hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=str)


def random_rows(seed, convs, most, texts):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * convs), convs):
        turns = rng.sample(range(-2, 2 * most), rng.randrange(1, most + 1))
        for k, t in enumerate(turns):
            rows.append((c, None if k == 0 and rng.random() < 0.2 else t, rng.choice(["user", "assistant", None, ""]) if rng.random() < 0.3 else "user", rng.choice(texts)))
    return rows


def table(spark, rows, path=None):
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, node string")
    if path:
        df.write.parquet(path)
    return df


def result(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=str)


@pytest.mark.parametrize(("convs", "most", "texts", "shard"), [(150, 6, ["a b", "c", "", None, "d e f"], 4096), (300, 5, ["a", "b c"], 7), (40, 60, ["a a"], 5), (30, 4, ["x\ty", "é"], 1)])
def test_against_dictionaries(spark, monkeypatch, convs, most, texts, shard):
    monkeypatch.setattr(ct, "SHARD", shard)
    rows = random_rows(convs, convs, most, texts)
    assert result(ct.prefix_trie(table(spark, rows), block=20, lent=4)) == expected(rows)


def test_shard_by_itself():
    s = ct.Shard()
    for c, turns in ((3, "ab"), (5, "ab"), (8, "a"), (9, "ac"), (12, "")):
        s.add(c, [(t.encode() * 16, 1) for t in turns])
    got = sorted((d, n, m, e) for _, _, d, n, m, _, _, e in s.nodes())
    assert got == [(0, 5, 3, "12"), (1, 4, 3, "8"), (2, 1, 9, "9"), (2, 2, 3, "3,5")]


def test_query_with_nulls_repeats_and_long_conversations(spark, tmp_path):
    rows = random_rows(9, 120, 5, ["a b", "c"]) + [(None, 0, "user", "lost"), (None, None, None, None)]
    rows += [(1000 + i, t, "user", f"turn {t % 2}") for i in range(3) for t in range(400 + i)]
    rows += [(2000, None, None, None), (2021, 0, "user", "x " * 50_000), (-7, 0, "user", "below zero")]
    table(spark, rows, f"{tmp_path}/conversations.parquet")
    assert result(queries.op12_conversation_trie(spark, str(tmp_path))) == expected(rows)


def test_repeated_rows_and_sql(spark, tmp_path):
    rows = random_rows(4, 100, 4, ["a b", "c", "d"])
    rows += rows[:40] + [(5, 1, "user", "tie one"), (5, 1, "user", "tie two")]
    df = table(spark, rows, f"{tmp_path}/conversations.parquet")
    c = duckdb.connect()
    c.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    want = c.sql(f"SELECT {', '.join(NAMES)} FROM ({ct.ORACLE})").fetchall()
    assert result(ct.prefix_trie(df, block=20, lent=4)) == sorted(want, key=str)


def test_no_block_and_empty(spark):
    assert ct.prefix_trie(table(spark, [])).collect() == []
    one = ct.prefix_trie(table(spark, [(4, 0, "user", "hi"), (9, 0, "user", "hi")])).collect()
    assert sorted((r["conv_id"], r["depth"], r["n_convs"], r["saved_tokens"]) for r in one) == [(4, 0, 2, 1), (4, 1, 2, 1)]
