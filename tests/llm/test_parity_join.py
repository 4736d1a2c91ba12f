import random
import re

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import parity_join as pj
from corpusloom.llm.rule_stats import word_hashes

WORD = r"[^\x20\x09-\x0D]+"


def shingles(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(WORD, text or "")]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, percent=75):
    sets = [shingles(t) for _, t in rows]
    low = {k: k for k, _ in rows}
    links = [(rows[i][0], rows[j][0]) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j and x and y and 100 * len(x & y) >= percent * len(x | y)]
    for _ in rows:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return sorted((k, len(s), low[k]) for (k, _), s in zip(rows, sets, strict=True))


def corpus(rng, groups, vocabulary, most):
    words = [f"w{i}" for i in range(vocabulary)]
    passage = rng.choices(words, k=60)
    rows = []
    for _ in range(groups):
        base = rng.choices(words, k=rng.choice([3, 6, 12, 40, 90, 200]))
        if rng.random() < 0.4:
            base += passage
        for _ in range(rng.randint(1, most)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            if rng.random() < 0.3:
                copy = copy[rng.randint(0, 2) :]
            text = " ".join(copy)
            rows.append(text.upper() if rng.random() < 0.1 else text)
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_same_as_brute_force(spark):
    rng = random.Random(5)
    rows = corpus(rng, 120, 3000, 5)
    # a large group of near copies, and a passage of which many texts consist
    base = [f"v{i}" for i in range(150)]
    n = len(rows)
    rows += [(n + i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i, k in enumerate(rng.choices(range(150), k=60))]
    n = len(rows)
    rows += [(n + i, " ".join(base[:40] + [f"y{i}_{j}" for j in range(12)])) for i in range(40)]
    rows += [(len(rows), ""), (len(rows) + 1, None), (len(rows) + 2, "\n \t")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_shingles int")
    got = sorted(tuple(r) for r in pj.similar_documents(df).collect())
    assert got == brute(rows)


def test_odd_rows(spark):
    t = "a b c d e f g h i j k l m n o p q r s t"
    rows = [(5, t), (None, t), (7, t.upper()), (7, "other words here and there today"), (9, "Other words here and there today"), (8, None), (4, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in pj.similar_documents(df).collect()), key=str)
    assert got == sorted([(5, 16, 5), (None, 16, None), (7, 16, 5), (7, 2, 5), (9, 2, 5), (8, 0, 8), (4, 1, 4)], key=str)
    assert pj.similar_documents(df.limit(0)).count() == 0
    kept = pj.keep_first(df)
    assert kept.columns == df.columns and sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 4, 5, 8]


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 400), st.integers(0, 400), st.integers(0, 2**32))
def test_similar_sets_share_a_key(common, more_a, more_b, seed):
    rng = np.random.default_rng(seed)
    x = np.unique(rng.integers(0, 2**64, common + more_a + more_b, dtype=np.uint64))
    a, b = np.sort(x[: common + more_a]), np.sort(np.concatenate([x[:common], x[common + more_a :]]))
    if 100 * common < 75 * len(x) or (len(a) == len(b) == common):
        return
    # a third of the shingles of the lower half are frequent ones
    low = x[(x < pj._HALF) & (x % np.uint64(3) == 0)] << np.uint64(1)
    frequent = np.sort(pj._packed_name(low >> np.uint64(56), low & np.uint64((1 << 48) - 1), 8))
    keys, owner = pj.join_keys([a, b, a[:0]], frequent, 8, 75)
    assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())
    sa, sb = (np.array(pj.bit_sketch(s)).view(np.uint64) for s in (a, b))
    assert np.bitwise_count(sa ^ sb).sum() <= len(np.setxor1d(a, b))


def test_groups_over_few_list_stars_only():
    keys = np.full(100, 77, np.uint64)
    p = pd.DataFrame([(1, *r[1:]) for r in pj._flush([keys], [np.arange(100)], 59)], columns=["range", "low", "mid", "id_low", "id_high"])
    out = pj._candidates(p, 5)
    assert len(out[out.g.isna()]) == 99 and len(out[out.g.notna()]) == 100


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB éÀ\t\n\x1c漢", max_size=40), st.text(alphabet="ab ", min_size=100, max_size=400)), max_size=6))
def test_word_hashes_tell_words_apart(texts):
    h, n = word_hashes(texts)
    words = [w for t in texts for w in (t or "").encode().lower().split()]
    assert n.tolist() == [len((t or "").encode().split()) for t in texts]
    assert len(words) == len(h) and len({*zip(words, h.tolist(), strict=True)}) == len({*words}) == len({*h.tolist()})
