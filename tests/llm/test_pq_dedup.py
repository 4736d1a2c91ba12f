import numpy as np

from corpusloom.llm.pq_dedup import Index, near_duplicates, unit


def brute(rows, least=0.93):
    ok = [r[1] is not None and r[2] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    reach, n = {i: r[0] for i, r in enumerate(rows)}, [0] * len(rows)
    links = []
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if i != j and ok[i] and ok[j] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    n[i] += 1
                    links.append((i, j))
    for _ in rows:
        for i, j in links:
            reach[i] = min((x for x in (reach[i], reach[j]) if x is not None), default=None)
    return sorted(((r[0], n[i], reach[i], r[0] == reach[i]) for i, r in enumerate(rows)), key=str)


def test_same_as_brute_force(spark):
    rng, rows = np.random.default_rng(4), []
    for i in range(160):
        base = rng.normal(size=12)
        for k in range(rng.integers(1, 5)):
            rows.append((len(rows) * 3 % 1009, [float(x) for x in np.float32(base + rng.normal(0, 0.28, 12) * (k > 0))], int(rng.integers(0, 3))))
    rows += [(rows[0][0], rows[0][1], rows[0][2]), (2000, rows[0][1], rows[0][2]), (2001, None, 1), (2002, [0.0] * 12, 1), (2003, [float("nan")] * 12, 1), (2004, [1.0, None] + [0.0] * 10, 1)]
    rows += [(2005, [], 1), (2006, rows[0][1], None), (2007, [1.0, 2.0], 1), (2008, [2.0, 4.0], 1), (2009, [float("inf")] * 12, 1)]
    # keys that stand for several vectors, and null ones
    x, y, z = np.eye(3, 12).tolist()
    near = lambda v: [a + 0.01 for a in v]
    rows += [(1, x, 9), (1, y, 9), (2, near(x), 9), (3, near(y), 9), (None, z, 9), (None, near(z), 9), (None, near(x), 9), (1, x, 8), (0, near(x), 8)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, n_links string")
    got = sorted((tuple(r) for r in near_duplicates(df, lists=16).collect()), key=str)
    assert got == brute(rows)
    assert near_duplicates(df.limit(0)).count() == 0
    assert near_duplicates(df.filter("vec_id > 2000 AND vec_id < 2003")).count() == 2


def test_bounds_lose_nothing():
    rng = np.random.default_rng(8)
    x = unit(rng.normal(size=(3000, 32)))
    x = np.vstack([x, unit(x + rng.normal(0, 0.06, x.shape))])
    index, reach = Index.fit(x[:1000], 32), np.sqrt(2 - 2 * 0.93)
    own, codes, error = index.code(x)
    probes = index.probes(x, own, reach)
    for i in range(0, 3000, 7):
        j = i + 3000
        if x[i] @ x[j] < 0.93:
            continue
        a, b = (i, j) if own[i] <= own[j] else (j, i)
        assert own[a] == own[b] or own[b] in probes[a]
        assert index.table_distances(x[a : a + 1], codes[b : b + 1], own[b])[0, 0] <= reach + error[b] + 1e-4
    assert np.mean([len(p) for p in probes]) < 16
