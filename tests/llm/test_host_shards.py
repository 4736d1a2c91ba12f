import random

from corpusloom.llm import html_extract as hx


def test_copies_are_dealt_once_and_shards_get_their_own_hashes(spark, monkeypatch):
    foot = "<p>this same notice stands on every page of the host today</p>"
    page = lambda i: f"<body><div>{' '.join(f'u{i}_{j}' for j in range(12))}</div>{foot}</body>"
    rows = [(i, "http://h.example/x", page(i)) for i in range(40)] + [(100 + i, "http://h.example/copy", page(0)) for i in range(40)]
    # equal tokens in other blocks are a copy too, on whatever shard
    rows += [(200 + i, f"http://k.example/{i}", h) for i, h in enumerate(("<p>a b c d e f g h i j</p>", "<p>a b c d</p><p>e f g h i j</p>", "<nav>a b c d</nav><p>e f g h i j</p>"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    seen = spark.sparkContext.accumulator(0)
    repeated = hx.repeated

    def counted(pages, known):
        seen.add(len(pages))
        assert len(known) <= sum(max(0, len(p) - hx.RUN + 1) for p in pages)
        return repeated(pages, known)

    monkeypatch.setattr(hx, "repeated", counted)
    want = {i: " ".join(f"u{i}_{j}" for j in range(12)) for i in range(40)} | {100 + i: " ".join(f"u0_{j}" for j in range(12)) for i in range(40)} | {200: "a b c d e f g h i j", 201: "a b c d e f g h i j", 202: "e f g h i j"}
    for shard in (400_000, 60):
        monkeypatch.setattr(hx, "SHARD", shard)
        assert {r.page_id: r.text for r in hx.extract_pages(df).collect()} == want
    assert hx.extract_pages(df).count() == len(rows)


def test_every_shard_size_gives_the_brute_force_result(spark, monkeypatch):
    rng, shared = random.Random(6), [f"b{i}" for i in range(11)]
    pages = [" ".join(rng.choices("abcdefghijklm", k=rng.randint(1, 30)) + (shared if rng.random() < 0.5 else []) + rng.choices("nopqrst", k=rng.randint(0, 20))) for _ in range(40)]
    pages += pages[:5]
    df = spark.createDataFrame([(i, "http://h/", f"<p>{p}</p>") for i, p in enumerate(pages)], "page_id long, url string, html string")
    whole = {tuple(p.split()) for p in pages}

    def kept(p):
        words = p.split()
        hit = set()
        for i in range(len(words) - hx.RUN + 1):
            w = tuple(words[i : i + hx.RUN])
            if any(w == q[j : j + hx.RUN] for q in whole if q != tuple(words) for j in range(len(q))):
                hit.update(range(i, i + hx.RUN))
        return " ".join(w for i, w in enumerate(words) if i not in hit)

    for shard in (400_000, 200, 40):
        monkeypatch.setattr(hx, "SHARD", shard)
        assert {r.page_id: r.text for r in hx.extract_pages(df).collect()} == {i: kept(p) for i, p in enumerate(pages)}
