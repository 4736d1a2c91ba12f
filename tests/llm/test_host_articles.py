from corpusloom.llm import html_extract as hx

LINE = "write to the desk of this paper every day"


def test_a_line_of_most_articles_is_the_hosts(spark, monkeypatch):
    own = lambda i: " ".join(f"u{i}_{j}" for j in range(30))
    quoted = "these nine words are quoted by half of them"
    page = lambda i: f"<article><p>{own(i)}</p><div class=x>{LINE}</div><p>end{i} {quoted if i % 2 else ''}</p></article>"
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(12)] + [(20, "http://h.example/copy", page(1)), (21, "http://few.example/", page(1)), (22, "http://h.example/short", f"<article>{LINE}</article>")]
    # near copies of one article share more than a line, and stay
    rows += [(30 + i, f"http://k.example/{i}", f"<article>{own(99)} v{i}</article>") for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    text = lambda i: f"{own(i)} end{i} {quoted}" if i % 2 else f"{own(i)} end{i}"
    want = {i: text(i) for i in range(12)} | {20: text(1), 21: f"{own(1)} {LINE} end1 {quoted}", 22: LINE} | {30 + i: f"{own(99)} v{i}" for i in range(9)}
    for shard in (400_000, 150):
        monkeypatch.setattr(hx, "SHARD", shard)
        assert {r.page_id: r.text for r in hx.extract_pages(df).collect()} == want


def test_shared_runs():
    line = LINE.split()
    pages = [[f"a{i}", *line, f"b{i}"] for i in range(4)] + [["x"] * 9]
    assert len(hx.shared_runs(pages)) == len(line) - hx.RUN + 1
    assert len(hx.shared_runs(pages[2:])) == 0 and len(hx.shared_runs([])) == 0
