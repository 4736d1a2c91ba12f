import random

import numpy as np

from corpusloom.llm import html_extract as hx


def test_structure():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
    <header>Site</header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- ad <p>no</p> --><div class="cookie-notice">Cookies</div>
    <article class="post"><header><h1>Head&amp;line &lt;x&gt;</h1></header><p><b>Bo</b>ld&nbsp;text<br>two  <i>words</i><p title="a > b">three</p>
    <aside>no</aside><form>no<input></form><div id="comments"><p>no</p></div><div style="display:none">no</div>end &copy</article><footer>&copy; me</footer></body></html>"""
    assert " ".join(t for p, t in hx.blocks(page) if p == hx.ARTICLE) == "Head&line <x> Bold text two words three end ©"
    main = "<main><p>a</p><article>b</article></main><article class=comment>c</article>"
    assert [t for p, t in hx.blocks(main) if p == hx.ARTICLE] == ["b"]
    assert [t for p, t in hx.blocks("<article><p>x &am") if p == hx.ARTICLE] == ["x &am"]
    assert [t for p, t in hx.blocks('<article><p>x</p><p class="y') if p == hx.ARTICLE] == ["x"]
    assert hx.blocks("") == [] and hx.blocks("1 < 2 <3") == [(hx.OPEN, "1 < 2 <3")]


def brute(pages):
    distinct = {tuple(p) for p in pages}
    out = []
    for p in pages:
        c = [False] * len(p)
        for i in range(len(p) - hx.RUN + 1):
            w = tuple(p[i : i + hx.RUN])
            if any(w == q[j : j + hx.RUN] for q in distinct if q != tuple(p) for j in range(len(q))):
                c[i : i + hx.RUN] = [True] * hx.RUN
        out.append(c)
    return out


def test_repeated_runs():
    rng = random.Random(2)
    shared = [f"b{i}" for i in range(11)]
    pages = [rng.choices("abcdefghijklm", k=rng.randint(0, 30)) + (shared if rng.random() < 0.5 else []) + rng.choices("nopqrst", k=rng.randint(0, 20)) for _ in range(30)]
    pages += [pages[3], pages[4][:]]
    assert [c.tolist() for c in hx.repeated(pages, np.zeros(0, np.uint64))] == brute(pages)


def test_pages(spark, monkeypatch):
    foot = "<p>this same notice stands on every page of the host today</p>"
    rows = [(i, f"http://h.example/{i}", f"<body><div>{' '.join(f'u{i}_{j}' for j in range(12))}</div>{foot}</body>", "x") for i in range(6)]
    rows += [(10, "http://h.example/a", f"<article>Kept {foot}</article>", "x"), (11, None, None, "x"), (None, "u", "", "x"), (0, rows[0][1], rows[0][2], "x"), (12, "http://other.example", foot, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    want = {i: " ".join(f"u{i}_{j}" for j in range(12)) for i in range(6)} | {10: "Kept this same notice stands on every page of the host today", 11: "", None: "", 12: "this same notice stands on every page of the host today"}
    out = hx.extract_pages(df).collect()
    assert len(out) == len(rows) and all(r.text == want[r.page_id] and r.n_chars == len(r.text) for r in out)
    assert hx.extract_pages(df.limit(0)).count() == 0
    monkeypatch.setattr(hx, "SHARD", 30)
    out = hx.extract_pages(df).collect()
    assert len(out) == len(rows) and all(r.text == want[r.page_id] for r in out)


def test_names_inside_an_article_tell_its_subject():
    page = """<nav class="site-search">Menu</nav><div class="related-links">More</div><article><h2 id="search-engines">Engines</h2><p id="share-prices">Share prices rose.</p>
    <p id="search">Found.</p><div class="related-work">Earlier work</div><div class="ad">Buy</div><div class="widget comments">Nice!</div><aside>Side</aside><form>Mail</form><p>End.</p></article><footer>Foot</footer>"""
    assert " ".join(t for p, t in hx.blocks(page) if p == hx.ARTICLE) == "Engines Share prices rose. Found. Earlier work End."


def test_very_long_page():
    page = "<article>" + "".join(f"<p>word{i} and more</p>" for i in range(100_000)) + "</article>"
    assert len(hx.blocks(page)) == 100_000


def test_parts_inside_an_article():
    parts = ["cookie-notice", "ad-slot", "share-bar", "comment-list", "article-comments", "newsletter-box", "AdContainer", "post-share_buttons", "sponsored"]
    page = "<article><p>Start.</p>" + "".join(f'<div class="x {c}">no</div>' for c in parts) + '<ul class="breadcrumbs-list"><li>no</li></ul><div id="comments">no</div><section id="comment-list">no</section><p>End.</p></article>'
    assert [t for p, t in hx.blocks(page) if p == hx.ARTICLE] == ["Start.", "End."]


def test_passages_of_an_article_stay():
    page = """<article><p title="The hidden fortress">Film text.</p><p alt="display: none">Shown.</p><section id="search">How search works.</section><div id="menu">Our menu today.</div>
    <div class="related-work-section">Earlier work.</div><div class="share-prices">Prices rose.</div><div id="widget-list">Widgets.</div><p data-x=hidden>Plain.</p><a href="/hidden">Link.</a><p class="notice-periods">Periods.</p></article>"""
    assert " ".join(t for p, t in hx.blocks(page) if p == hx.ARTICLE) == "Film text. Shown. How search works. Our menu today. Earlier work. Prices rose. Widgets. Plain. Link. Periods."


def test_what_is_not_shown():
    page = """<article><p hidden>no</p><p class=a hidden="">no</p><div aria-hidden = 'TRUE'>no</div><div style="color:red; display : none">no</div><p style='visibility:hidden'>no</p><p aria-hidden="false" style="display:block">yes</p></article>"""
    assert [t for p, t in hx.blocks(page) if p == hx.ARTICLE] == ["yes"]
