"""Main text of web pages: page structure, and a suffix array over each host's text for what structure leaves open.

A page's text falls into its article (what an article or main element marks), parts that structure tells to be
something else (menus, headers, footers, sidebars, notices, adverts, forms, comments), and open text. Of article text
only those runs of tokens go that over PERCENT of the host's distinct articles have: they are the host's, not the
article's. What fewer pages repeat stays, as copies and quoted passages are text, and so does an article of which over
half would go. Open text is the main text of pages that mark no article. There, runs of tokens that other pages of the host repeat are boilerplate. They are found in a
suffix array of the host's pages, over open and other parts alike, and unique runs stay.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stash
from .common import lookup
from .rule_stats import mixed, window_hashes

#: Tokens that a repeated run has at least, and tokens of a host that one suffix array holds.
RUN, SHARD = 8, 400_000
#: Distinct articles that a host has at least, and share of them that a run has to exceed, for it to be the host's own.
ARTICLES, PERCENT = 8, 75

# Elements whose content is no text, elements and words of class, id or role that are not the article.
HIDDEN = {"script", "style", "noscript", "template", "svg", "head", "title", "iframe", "object", "select", "textarea", "button", "canvas", "math"}
ASIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
WORDS = {"nav", "navbar", "navigation", "menu", "header", "masthead", "footer", "sidebar", "aside", "ad", "ads", "advert", "adverts", "advertisement", "banner", "sponsor", "sponsored", "promo", "cookie", "cookies", "consent", "notice", "notification", "popup", "modal", "overlay", "breadcrumb", "breadcrumbs", "pagination", "pager", "toolbar", "widget", "related", "recommended", "share", "sharing", "social", "newsletter", "subscribe", "signup", "login", "search", "comment", "comments", "respond", "reply", "replies", "disqus", "contentinfo", "complementary", "alert", "alertdialog", "hidden"}
# What holds a part of a page, and where it stands, in names made of several words; ids that no passage of an article has.
HOLDERS = {"area", "bar", "block", "box", "buttons", "container", "form", "inner", "links", "list", "panel", "section", "slot", "unit", "wrapper", "zone"}
PLACES = {"article", "bottom", "inline", "page", "post", "site", "sticky", "top"}
IDS = {"ad", "ads", "advert", "adverts", "advertisement", "breadcrumb", "breadcrumbs", "comment", "comments", "cookies", "disqus", "navbar", "newsletter", "pagination", "respond", "sidebar"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|iframe|noscript|template|svg)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][\w:-]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:@][\w:.@-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_UNSEEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

_TEXTUAL = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "li", "td", "th", "dt", "dd", "pre", "figcaption"}

ARTICLE, OPEN, OTHER = 0, 1, 2


def _names_part(name: str) -> bool:
    """Is a class or role, as a whole, that of a part of a page? Names of several words are if they end in such a part
    or in what holds one, and have only parts and places before that: cookie-notice, ad-slot, article-comments."""
    if name.lower() in WORDS:
        return True
    words = [x.lower() for x in _NAME.findall(name)]
    known = [w in WORDS for w in words]
    return len(words) > 1 and any(known) and (known[-1] or words[-1] in HOLDERS) and all(k or w in PLACES for k, w in zip(known[:-1], words[:-1], strict=True))


def _other(tag: str, attributes: str, inside: bool) -> bool:
    """Does an element start a part that is not the article? A header of an article is part of it.

    What is not shown is told by the attributes hidden, aria-hidden and style. Outside of an article any word of a class,
    id or role tells; inside only whole names do, as words of names tell what a passage is about, and ids only where they
    are never a passage's."""
    if tag in ASIDE or tag == "header" and not inside:
        return True
    if not attributes:
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and _UNSEEN_STYLE.search(value):
            return True
        if name not in ("class", "id", "role"):
            continue
        if not inside:
            named = not WORDS.isdisjoint(x.lower() for x in _NAME.findall(value))
        elif name == "id":
            words = [x.lower() for x in _NAME.findall(value)]
            named = tag not in _TEXTUAL and (value.lower() in IDS or _names_part(value) and any(w in IDS for w in words) and len(words) > 1)
        else:
            named = any(_names_part(x) for x in value.split())
        if named and tag not in ("html", "body", "article", "main") or tag == "article" and "comment" in value.lower():
            return True
    return False


def blocks(page: str) -> list[tuple[int, str]]:
    """(part, text) of each block with text, in page order. Main elements count as articles where none is marked."""
    out: list[list] = []
    stack: list[tuple[str, int, int]] = []
    part, marked = OPEN, 2
    held: list[str] = []

    def close() -> None:
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append([part, marked, text])

    at = 0
    for m in _TAG.finditer(page):
        if part < 3:
            held.append(page[at : m.start()])
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            close()
        if m[2] or m[5]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag in INLINE and any(t[0] not in INLINE for t in stack[i:]):
                        break
                    close() if stack[i][1] != part or stack[i][2] != marked else None
                    part, marked = stack[i][1:]
                    del stack[i:]
                    break
        elif tag not in VOID and not (m[4] or m[7] or "").rstrip().endswith("/"):
            now, mark = part, marked
            attributes = m[4] or m[7] or ""
            if tag in HIDDEN:
                now = 3
            elif part != OTHER and part != 3 and _other(tag, attributes, part == ARTICLE):
                now = OTHER
            elif part == OPEN and (tag in ("article", "main") or re.search(r"role\s*=\s*[\"']?main", attributes, re.I)):
                now, mark = ARTICLE, 0 if tag == "article" else 1
            elif part == ARTICLE and tag == "article":
                mark = 0
            if (now, mark) != (part, marked):
                close()
            stack.append((tag, part, marked))
            part, marked = now, mark
    if part < 3:
        held.append(page[at:])
    close()
    # with an article inside a main element, the article is meant
    best = min((b[1] for b in out if b[0] == ARTICLE), default=2)
    return [(OPEN if p == ARTICLE and k > best else p, t) for p, k, t in out if p < 3]


def host_of(url: str | None) -> str:
    m = re.match(r"\s*[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", url or "", re.I)
    return m[1].lower() if m else ""


def suffix_order(tokens: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of tokens by their first `length` (a power of two) tokens, and each suffix' rank: equal ranks
    mean equal first tokens. Built by doubling the compared length."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    step = 1
    while step < length:
        after = np.full(len(rank), -1, np.int64)
        after[:-step] = rank[step:]
        pair = rank * (rank.max(initial=0) + 2) + after + 1
        order = np.argsort(pair, kind="stable")
        p = pair[order]
        new = np.zeros(len(rank), np.int64)
        new[order] = np.cumsum(np.concatenate([[0], (p[1:] != p[:-1]).astype(np.int64)]))
        rank, step = new, step * 2
    return order, rank


def repeated(pages: list[list[str]], known: np.ndarray) -> list[np.ndarray]:
    """Of each page's tokens, which lie in a run of RUN or more that a distinct page has too, or whose hash is known.

    Pages of equal tokens count as one page, so that copies of a page are no boilerplate of each other."""
    sizes = np.array([len(p) for p in pages], np.int64)
    words = [w for p in pages for w in p]
    names = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(names.__getitem__, words), np.int64, len(words))
    first: dict[tuple, int] = {}
    same = np.array([first.setdefault(tuple(p), i) for i, p in enumerate(pages)])
    owner = np.repeat(np.arange(len(pages)), sizes)
    # a separator of its own ends each page
    tokens, at = np.zeros(len(ids) + len(pages), np.int64), np.arange(len(ids)) + owner
    tokens[at] = ids
    ends = np.cumsum(sizes + 1) - 1
    tokens[ends] = len(names) + np.arange(len(pages))
    order, rank = suffix_order(tokens, RUN)
    page = np.repeat(np.arange(len(pages)), sizes + 1)
    group = same[page[order]]
    r = rank[order]
    starts = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else np.zeros(0, int)
    hit = np.zeros(len(tokens), bool)
    if len(starts):
        low, high = np.minimum.reduceat(group, starts), np.maximum.reduceat(group, starts)
        hit[order] = np.repeat(low != high, np.diff(np.append(starts, len(r))))
    if len(known):
        h = page_windows(words, sizes)
        where = np.flatnonzero(h[1])
        hit[at[where[np.isin(h[0][where], known)]]] = True
    edge = np.zeros(len(tokens) + RUN + 1, np.int64)
    where = np.flatnonzero(hit)
    np.add.at(edge, where, 1)
    np.add.at(edge, where + RUN, -1)
    covered = np.cumsum(edge)[: len(tokens)] > 0
    return np.split(covered[at], np.cumsum(sizes)[:-1]) if len(pages) else []


def shared_runs(pages: list[list[str]]) -> np.ndarray:
    """Hashes of the runs of RUN tokens that over PERCENT of the pages have, by the suffix array of all."""
    sizes = np.array([len(p) for p in pages], np.int64)
    words = [w for p in pages for w in p]
    if not words:
        return np.zeros(0, np.uint64)
    names = {w: i for i, w in enumerate(dict.fromkeys(words))}
    owner = np.repeat(np.arange(len(pages)), sizes)
    # a separator of its own ends each page
    tokens, at = np.arange(len(names), len(names) + len(words) + len(pages)), np.arange(len(words)) + owner
    tokens[at] = np.fromiter(map(names.__getitem__, words), np.int64, len(words))
    order, rank = suffix_order(tokens, RUN)
    page, r = np.repeat(np.arange(len(pages)), sizes + 1)[order], rank[order]
    # equal suffixes keep their places' order, so a page's are neighbours
    first = np.concatenate([[True], (r[1:] != r[:-1]) | (page[1:] != page[:-1])])
    often = np.bincount(r[first]) * 100 > PERCENT * len(pages)
    h, whole = page_windows(words, sizes)
    return np.unique(h[whole & often[rank[at]]])


def without_runs(blocks: list[str], runs: np.ndarray) -> str:
    """The blocks' text without tokens in runs; all of it if over half would go."""
    words = [t.split() for t in blocks]
    flat = [w for b in words for w in b]
    h, whole = page_windows(flat, np.array([len(flat)]))
    where = np.flatnonzero(whole & np.isin(h, runs))
    edge = np.zeros(len(flat) + 1, np.int64)
    np.add.at(edge, where, 1)
    np.add.at(edge, where + RUN, -1)
    kept = np.cumsum(edge)[: len(flat)] == 0
    if 2 * kept.sum() < len(flat):
        kept[:] = True
    ends = np.cumsum([len(b) for b in words])
    left = (" ".join(w for w, k in zip(b, kept[e - len(b) : e].tolist(), strict=True) if k) for b, e in zip(words, ends.tolist(), strict=True))
    return " ".join(t for t in left if t)


def article_of(page: str | None) -> list[str]:
    return [t for p, t in blocks(page or "") if p == ARTICLE]


def page_windows(words: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the RUN tokens from each position, and whether these are of one page."""
    h = np.zeros(len(words), np.uint64)
    w = window_hashes(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), RUN)
    h[: len(w)] = mixed(w)
    left = np.concatenate([np.arange(n, 0, -1) for n in sizes]) if len(sizes) else np.zeros(0, int)
    return h, left >= RUN


def _digest(*parts: str) -> str:
    return xxhash.xxh3_128_hexdigest("\0".join(parts).encode())


def _with_host(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([host_of(u.as_py()) for u in batch.column(1)], pa.string())], names=["key", "url", "html", "host"])


def _host_runs(rows: DataFrame, articles: DataFrame) -> DataFrame | None:
    """(h, runs): the hashes of each host's own runs, for hosts that have any; None if none has.

    rows: (key, url, html); articles: (host, article, size) of the pages that mark one of RUN tokens or more."""
    distinct = articles.groupBy("host", "article").agg(F.first("size").alias("size"))
    hosts = distinct.groupBy(F.col("host").alias("h")).agg(F.count(F.lit(1)).alias("articles"), F.ceil(F.sum("size") / SHARD).cast("int").alias("shards"))
    hosts = stash(hosts.filter(F.col("articles") >= ARTICLES), "article-hosts")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # copies are sent once by each task
        seen: set[str] = set()
        for batch in batches:
            out = []
            for u, h in zip(batch.column(1), batch.column(2), strict=True):
                text, host = " ".join(article_of(h.as_py())), host_of(u.as_py())
                name = _digest(host, text)
                if text and name not in seen:
                    seen.add(name)
                    out.append((host, _digest(text), text))
            if len(seen) > 1 << 20:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.string()) for i in range(3)], names=["host", "article", "text"])

    def find(p: pd.DataFrame) -> pd.DataFrame:
        once = p.drop_duplicates("article")
        words = [w for w in map(str.split, once["text"]) if len(w) >= RUN]
        found = shared_runs(words)
        return pd.DataFrame({"host": np.full(len(found), p["host"].iloc[0], object), "run": found.view(np.int64)})

    sent = rows.mapInArrow(tokens, "host string, article string, text string").join(hosts, F.col("host") == F.col("h"))
    dealt = sent.withColumn("shard", F.pmod(F.xxhash64("article"), "shards").cast("int")).select("host", "shard", "article", "text")
    likely = stash(dealt.groupBy("host", "shard").applyInPandas(find, "host string, run long").distinct(), "likely-runs")
    if likely.isEmpty():
        return None

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, article, run = [], [], []
            for h, u, likely in zip(batch.column(2), batch.column(3), batch.column(4), strict=True):
                words = " ".join(article_of(h.as_py())).split()
                hashes, whole = page_windows(words, np.array([len(words)]))
                both = np.intersect1d(hashes[whole], np.array(likely.as_py(), np.int64).view(np.uint64)).view(np.int64).tolist()
                host += [u.as_py()] * len(both)
                article += [_digest(" ".join(words))] * len(both)
                run += both
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(article, pa.string()), pa.array(run, pa.int64())], names=["host", "article", "run"])

    kind = rows.schema["key"].dataType.simpleString()
    lists = likely.groupBy(F.col("host").alias("h")).agg(F.collect_list("run").alias("runs"))
    named = rows.mapInArrow(_with_host, f"key {kind}, url string, html string, host string").join(lists, F.col("host") == F.col("h")).select("key", "url", "html", "host", "runs")
    counted = named.mapInArrow(meet, "host string, article string, run long").distinct().groupBy("host", "run").agg(F.count(F.lit(1)).alias("n"))
    own = counted.join(hosts, F.col("host") == F.col("h")).filter(F.col("n") * 100 > F.col("articles") * PERCENT)
    own = stash(own.groupBy("h").agg(F.collect_list("run").alias("runs")), "host-runs")
    return None if own.isEmpty() else own


def extract_pages(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every row of pages.

    Character references are decoded, white space in a block becomes one space, blocks are joined by a space in page
    order. A null html gives an empty text, a null url belongs to the host ''. Repeated rows get equal texts; an
    empty table gives an empty result; other columns are not read.

    Hosts with over SHARD tokens outside articles, those of equal pages counted once, are dealt to several suffix
    arrays. Each gets the hashes of its own runs that others have too, so that the result does not depend on the
    dealing. Articles are dealt in the same way: what over PERCENT of all have, over PERCENT of some deal have, and each
    such run is then counted over all articles. Pages are parsed again where their texts are needed, which costs less
    than to keep these.
    """
    rows = pages.select(pages[key].alias("key"), pages[url].cast("string").alias("url"), pages[html].cast("string").alias("html"))
    kind = rows.schema["key"].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, articles, sizes, runs, kinds = [], [], [], [], []
            for u, h in zip(batch.column(1), batch.column(2), strict=True):
                found = blocks(h.as_py() or "")
                rest = [(p, t) for p, t in found if p != ARTICLE]
                hosts.append(host_of(u.as_py()))
                text = " ".join(t for p, t in found if p == ARTICLE)
                articles.append(_digest(text) if text else None)
                sizes.append(len(text.split()))
                runs.append([t for _, t in rest])
                kinds.append([p == OPEN for p, _ in rest])
            marked = [a is not None for a in articles]
            streams = [" ".join(r) for r in runs]
            same = [_digest(h, s) for h, s in zip(hosts, streams, strict=True)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(hosts, pa.string()), pa.array(articles, pa.string()), pa.array(sizes, pa.int64()), pa.array(marked, pa.bool_()), pa.array(runs, pa.list_(pa.string())), pa.array(kinds, pa.list_(pa.bool_())),
                pa.array([len(s.split()) for s in streams], pa.int64()), pa.array(same, pa.string()),
                pa.array([None if m else _digest(d, repr((r, k))) for m, d, r, k in zip(marked, same, runs, kinds, strict=True)], pa.string()),
            ], names=["key", "url", "host", "article", "size", "marked", "blocks", "open", "n", "stream", "variant"])

    parsed = stash(rows.mapInArrow(parse, f"key {kind}, url string, host string, article string, size long, marked boolean, blocks array<string>, open array<boolean>, n long, stream string, variant string"), "parsed-pages")
    bare = parsed.filter("NOT marked").select("key", "url", "host", "stream", "variant", "blocks", "open", "n")
    # pages of hosts where none is open are not looked at. Pages of equal tokens are one row before any text moves; each
    # way in which open pages are made of these tokens is a variant
    asked = bare.select(F.col("host").alias("h"), F.lit(True).alias("asked")).distinct()
    read = lookup(parsed.filter("n > 0").select("host", "stream", "n", "blocks"), asked, "host", "h", ["asked"]).filter("asked")
    streams = stash(read.groupBy("host", "stream").agg(F.first("n").alias("n"), F.first(F.array_join("blocks", " ")).alias("tokens")), "streams")
    hosts = stash(streams.groupBy(F.col("host").alias("h")).agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / SHARD)).cast("int").alias("shards")), "hosts")
    ways = bare.filter("n > 0").groupBy("stream", "variant").agg(F.first("blocks").alias("blocks"), F.first("open").alias("open"))
    ways = ways.groupBy(F.col("stream").alias("s")).agg(F.collect_list(F.struct("variant", "blocks", "open")).alias("ways"))
    dealt = lookup(streams, hosts, "host", "h", ["shards"]).withColumn("shard", F.pmod(F.xxhash64("stream"), "shards").cast("int"))
    dealt = stash(dealt.join(ways, F.col("stream") == F.col("s"), "left").select("host", "shard", "shards", "tokens", "ways"), "dealt-streams")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.to_pydict()
            out = []
            for t in d["tokens"]:
                words = t.split()
                h, whole = page_windows(words, np.array([len(words)]))
                out.append(np.unique(h[whole]))
            sizes = [len(o) for o in out]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(d["host"], object), sizes), pa.string()), pa.array(np.repeat(np.array(d["shard"], np.int32), sizes)), pa.array(np.concatenate([np.zeros(0, np.uint64), *out]).view(np.int64))], names=["host", "shard", "h"])

    held = dealt.filter("shards > 1").select("host", "shard", "tokens").mapInArrow(windows, "host string, shard int, h long").distinct()
    # runs of two shards are of distinct pages; a shard gets only those that it holds
    known = held.groupBy("host", "h").agg(F.collect_list("shard").alias("at")).filter("size(at) > 1").select("host", F.explode("at").alias("shard"), "h")

    def clean(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cover = repeated([t.split() for t in left["tokens"]], np.unique(right["h"].to_numpy(np.int64).view(np.uint64)) if len(right) else np.zeros(0, np.uint64))
        out = []
        for ways, c in zip(left["ways"], cover, strict=True):
            for way in ways if ways is not None else ():
                kept, at = [], 0
                for t, o in zip(way["blocks"], way["open"], strict=True):
                    words = t.split()
                    if o:
                        kept += [" ".join(w for _, w in run) for unique, run in groupby(zip(~c[at : at + len(words)], words, strict=True), key=lambda x: x[0]) if unique]
                    at += len(words)
                out.append((way["variant"], " ".join(kept)))
        return pd.DataFrame(out, columns=["id", "runs"])

    cleaned = stash(dealt.select("host", "shard", "tokens", "ways").groupBy("host", "shard").cogroup(known.groupBy("host", "shard")).applyInPandas(clean, "id string, runs string"), "cleaned-pages")
    runs = _host_runs(rows, parsed.filter(F.col("size") >= RUN).select("host", "article", "size"))

    def articles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [article_of(h.as_py()) for h in batch.column(2)]
            gone = [np.array(r.as_py() or [], np.int64).view(np.uint64) for r in batch.column(3)]
            text = [(without_runs(f, g) if len(g) else " ".join(f)) if f else None for f, g in zip(found, gone, strict=True)]
            part = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], names=["key", "url", "text"])
            yield part.filter(pa.array([t is not None for t in text], pa.bool_()))

    asked = rows.withColumn("runs", F.lit(None).cast("array<bigint>"))
    if runs is not None:
        asked = rows.mapInArrow(_with_host, f"key {kind}, url string, html string, host string").join(runs, F.col("host") == F.col("h"), "left").select("key", "url", "html", "runs")
    marked = asked.mapInArrow(articles, f"key {kind}, url string, text string")
    out = marked.unionByName(lookup(bare.select("key", "url", "variant"), cleaned, "variant", "id", ["runs"]).select("key", "url", F.coalesce("runs", F.lit("")).alias("text")))
    return out.select(F.col("key").alias(key), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars"))
