"""Repeated passages by compaction of a sparse de Bruijn graph of token k-mers.

A passage is repeated if a window of WINDOW words of it also starts elsewhere. Every window of 35 words holds 18 k-mers
of 18 words; the smallest of them (by hash, the first of equal ones) is a node of the graph. As it depends on the
window alone, windows of equal words have the same node at the same place, and a tenth of all k-mers is enough.
Neighbouring nodes of a text overlap or touch; the token k-mer from the start of one to the end of the next is an edge.

A node whose occurrences all have the same edge before and behind them doesn't branch. A path of such nodes repeats as a
whole: Spark joins the nodes' states to the texts that hold repeated nodes, each stretch of unbranched nodes is one
path, and one row stands for all of its windows. Windows whose node branches (those at the ends of passages, mostly)
get rows of their own. Rows carry digests of the words at their source coordinates; only what has the same 128 bits at
two coordinates is taken as repeated. Texts of equal words count once here: all their windows are repeated anyway.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stash
from .rule_stats import chunks, mixed, text_sizes, word_hashes

#: Words of a window, and of a node's k-mer: k-mers of half a window at least, so that neighbouring nodes leave no gap.
WINDOW, NODE = 35, 18
_BASE, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_SALT = np.uint64(0xBF58476D1CE4E5B9)
EMPTY = hashlib.sha256(b"").hexdigest()


class Digests:
    """Digests of any stretch of words of several texts in a row, from prefix sums of word hashes."""

    def __init__(self, words: np.ndarray) -> None:
        self.sums, self.scale = [], []
        with np.errstate(over="ignore"):
            for base, h in ((_BASE, words), (_SECOND, mixed(words ^ _SALT))):
                power = np.ones(len(words) + 1, np.uint64)
                power[1:] = base
                power = np.cumprod(power)
                total = np.zeros(len(words) + 1, np.uint64)
                np.cumsum(h * power[:-1], out=total[1:])
                inverse = np.ones(len(words) + 1, np.uint64)
                inverse[1:] = pow(int(base), -1, 1 << 64)
                self.sums.append(total)
                self.scale.append(np.cumprod(inverse))

    def of(self, start: np.ndarray, length: np.ndarray | int, which: int = 0) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (self.sums[which][start + length] - self.sums[which][start]) * self.scale[which][start]
            return mixed(x + np.asarray(length).astype(np.uint64) * _SECOND)


def window_nodes(kmers: np.ndarray, width: int) -> np.ndarray:
    """For each run of width neighbours the place of its smallest one, the first of equal ones."""
    n = len(kmers) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at, step = kmers, np.arange(len(kmers)), 1
    while step < width:
        # runs of step neighbours become runs of step + by
        by = min(step, width - step)
        left, right = best[: len(best) - by], best[by:]
        at = np.where(left <= right, at[: len(at) - by], at[by:])
        best = np.minimum(left, right)
        step += by
    return at


def graph_nodes(d: Digests, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows and nodes of all texts in a row: (windows' starts, the place of each one's node, the nodes' places,
    the nodes' hashes). Places count words from the first text's start."""
    n = int(counts.sum())
    if n < WINDOW:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    kmers = d.of(np.arange(n - NODE + 1), NODE)
    at = window_nodes(kmers, WINDOW - NODE + 1)
    ends = np.repeat(np.cumsum(counts), counts)
    starts = np.flatnonzero(np.arange(n) + WINDOW <= ends)
    at = at[starts]
    places = at[np.flatnonzero(np.diff(at, prepend=-1))]
    return starts, at, places, kmers[places]


def _sources(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, x, n, da, db, kept, nodes, gaps) of every row: digests of the text and of its words, the digest of all its
    words joined by one space, and the nodes with their distances as bytes."""
    text = docs[text].cast("string")
    rows = docs.select(docs[key].alias("key"), F.xxhash64(text).alias("x"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            for a, b in chunks(text_sizes(texts)):
                part = texts.slice(a, b - a)
                h, counts = word_hashes(part, lower=False)
                d = Digests(h)
                first = np.cumsum(counts) - counts
                _, _, places, nodes = graph_nodes(d, counts)
                cut = np.searchsorted(places, np.append(first, len(h)))
                gaps = np.diff(places, prepend=0).astype(np.uint8)
                kept = [hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest() for t in part.to_pylist()]
                named = [(nodes[i:j].tobytes(), gaps[i:j].tobytes()) for i, j in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(counts), pa.array(d.of(first, counts).view(np.int64)), pa.array(d.of(first, counts, 1).view(np.int64)),
                     pa.array(kept, pa.string()), pa.array([x for x, _ in named], pa.binary()), pa.array([x for _, x in named], pa.binary())],
                    names=["key", "x", "n", "da", "db", "kept", "nodes", "gaps"],
                )

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, x bigint, n bigint, da bigint, db bigint, kept string, nodes binary, gaps binary")


def _occurrences(texts: DataFrame) -> DataFrame:
    """(rid, t, node, before, behind) of every node of texts: the t-th one with its edges, 0 at the ends of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, packed, gaps = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for a, b in chunks([len(p) for p in packed]):
                counts = np.array([len(p) // 8 for p in packed[a:b]])
                node = np.frombuffer(b"".join(packed[a:b]), np.uint64)
                if not len(node):
                    continue
                gap = np.frombuffer(b"".join(gaps[a:b]), np.uint8).astype(np.uint64)
                first = np.cumsum(counts) - counts
                t = np.arange(len(node)) - np.repeat(first, counts)
                edge = np.zeros(len(node) + 1, np.uint64)
                with np.errstate(over="ignore"):
                    edge[1:-1] = mixed(mixed(node[:-1] * _BASE + gap[1:]) + node[1:]) | np.uint64(1)
                edge[:-1][t == 0] = 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(rids[a:b], counts)), pa.array(t.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in (node, edge[:-1], edge[1:]))],
                    names=["rid", "t", "node", "before", "behind"],
                )

    return texts.select("rid", "nodes", "gaps").mapInArrow(run, "rid bigint, t int, node bigint, before bigint, behind bigint")


def _node_states(occurrences: DataFrame) -> DataFrame:
    """(node, through) of nodes that occur twice or more; through if none of them branches or ends a text."""
    seen = occurrences.groupBy("node").agg(F.count(F.lit(1)).alias("c"), *(f(e).alias(f"{e}_{f.__name__}") for e in ("before", "behind") for f in (F.min, F.max)))
    same = [(F.col(f"{e}_min") == F.col(f"{e}_max")) & (F.col(f"{e}_min") != 0) for e in ("before", "behind")]
    return seen.filter("c > 1").select("node", (same[0] & same[1]).alias("through"))


def _paths_and_windows(starts: np.ndarray, at: np.ndarray, places: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of what a text may share with others: state is 0, 1 (branches) or 2 (through) for each node.

    A window is in a path if its node and it lie within a stretch of through nodes and its two neighbours; other
    windows with a repeated node stand alone. Which of both it is depends on the window's node alone, so that it is
    the same wherever the window occurs.
    """
    which = np.searchsorted(places, at)
    through = np.concatenate([[False], state == 2, [False]])
    opens, closes = np.flatnonzero(~through[:-1] & through[1:]), np.flatnonzero(through[:-1] & ~through[1:])
    low, high = places[opens - 1], places[np.minimum(closes, len(places) - 1)] + NODE
    path = np.searchsorted(opens, which, "right") - 1
    safe = np.maximum(path, 0)
    inside = (state[which] == 2) & (starts >= low[safe]) & (starts + WINDOW <= high[safe]) if len(opens) else np.zeros(len(which), bool)
    used = np.unique(path[inside])
    alone = starts[(state[which] > 0) & ~inside]
    return np.concatenate([low[used], alone]), np.concatenate([(high - low)[used], np.full(len(alone), WINDOW)])


def _shared(texts: DataFrame) -> DataFrame:
    """(a, b, rid, start, length) of paths and windows of texts (rid, text, flags); flags hold 2 * t + through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, column, flags = batch.column(0).to_pylist(), batch.column(1), batch.column(2)
            for x, y in chunks(text_sizes(column)):
                h, counts = word_hashes(column.slice(x, y - x), lower=False)
                d = Digests(h)
                starts, at, places, _ = graph_nodes(d, counts)
                ends = np.cumsum(counts)
                found = []
                for k in range(y - x):
                    low, high = int(ends[k] - counts[k]), int(ends[k])
                    i, j = np.searchsorted(starts, (low, high))
                    p, q = np.searchsorted(places, (low, high))
                    code = np.asarray(flags[x + k].values.to_numpy(zero_copy_only=False))
                    state = np.zeros(q - p, np.int64)
                    state[code >> 1] = 1 + (code & 1)
                    s, n = _paths_and_windows(starts[i:j], at[i:j], places[p:q], state)
                    found.append((np.full(len(s), rids[x + k]), s, s - low, n))
                rid, place, start, length = (np.concatenate(c) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d.of(place, length).view(np.int64)), pa.array(d.of(place, length, 1).view(np.int64)), pa.array(rid), pa.array(start.astype(np.int32)), pa.array(length.astype(np.int32))],
                    names=["a", "b", "rid", "start", "length"],
                )

    return texts.select("rid", "text", "flags").mapInArrow(run, "a bigint, b bigint, rid bigint, start int, length int")


def _covered(spans: list[dict], n: int) -> tuple[np.ndarray, list[dict]]:
    """Which of n words the spans cover, and the stretches they make up."""
    edge = np.zeros(n + 1, np.int64)
    for s in spans:
        edge[s["start"]] += 1
        edge[s["start"] + s["length"]] -= 1
    inside = np.cumsum(edge[:-1]) > 0
    ends = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    return inside, [{"start": i, "length": j - i} for i, j in zip(ends[::2].tolist(), ends[1::2].tolist(), strict=True)]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
_SPANS_DDL = "array<struct<start:bigint,length:bigint>>"


def _cut(texts: DataFrame) -> DataFrame:
    """(rid, spans, kept) of texts (rid, text, spans): joined stretches to remove and the digest of what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                words = text.as_py().encode().split()
                inside, joined = _covered(spans.as_py(), len(words))
                out.append((joined, hashlib.sha256(b" ".join([w for w, x in zip(words, inside.tolist(), strict=True) if not x])).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], _SPANS), pa.array([x[1] for x in out], pa.string())], names=["rid", "spans", "kept"])

    return texts.select("rid", "text", "spans").mapInArrow(run, f"rid bigint, spans {_SPANS_DDL}, kept string")


def repeated_spans(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, spans, kept_sha256) of every row: the stretches of words, array<struct<start, length>> from 0,
    that windows of WINDOW words cover whose words also start anywhere else, and the digest of the other words joined by
    one space.

    Words are runs of characters other than space and tab to carriage return, compared as they are; null and empty
    texts have none. Texts under WINDOW words keep all; of longer ones, those whose words another row repeats lose all.
    Rows that repeat a key, and those with a null key, are rows of their own. An empty table gives an empty result;
    other columns are not read. Text is shuffled only once, to meet the states of its nodes. A text's nodes and spans
    are one task's, as the text itself is; nothing else is gathered.
    """
    sources = stash(_sources(docs, key, text).withColumn("rid", F.monotonically_increasing_id()), "sources")
    words = ["n", "da", "db"]
    groups = sources.filter(F.col("n") >= WINDOW).groupBy(words).agg(F.count(F.lit(1)).alias("copies"), F.min("rid").alias("rid"))
    groups = stash(groups, "word-groups")
    texts = stash(sources.join(groups.select("rid"), "rid", "left_semi").select("rid", "key", "x", "nodes", "gaps"), "distinct-texts")
    states = stash(_node_states(_occurrences(texts)), "node-states")
    flags = _occurrences(texts).select("rid", "t", "node").join(states, "node").groupBy("rid").agg(F.collect_list(F.col("t") * 2 + F.col("through").cast("int")).alias("flags"))
    needed = texts.select("rid", "key", "x").join(flags, "rid")
    found = docs.select(docs[key].alias("__key"), docs[text].cast("string").alias("text"))
    found = found.withColumn("__x", F.xxhash64("text"))
    held = stash(found.join(needed, F.col("__key").eqNullSafe(F.col("key")) & (F.col("__x") == F.col("x"))).select("rid", "text", "flags"), "texts-with-repeats")
    shared = stash(_shared(held), "paths-and-windows")
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("rid", "start") for f in (F.min, F.max)]
    # written first, so that Spark may split what a frequent passage makes large in the join
    twice = stash(shared.groupBy("a", "b").agg(*ends).filter("min_rid != max_rid OR min_start != max_start").select("a", "b"), "repeated")
    # a text that other rows repeat loses all its words, whatever its spans are; those left have one row in held
    once = groups.filter("copies = 1").select("rid")
    spans = shared.join(twice, ["a", "b"], "left_semi").join(once, "rid", "left_semi").groupBy("rid").agg(F.collect_set(F.struct("start", "length")).alias("spans"))
    cut = stash(_cut(held.join(spans, "rid")), "cut-texts")
    copied = groups.filter("copies > 1").select(*(F.col(c).alias(f"g{c}") for c in words))
    out = sources.select("rid", "key", *words, F.col("kept").alias("whole")).join(cut.withColumnRenamed("rid", "crid"), F.col("rid") == F.col("crid"), "left")
    out = out.join(copied, (F.col("n") == F.col("gn")) & (F.col("da") == F.col("gda")) & (F.col("db") == F.col("gdb")), "left")
    everything = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").alias("length")))
    gone = F.col("gn").isNotNull()
    return out.select(
        F.col("key").alias(key), F.col("n").alias("n_words"), F.when(gone, everything).otherwise(F.coalesce("spans", F.array().cast(_SPANS_DDL))).alias("spans"),
        F.when(gone, F.lit(EMPTY)).otherwise(F.coalesce("kept", "whole")).alias("kept_sha256"),
    )


def span_words(spans: Column) -> Column:
    """How many words spans cover."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x["length"])


#: The rows of the query: every window is looked up in a table of all windows.
ORACLE = r"""
WITH words AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), places AS (
  SELECT rid, unnest(range(1, len(w) + 1)) AS i, w FROM words
), windows AS (
  SELECT rid, i, w[i] AS word, CASE WHEN i + 34 <= len(w) THEN md5(array_to_string(w[i:i + 34], ' ')) END AS h FROM places
), counted AS (
  SELECT h FROM windows WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1
), marked AS (
  SELECT rid, i, word, max(CASE WHEN c.h IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM windows LEFT JOIN counted c USING (h)
), kept AS (
  SELECT rid, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS text FROM marked GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM words LEFT JOIN kept k USING (rid)
"""
