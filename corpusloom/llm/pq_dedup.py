"""Near-duplicate embeddings by product quantisation: inverted lists, residual codes, exact rerank.

The index only rules pairs out by bounds that hold for every vector, so recall does not depend on how well the
sample that it was fitted to stands for the rest:

* two unit vectors of cosine c are d = sqrt(2 - 2c) apart. A list can hold a neighbour of x only if x is at most d
  from the half space of the points nearer to that list's centroid than to x's own;
* a code stands for a point at a known distance e from its vector, so a neighbour's code is at most d + e from x.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stash
from .common import components, lookup

#: Rows of a query chunk and of a list chunk that meet in one group.
CHUNK = 1024
#: Parts that a residual is cut into, and codewords of each part.
PARTS, WORDS = 8, 256
_SLACK = 1e-5


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        # an empty centroid moves to a random point
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.choice(len(x), len(c))])
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all x to all c."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None], 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return distances(x, c).argmin(1)


@dataclass
class Index:
    centroids: np.ndarray
    books: list[np.ndarray]
    cuts: list[tuple[int, int]]

    @classmethod
    def fit(cls, x: np.ndarray, lists: int) -> Index:
        c = k_means(x, lists)
        r = x - c[nearest(x, c)]
        edges = np.linspace(0, x.shape[1], min(PARTS, x.shape[1]) + 1).astype(int)
        cuts = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        return cls(c, [k_means(r[:, a:b], WORDS) for a, b in cuts], cuts)

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, residual codes and distance from vector to code of each row."""
        own = nearest(x, self.centroids)
        r = x - self.centroids[own]
        codes = np.stack([nearest(r[:, a:b], book) for (a, b), book in zip(self.cuts, self.books, strict=True)], axis=1).astype(np.uint8)
        error = sum(((r[:, a:b] - book[codes[:, i]]) ** 2).sum(1) for i, ((a, b), book) in enumerate(zip(self.cuts, self.books, strict=True)))
        return own, codes, np.sqrt(error)

    def probes(self, x: np.ndarray, own: np.ndarray, reach: float) -> list[np.ndarray]:
        """Lists after the own one that can hold a vector within reach."""
        d = distances(x, self.centroids)
        apart = np.sqrt(distances(self.centroids, self.centroids))[own]
        mine = d[np.arange(len(x)), own][:, None]
        ok = d - mine <= 2 * apart * (reach + _SLACK) + _SLACK
        ok &= np.arange(len(self.centroids))[None] > own[:, None]
        return [np.flatnonzero(row) for row in ok]

    def table_distances(self, q: np.ndarray, codes: np.ndarray, at: int) -> np.ndarray:
        """Distances of all queries to all codes of list `at`: sums of one table entry for each part."""
        r = q - self.centroids[at]
        out = np.zeros((len(q), len(codes)), np.float32)
        for i, ((a, b), book) in enumerate(zip(self.cuts, self.books, strict=True)):
            out += distances(r[:, a:b], book).astype(np.float32)[:, codes[:, i]]
        return np.sqrt(out)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled by their largest component first, so that squares stay in range."""
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches over the links a-b."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def near_duplicates(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.93, sample: int = 16384, lists: int | None = None) -> DataFrame:
    """(key, n_links, component_id, kept) of every row: links join vectors of equal label and cosine >= least.

    n_links counts the other rows linked directly, component_id is the smallest key reachable, kept says whether it
    is the row's own. Rows with a null label, and vectors that are null, zero or empty or hold null or non-finite
    components, link with nothing, nor do vectors of different lengths. Equal vectors are one point of the index
    with their number as weight; repeated rows count as rows of their own, and rows that repeat a key with another
    vector or label have links and a component of their own. A null key is never a component's smallest; a component
    of null keys has a null component_id, which counts as kept. An empty table gives an empty result.

    The index is fitted to at most sample vectors (smallest hash); every vector is indexed, and all bounds used are
    exact, so that no link is lost. Lists are about half the square root of the vectors in number, 4096 at most.
    Queries and members of a list meet in chunks; a chunk pair returns link counts and a spanning star of its
    linked vectors, not its pairs.
    """
    v = F.col(vector)
    double = isinstance(vectors.schema[vector].dataType.elementType, T.DoubleType)
    dims = F.size(v)
    sound = F.col(label).isNotNull() & v.isNotNull() & (dims > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    group = F.concat_ws(":", F.col(label).cast("string"), dims.cast("string"), F.hex(F.xxhash64(F.lit(1), v)), F.hex(F.xxhash64(F.lit(2), v)))
    rows = vectors.select(F.col(key).alias("key"), F.when(F.coalesce(sound, F.lit(False)), group).alias("g"), F.when(F.coalesce(sound, F.lit(False)), v).alias("v"), F.col(label).cast("string").alias("label"))
    members = stash(rows.select("key", "g"), "vectors")
    points = rows.filter("g IS NOT NULL").groupBy("g").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("m"), F.first("v").alias("v"), F.first("label").alias("label"))
    # points have numbers of their own, as keys may be null or stand for several vectors
    points = stash(points.withColumn("label", F.concat_ws(":", "label", F.size("v").cast("string"))).withColumn("id", F.monotonically_increasing_id()), "points")
    info = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    none = members.select(F.col("key"), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"), F.lit(True).alias("kept"))
    if not info["n"]:
        return none.withColumnRenamed("key", key)
    width = info["d"]
    drawn = points.orderBy(F.xxhash64("g"), "g").limit(sample).select("v").collect()
    x = np.zeros((len(drawn), width))
    for i, r in enumerate(drawn):
        x[i, : len(r["v"])] = r["v"]
    lists = lists or min(4096, max(8, 2 ** round(math.log2(max(1.0, math.sqrt(info["n"]) / 2)))))
    index = Index.fit(unit(x), lists)
    reach, dtype = math.sqrt(2 - 2 * least), "<f8" if double else "<f4"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 2048):
                batch = whole.slice(a, 2048)
                raw = np.zeros((batch.num_rows, width), dtype)
                for i, item in enumerate(batch.column(2).to_pylist()):
                    raw[i, : len(item)] = item
                u = unit(raw.astype(float))
                own, codes, error = index.code(u)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), batch.column(1), batch.column(3), pa.array([r.tobytes() for r in raw], pa.binary()), pa.array(own.astype(np.int32)),
                    pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(index.probes(u, own, reach), pa.list_(pa.int32())),
                ], names=["id", "m", "label", "v", "list", "codes", "error", "probes"])

    schema = "id long, m long, label string, v binary, list int, codes binary, error double, probes array<int>"
    indexed = stash(points.select("id", "m", "v", "label").mapInArrow(assign, schema), "indexed")
    asked = indexed.select("id", "m", "label", "v", F.col("list").alias("home"), F.explode(F.concat(F.array("list"), "probes")).alias("list"))
    # numbers of chunks of each list's members and of the queries that probe it
    many = lambda df, c: df.groupBy("label", "list").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias(c))
    grid = stash(many(indexed, "nd").join(many(asked.select("label", "list"), "nq"), ["label", "list"]), "grid")
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    d = indexed.select("label", "list", "id", "m", "v", "codes", "error", F.lit(None).cast("int").alias("home"))
    d = d.join(grid, ["label", "list"]).withColumn("dc", place("nd")).withColumn("qc", spread("nq")).withColumn("query", F.lit(False))
    q = asked.join(grid, ["label", "list"]).withColumn("qc", place("nq")).withColumn("dc", spread("nd")).withColumn("query", F.lit(True))
    q = q.withColumn("codes", F.lit(None).cast("binary")).withColumn("error", F.lit(None).cast("double"))
    cols = ["label", "list", "qc", "dc", "query", "id", "m", "v", "codes", "error", "home"]

    def search(p: pd.DataFrame) -> pd.DataFrame:
        return _search(p, index, dtype, least, reach)

    found = d.select(cols).unionByName(q.select(cols)).groupBy("label", "list", "qc", "dc").applyInPandas(search, "a long, b long, n long")
    found = stash(found, "links")
    counts = found.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    comp = components(found.filter("a != b").select("a", "b"))
    result = points.select("g", "id", "key", "m").join(counts, "id", "left").join(comp, F.col("id") == F.col("node"), "left")
    result = stash(result.select("g", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("c"), "key"), "point-results")
    # a component goes by its smallest key
    least_key = result.groupBy("c").agg(F.min("key").alias("component_id"))
    result = stash(lookup(result.select("g", "n_links", "c"), least_key, "c", "c", ["component_id"]).select("g", "n_links", "component_id"), "point-components")
    out = lookup(members, result, "g", "g", ["n_links", "component_id"])
    comp_id = F.when(F.col("g").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), F.col("key").eqNullSafe(comp_id).alias("kept"))


def _search(p: pd.DataFrame, index: Index, dtype: str, least: float, reach: float) -> pd.DataFrame:
    """Rows (a, b, n): a has n linked rows in this chunk pair and reaches b."""
    q, d = p[p["query"].to_numpy(bool)], p[~p["query"].to_numpy(bool)]
    empty = pd.DataFrame({"a": p["id"][:0], "b": p["id"][:0], "n": np.zeros(0, np.int64)})
    if not len(q) or not len(d):
        return empty
    xq, xd = (np.frombuffer(b"".join(s["v"]), dtype).reshape(len(s), -1).astype(float) for s in (q, d))
    uq, ud = unit(xq), unit(xd)
    at = int(p["list"].iloc[0])
    codes = np.frombuffer(b"".join(d["codes"]), np.uint8).reshape(len(d), -1)
    ok = index.table_distances(uq, codes, at) <= reach + d["error"].to_numpy(float)[None] + _SLACK
    # members ask their own list too; each pair of them is taken once
    iq, idd = q["id"].to_numpy(), d["id"].to_numpy()
    ok &= (q["home"].to_numpy() != at)[:, None] | (iq[:, None] < idd[None])
    a, b = np.nonzero(ok)
    links_a, links_b = [], []
    for s in range(0, len(a), 1 << 16):
        x, y = a[s : s + (1 << 16)], b[s : s + (1 << 16)]
        true = (uq[x] * ud[y]).sum(1) >= least
        links_a.append(x[true])
        links_b.append(y[true])
    a, b = np.concatenate([*links_a, np.zeros(0, int)]), np.concatenate([*links_b, np.zeros(0, int)])
    if not len(a):
        return empty
    ids, place = np.unique(np.concatenate([iq, idd]), return_inverse=True)
    pa_, pb = place[: len(iq)][a], place[len(iq) :][b]
    n = np.bincount(pa_, weights=d["m"].to_numpy()[b], minlength=len(ids)) + np.bincount(pb, weights=q["m"].to_numpy()[a], minlength=len(ids))
    low = spanning(len(ids), pa_, pb)
    hit = np.flatnonzero(n)
    return pd.DataFrame({"a": ids[hit], "b": ids[low[hit]], "n": n[hit].astype(np.int64)})


ORACLE = """
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, * FROM embeddings),
v AS (SELECT r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM w
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT r, vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
p AS (SELECT a.r AS a, b.r AS b FROM n a JOIN n b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
c AS (SELECT r AS node, r AS reach FROM w UNION SELECT c.node, p.b FROM c JOIN p ON c.reach = p.a),
m AS (SELECT node, min(vec_id) AS component_id FROM c JOIN w ON w.r = c.reach GROUP BY node),
k AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT w.vec_id, CAST(coalesce(k.n_links, 0) AS BIGINT) AS n_links, m.component_id, w.vec_id IS NOT DISTINCT FROM m.component_id AS kept
FROM w JOIN m ON m.node = w.r LEFT JOIN k ON k.a = w.r
"""
