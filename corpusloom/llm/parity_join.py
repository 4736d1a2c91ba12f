"""Joining documents whose shingle sets have a Jaccard similarity of 0.75 or more, by parity sketches.

A set's sketch has m words. Every shingle is XORed into one of them, so that sets that differ in d shingles differ
in at most d words: the words' Hamming distance bounds the symmetric difference from below. Similar sets of n
shingles differ in at most t = (1 - J) / (1 + J) * (n + n / J) of them. By the pigeonhole principle they agree in a
non-empty word, and more precisely: with the words of a sketch in an order that is the same for all documents, one
of the first t + 1 of either is a word that both have. These words are the join's keys.

m depends on the size band (powers of two) so that a set has over t non-empty words; a set joins in its own band, and
also in the band below if partners there can be similar. Words whose shingles are all frequent come last in the
order, so that passages which many documents share make keys only for documents that consist of little else.
A second sketch of SKETCH parity bits sorts out most pairs; the rest are verified on the shingles themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stash
from .common import components, give_back, lookup
from .rule_stats import chunks, mixed, text_sizes, window_hashes, word_hashes

SHINGLE = 5
#: Parity bits of the sketch for pairs.
SKETCH = 1024
#: Documents with a key up to which all pairs are listed, and with which a shingle counts as frequent.
FEW = 16
#: Frequent shingles that are sent to all tasks at most (the most frequent ones); others are ordered as rare ones.
FREQUENT = 1 << 20
#: Entries that a task gathers before it hands them on by range of keys, and rows of a chunk of a frequent key.
FLUSH, CHUNK = 1 << 20, 1024
_HALF = np.uint64(1 << 63)


def shingle_sets(texts: pa.Array | Sequence[str | None]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word 5-grams of each text, A-Z in lower case.

    A text of one to four words has one shingle, all its words; a text without words (or a null one) has none.
    """
    words, counts = word_hashes(texts)
    grams, out, at = window_hashes(words, SHINGLE) ^ np.uint64(SHINGLE), [], 0
    for n in counts.tolist():
        if n >= SHINGLE:
            s = np.sort(grams[at : at + n - SHINGLE + 1])
            new = np.empty(len(s), bool)
            new[0], new[1:] = True, s[1:] != s[:-1]
            out.append(s[new])
        else:
            out.append(window_hashes(words[at : at + n], n) ^ np.uint64(n) if n else np.zeros(0, np.uint64))
        at += n
    return out


def bit_sketch(s: np.ndarray) -> list[int]:
    """SKETCH parity bits as 64-bit integers."""
    bits = np.bincount((s & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()


def most_different(a: int, b: int, percent: int) -> int:
    """The greatest symmetric difference of similar sets of a and b shingles."""
    return (100 - percent) * (a + b) // (100 + percent)


def schemes(n: int, percent: int) -> list[tuple[int, int, int]]:
    """(band, words of the sketch, greatest difference) for each band in which a set of n shingles joins.

    Bands start at powers of two. Bands of small sets have a word for every shingle. A greatest difference of 0
    leaves only equal sets, which need no join.
    """
    if not n:
        return []
    k = n.bit_length() - 1
    words = lambda k: 1 << 30 if k < 6 else 2 << k
    out = [(k, words(k), most_different(n, 100 * n // percent, percent))]
    below = (1 << k) - 1
    if k and percent * n <= 100 * below:
        out.append((k - 1, words(k - 1), most_different(n, below, percent)))
    return [x for x in out if x[2] > 0]


def join_keys(sets: list[np.ndarray], frequent: np.ndarray, bits: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all sets and the bands in which they join, the first words of their sketches as 64-bit keys, and the place
    of each key's set. As many keys as the greatest difference and one more; words with rare shingles come first."""
    jobs = [(i, *x) for i, s in enumerate(sets) for x in schemes(len(s), percent)]
    if not jobs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner, band, words, most = (np.array(x, np.uint64) for x in zip(*jobs, strict=True))
    s = np.concatenate([sets[j[0]] for j in jobs])
    job = np.repeat(np.arange(len(jobs), dtype=np.uint64), [len(sets[j[0]]) for j in jobs])
    with np.errstate(over="ignore"):
        seed = (band * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        at = mixed(s + seed[job]) & (words - np.uint64(1))[job] | job << np.uint64(30)
        order = np.argsort(at)
        at, s = at[order], s[order]
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        parity, low = np.bitwise_xor.reduceat(s, starts), np.minimum.reduceat(_ranks(s, frequent, bits), starts)
        at, job = at[starts] & np.uint64((1 << 30) - 1), at[starts] >> np.uint64(30)
        keys = mixed(parity + (at * np.uint64(64) + band[job]) * np.uint64(0xD1342543DE82EF95))
    # the rank goes before the key, of which 62 bits are left
    keys = low.astype(np.uint64) << np.uint64(62) | keys >> np.uint64(2)
    ends = np.searchsorted(job, np.arange(len(jobs) + 1, dtype=np.uint64)).tolist()
    out = [np.partition(keys[x:y], m)[: m + 1] if y - x > m + 1 else keys[x:y] for x, y, m in zip(ends[:-1], ends[1:], most.tolist(), strict=True)]
    return np.concatenate(out) << np.uint64(2), np.repeat(owner.astype(np.int64), [len(k) for k in out])


def _long_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(docs[key].cast("long").alias("id"), docs[text].cast("string").alias("text"))


def _flush(keys: list[np.ndarray], ids: list[np.ndarray] | None, shift: int) -> Iterator[tuple]:
    """Entries sorted and cut by their leading bits: (range, low and middle bits of keys, ids in two halves).

    Without ids equal keys are one entry; those with several rows have their numbers in the place of the ids."""
    k = np.concatenate(keys)
    if ids is None:
        k = np.sort(k)
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        n = np.diff(np.append(starts, len(k)))
        k = k[starts]
        yield from _cut(k[n == 1], None, shift)
        yield from _cut(k[n > 1], n[n > 1], shift)
    else:
        order = np.argsort(k)
        yield from _cut(k[order], np.concatenate(ids)[order], shift)


def _cut(k: np.ndarray, i: np.ndarray | None, shift: int) -> Iterator[tuple]:
    if not len(k):
        return
    top = k >> np.uint64(shift)
    starts = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]]))
    for a, b in zip(starts, [*starts[1:], len(k)], strict=True):
        part = k[a:b]
        low, mid = part.astype(np.uint32).tobytes(), (part >> np.uint64(32)).astype(np.uint16).tobytes()
        if i is None:
            yield int(top[a]), low, mid, b"", b""
        else:
            yield int(top[a]), low, mid, i[a:b].astype(np.uint32).tobytes(), (i[a:b] >> 32).astype(np.uint32).tobytes()


def _unpack(p: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    k = np.frombuffer(b"".join(p["low"]), np.uint32).astype(np.uint64) | np.frombuffer(b"".join(p["mid"]), np.uint16).astype(np.uint64) << np.uint64(32)
    i = np.frombuffer(b"".join(p["id_low"]), np.uint32).astype(np.int64) | np.frombuffer(b"".join(p["id_high"]), np.uint32).astype(np.int64) << 32
    return k, i


_PACKED = "range int, low binary, mid binary, id_low binary, id_high binary"
_SUMMARY = "id long, n long, digest binary, sketch array<long>, " + _PACKED


def _batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(schema)], names=[n for n, _ in schema])


_PACKED_TYPES = [("range", pa.int32()), ("low", pa.binary()), ("mid", pa.binary()), ("id_low", pa.binary()), ("id_high", pa.binary())]
_SUMMARY_TYPES = [("id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("sketch", pa.list_(pa.int64())), *_PACKED_TYPES]


def _summaries(rows: DataFrame, bits: int) -> DataFrame:
    """Of each document its size, digest and bit sketch; and, packed by range, the shingle hashes of the lower half
    of all, from which frequent ones are found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back(memos=True)
        seen: set[bytes] = set()
        held: list[np.ndarray] = []
        n = 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in chunks(text_sizes(texts)):
                out = []
                for i, s in zip(ids[a:b], shingle_sets(texts.slice(a, b - a)), strict=True):
                    digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                    out.append((i, len(s), digest, bit_sketch(s) if len(s) else None, None, None, None, None, None))
                    if digest and digest not in seen:
                        seen.add(digest)
                        held.append(s[s < _HALF] << np.uint64(1))
                        n += len(held[-1])
                yield _batch(out, _SUMMARY_TYPES)
                if n > FLUSH:
                    yield _batch([(None,) * 4 + r for r in _flush(held, None, 64 - bits)], _SUMMARY_TYPES)
                    held, n = [], 0
                if len(seen) > 1 << 20:
                    seen.clear()
        if n:
            yield _batch([(None,) * 4 + r for r in _flush(held, None, 64 - bits)], _SUMMARY_TYPES)
        held.clear()
        give_back()

    return rows.mapInArrow(run, _SUMMARY)


def _frequent(packed: DataFrame, bits: int) -> np.ndarray:
    """48 and `bits` leading bits of the frequent shingles, sorted; FREQUENT at most, the most frequent ones.

    Ties at the limit stay out, so that the choice depends on the corpus alone. It orders words; it drops nothing.
    """

    def count(p: pd.DataFrame) -> pd.DataFrame:
        k = np.frombuffer(b"".join(p["low"]), np.uint32).astype(np.uint64) | np.frombuffer(b"".join(p["mid"]), np.uint16).astype(np.uint64) << np.uint64(32)
        n = np.concatenate([np.frombuffer(c, np.uint32) if c else np.ones(len(x) // 4, np.uint32) for c, x in zip(p["id_low"], p["low"], strict=True)]).astype(np.int64)
        order = np.argsort(k)
        k = k[order]
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        n = np.add.reduceat(n[order], starts)
        often = n > FEW
        return pd.DataFrame({"range": p["range"].iloc[0], "k": k[starts][often].astype(np.int64), "n": n[often]})

    found = stash(packed.groupBy("range").applyInPandas(count, "range int, k long, n long"), "frequent")
    sizes = found.groupBy(F.least("n", F.lit(100_000)).alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("n")).collect()
    total, least = 0, 1 << 60
    for r in sizes:
        total += r["c"]
        if total > FREQUENT:
            break
        least = r["n"]
    rows = found.filter(F.col("n") >= least).select("range", "k").toPandas()
    return np.sort(_packed_name(rows["range"].to_numpy(np.uint64), rows["k"].to_numpy(np.uint64), bits))


def _packed_name(top: np.ndarray, low: np.ndarray, bits: int) -> np.ndarray:
    """A key's leading 16 bits (as far as its range tells them) before its 48 others."""
    return (top >> np.uint64(max(0, bits - 16)) << np.uint64(48)) | low


def _ranks(s: np.ndarray, frequent: np.ndarray, bits: int) -> np.ndarray:
    """0 for rare shingles, 1 for unknown and 2 for frequent ones."""
    rank = (s >= _HALF).astype(np.int8)
    if len(frequent):
        at = np.flatnonzero(rank == 0)
        d = s[at] << np.uint64(1)
        name = _packed_name(d >> np.uint64(64 - bits), d & np.uint64((1 << 48) - 1), bits)
        place = np.minimum(np.searchsorted(frequent, name), len(frequent) - 1)
        rank[at[frequent[place] == name]] = 2
    return rank


def _keys(rows: DataFrame, frequent: np.ndarray, bits: int, percent: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        n = 0
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            for a, b in chunks(text_sizes(texts)):
                found, owner = join_keys(shingle_sets(texts.slice(a, b - a)), shared.value, bits, percent)
                keys.append(found)
                owners.append(ids[a:b][owner])
                n += len(found)
                if n > FLUSH:
                    yield _batch(list(_flush(keys, owners, 64 - bits)), _PACKED_TYPES)
                    keys, owners, n = [], [], 0
        if n:
            yield _batch(list(_flush(keys, owners, 64 - bits)), _PACKED_TYPES)
        keys.clear()
        owners.clear()
        give_back()

    return rows.mapInArrow(run, _PACKED)


def _range_candidates(p: pd.DataFrame, bits: int) -> pd.DataFrame:
    out = _candidates(p, bits)
    give_back()
    return out


def _candidates(p: pd.DataFrame, bits: int) -> pd.DataFrame:
    """Pairs (a, b) of documents with a common key: all of keys with up to FEW documents, those with the smallest
    document of other keys. The latter's documents also come as rows with the key in g."""
    k, i = _unpack(p)
    order = np.lexsort((i, k))
    k, i = k[order], i[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (i[1:] != i[:-1])])
    k, i = k[new], i[new]
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    sizes = np.diff(np.append(starts, len(k)))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in range(2, FEW + 1):
        at = starts[sizes == n]
        if len(at):
            group = i[at[:, None] + np.arange(n)[None]]
            x, y = np.triu_indices(n, 1)
            left.append(group[:, x].reshape(-1))
            right.append(group[:, y].reshape(-1))
    many = np.flatnonzero(sizes > FEW)
    member = np.concatenate([np.arange(starts[g], starts[g] + sizes[g]) for g in many]) if len(many) else np.zeros(0, int)
    pivot = np.repeat(i[starts[many]], sizes[many])
    own = i[member]
    left.append(pivot[own != pivot])
    right.append(own[own != pivot])
    pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], axis=1), axis=0)
    g = (_packed_name(np.full(len(member), p["range"].iloc[0], np.uint64), k[member], bits) >> np.uint64(1)).astype(np.int64)
    return pd.DataFrame({
        "a": np.concatenate([pairs[:, 0], pivot]), "b": np.concatenate([pairs[:, 1], own]),
        "g": pd.array([None] * len(pairs) + g.tolist(), "Int64"), "size": np.concatenate([np.zeros(len(pairs), np.int64), np.repeat(sizes[many], sizes[many])]),
    })


def _close(points: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs that sizes and bit sketches do not rule out."""
    side = lambda x: points.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    j = pairs.join(side("a"), "a").join(side("b"), "b")
    apart = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    sizes = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (F.lit(100 + percent) * apart <= F.lit(100 - percent) * (F.col("na") + F.col("nb")))
    return j.filter(sizes).select("a", "b").distinct()


def _verified(rows: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are similar. Only sets of documents in pairs are made and moved, once for each side."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    needed = rows.join(ids, "id", "left_semi")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in chunks(text_sizes(batch.column(1))):
                part = batch.slice(x, y - x)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingle_sets(part.column(1))], pa.binary())], names=["id", "s"])
        give_back()

    sets = stash(needed.mapInArrow(make, "id long, s binary"), "pair-sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])
        give_back()

    return both.select("a", "b", "sa", "sb").mapInArrow(verify, "a long, b long").distinct()


def _labelled(df: DataFrame, comp: DataFrame, col: str, out: str) -> DataFrame:
    c = comp.select(F.col("node").alias("__n"), F.col("component").alias("__c"))
    return df.join(c, F.col(col) == F.col("__n"), "left").withColumn(out, F.coalesce("__c", col)).drop("__n", "__c")


def _frequent_key_pairs(points: DataFrame, frequent: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Pairs of a frequent key that are not connected yet and that sketches do not rule out.

    Documents connected with the key's smallest one need no more links among themselves. Every other one meets all
    documents of the key, in chunks; a task compares two chunks and returns what is left.
    """
    rows = stash(_labelled(_labelled(frequent, comp, "a", "ca"), comp, "b", "cb"), "frequent-keys")
    open_keys = rows.filter("ca != cb").select("g").distinct()
    rows = rows.join(open_keys, "g", "left_semi").join(points.select(F.col("id").alias("b"), "n", "sketch"), "b")
    rows = stash(rows.withColumn("chunks", F.ceil(F.col("size") / CHUNK).cast("int")), "frequent-open")
    own, spread = F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    cols = ["g", "x", "y", "left", "b", "n", "sketch", "cb"]
    left = rows.filter("ca != cb").withColumn("x", own).withColumn("y", spread).withColumn("left", F.lit(True)).select(cols)
    right = rows.withColumn("y", own).withColumn("x", spread).withColumn("left", F.lit(False)).select(cols)

    def meet(p: pd.DataFrame) -> pd.DataFrame:
        u, v = p[p["left"].to_numpy(bool)], p[~p["left"].to_numpy(bool)]
        out = []
        if len(u) and len(v):
            # the greatest difference allowed grows with the sizes, so partners of like size are neighbours
            v = v.sort_values("n", kind="stable")
            su, sv = (np.array(x["sketch"].tolist(), np.int64).view(np.uint64) for x in (u, v))
            nv, cv, iv = v["n"].to_numpy(), v["cb"].to_numpy(), v["b"].to_numpy()
            head = np.ascontiguousarray(sv[:, :4])
            low, high = np.searchsorted(nv, -(-percent * u["n"].to_numpy() // 100)), np.searchsorted(nv, 100 * u["n"].to_numpy() // percent, "right")
            for s, n, c, i, x, y in zip(su, u["n"].tolist(), u["cb"].tolist(), u["b"].tolist(), low.tolist(), high.tolist(), strict=True):
                most = (100 - percent) * (nv[x:y] + n) // (100 + percent)
                # a quarter of the sketch rules most pairs out
                at = np.flatnonzero((np.bitwise_count(head[x:y] ^ s[:4]).sum(1, dtype=np.int64) <= most) & (cv[x:y] != c))
                at = at[np.bitwise_count(sv[x + at] ^ s).sum(1, dtype=np.int64) <= most[at]]
                out += [(min(i, j), max(i, j)) for j in iv[x + at].tolist()]
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return left.unionByName(right).groupBy("g", "x", "y").applyInPandas(meet, "a long, b long").distinct()


def _connect(rows: DataFrame, points: DataFrame, pairs: DataFrame, edges: DataFrame | None, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """Verifies pairs and returns (edges, components). First each document's pair with its smallest partner; pairs
    that these connect need no check."""
    pairs = stash(_close(points, pairs, percent), "close-pairs")
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    for step in ("first", "rest"):
        if step == "rest":
            comp = stash(components(edges), "components")
            apart = _labelled(_labelled(pairs, comp, "a", "ca"), comp, "b", "cb").filter("ca != cb").select("a", "b")
            first = stash(apart.join(first, ["a", "b"], "left_anti"), "pairs-left")
            if first.isEmpty():
                return edges, comp
        links = stash(_verified(rows, stash(first, "pairs"), percent), "links")
        edges = links if edges is None else edges.unionByName(links)
    return edges, stash(components(edges), "components")


def similar_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """(key, n_shingles, component_id) of every row: documents link when 100 * intersection >= percent * union.

    component_id is the smallest key that a document's links reach. Keys are integers; rows that repeat a key are
    one document with several texts and share a component. Rows with a null key link with nothing and have a null
    component_id. Texts without words, and null ones, have no shingles and link with nothing. Documents of equal
    sets are one point of the join. An empty table gives an empty result; other columns are not read.
    Shingles are compared as 64-bit hashes. percent must be at least 50.
    """
    rows = _long_rows(docs, key, text)
    # ranges of keys: about a million entries each, up to some 10 ** 13 in all
    bits = max(5, min(24, (docs.count() // 4000).bit_length()))
    told = stash(_summaries(rows, bits), "summaries")
    each = told.filter("range IS NULL").select("id", "n", "digest", "sketch")
    points = each.filter("id IS NOT NULL AND digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    points = stash(points, "points")
    frequent = _frequent(told.filter("range IS NOT NULL").select("range", "low", "mid", "id_low", "id_high"), bits)
    texts = rows.join(points.select("id").distinct().hint("shuffle_hash"), "id", "left_semi")
    found = stash(_keys(texts, frequent, bits, percent).groupBy("range").applyInPandas(lambda p: _range_candidates(p, bits), "a long, b long, g long, size long"), "candidates")
    edges, comp = _connect(rows, points, found.filter("g IS NULL").select("a", "b").distinct(), None, percent)
    many = found.filter("g IS NOT NULL")
    if not many.isEmpty():
        more = stash(_frequent_key_pairs(points, many, comp, percent), "frequent-pairs")
        if not more.isEmpty():
            edges, comp = _connect(rows, points, more, edges, percent)
    # keys of equal texts and texts of equal keys are linked through the points
    same = each.filter("id IS NOT NULL AND digest IS NOT NULL").groupBy("digest", "id").agg(F.first("n").alias("n"))
    result = stash(_labelled(points.select("digest", "id"), comp, "id", "component"), "point-components").select("digest", "component")
    met = lookup(stash(same, "documents").withColumn("d", F.hex("digest")), result.withColumn("d", F.hex("digest")).drop("digest"), "d", "d", ["component"])
    # a repeated key with several texts joins their components
    multi = met.groupBy("id").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    joined = multi.filter("low != high").select("id")
    per_id = multi.select("id", F.col("low").alias("component"))
    if not joined.isEmpty():
        extra = components(met.join(joined, "id", "left_semi").select(F.col("component").alias("a"), F.col("id").alias("b")))
        per_id = _labelled(per_id, stash(extra, "joined"), "component", "c2").select("id", F.col("c2").alias("component"))
    out = each.select("id", "n").join(per_id.withColumnRenamed("id", "__id"), F.col("id") == F.col("__id"), "left")
    return out.select(F.col("id").cast(docs.schema[key].dataType).alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "id").cast(docs.schema[key].dataType).alias("component_id"))


def keep_first(docs: DataFrame, *, key: str = "doc_id", **options) -> DataFrame:
    """One row of each component, that of the smallest key, with the columns of docs; rows with a null key all stay.
    Of rows that repeat the key one stays: the one of the smallest hash of all its columns."""
    out = similar_documents(docs, key=key, **options)
    first = out.filter(F.col(key) == F.col("component_id")).select(F.col(key).alias("__first")).distinct()
    kept = docs.join(first, F.col(key) == F.col("__first"), "left_semi")
    repeated = kept.groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("__k")
    once = kept.join(repeated, F.col(key) == F.col("__k"), "left_anti")
    again = kept.join(repeated, F.col(key) == F.col("__k"), "left_semi").groupBy(key).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))).alias("__row"))
    again = again.select("__row.*")
    return once.unionByName(again).unionByName(docs.filter(F.col(key).isNull()))
