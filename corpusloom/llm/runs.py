"""Periodic runs of words: stretches that repeat a shorter sequence of words three times or more.

An online sparse diagonal DP finds them. Word i matches an earlier word j on the diagonal of lag i - j; a diagonal's
match length grows by one with every word that goes on matching, and a diagonal that ends with sufficient length is a
run. All pairs of equal words would be quadratic where words are frequent, so a word matches only together with the
words behind it: for lags of at most 16 a window of 16 words, for those of at most 32 one of 32, and so on. A run of
period q has at least max(24 - q, 2 * q) matches, which is no less than that window, and inside of it the nearest
earlier occurrence of a window is q words back (a nearer one would, by the theorem of Fine and Wilf, give the run a
smaller period). So each word has at most one active lag for each window size, and a diagonal of nearest occurrences
has the run's smallest period of itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rule_stats import chunks, mixed, text_sizes, window_hashes, word_hashes

#: Words and periods that a run has at least.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words of the smallest window.
FIRST = 16

_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def active_lags(words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, lag, window) of the matches of all texts in a row, by place: a window of words at place that occurs lag
    words before in the same text, for the nearest such lag, where the lag is one that the window stands for.

    words are 64-bit hashes; owner is each word's text. Larger windows are looked at only where both halves repeat.
    """
    found, size, n = [], FIRST, len(words)
    at = np.flatnonzero(owner[: max(n - size + 1, 0)] == owner[size - 1 :])
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        h[at] = mixed(window_hashes(words, size)[at] + owner[at].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    while len(at):
        order = np.argsort(h[at], kind="stable")
        key, place = h[at][order], at[order]
        twin = np.flatnonzero(key[1:] == key[:-1])
        later, lag = place[twin + 1], place[twin + 1] - place[twin]
        fits = (lag <= size) & ((lag > size // 2) | (size == FIRST))
        found.append((later[fits], lag[fits], np.full(int(fits.sum()), size)))
        again = np.zeros(n, bool)
        again[later] = again[place[twin]] = True
        at = np.flatnonzero(again)
        at = at[at + 2 * size <= n]
        at = at[again[at + size] & (owner[at] == owner[at + 2 * size - 1])]
        with np.errstate(over="ignore"):
            h[at] = mixed(h[at] * np.uint64(0x9E3779B97F4A7C15) + h[at + size])
        size *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 3
    place, lag, window = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((lag, place))
    return place[order], lag[order], window[order]


def diagonals(place: np.ndarray, lag: np.ndarray, window: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of runs from matches by place. A diagonal that no match goes on with is done, and is
    emitted before the next word is looked at if it is long enough."""
    active: dict[int, list[int]] = {}

    def ended(p: int) -> Iterator[tuple[int, int, int]]:
        first, last, w = active.pop(p)
        length = last - first + w + p
        if length >= max(LEAST_WORDS, LEAST_PERIODS * p):
            yield first - p, length, p

    now = -1
    for i, p, w in zip(place.tolist(), lag.tolist(), window.tolist(), strict=True):
        if i != now:
            for q in [q for q, x in active.items() if x[1] < i - 1]:
                yield from ended(q)
            now = i
        if p in active:
            active[p][1] = i
        else:
            active[p] = [i, i, w]
    for q in list(active):
        yield from ended(q)


def text_runs(words: np.ndarray, counts: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each of several texts, by start and period; words are hashes of all words."""
    owner = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    out: list[list[tuple[int, int, int]]] = [[] for _ in counts]
    for start, length, period in diagonals(*active_lags(words, owner)):
        k = int(owner[start])
        out[k].append((start - int(ends[k] - counts[k]), length, period))
    for runs in out:
        runs.sort(key=lambda x: (x[0], x[2]))
    return out


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    kept = np.cumsum(edge[:-1]) == 0
    return [w for w, k in zip(words, kept.tolist(), strict=True) if k]


def collapse_runs(docs: DataFrame, *, key: str = "doc_id", text: str = "text", order: Callable[[object, int], np.ndarray | None] | None = None) -> DataFrame:
    """(key, runs, collapsed) of every row of docs: its periodic runs and its words, joined by one space, without the
    repeats, of which the first period of each run stays.

    runs is array<struct<start, length, period>> by start and period, in words from 0. Words are runs of characters
    other than space and tab to carriage return; a null or empty text has none, no runs and an empty collapsed text.
    order, if given, gets a row's key and number of words and may return the places of the words to read instead of
    0, 1, 2, ... Repeated rows and null keys are rows like others; an empty table gives an empty result; other columns
    are not read. Words are compared as 64-bit hashes. A text is worked on whole, whatever its length, in memory that
    grows linearly with it; there is no shuffle.
    """
    rows = docs.select(docs[key].alias("__key"), docs[text].cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_pylist() if order else None, batch.column(1)
            for a, b in chunks(text_sizes(texts)):
                part = texts.slice(a, b - a)
                h, counts = word_hashes(part, lower=False)
                split = [(t or "").encode().split() for t in part.to_pylist()]
                at = 0
                for k, n in enumerate(counts.tolist()):
                    places = order(keys[a + k], n) if order and n else None
                    if places is not None:
                        h[at : at + n] = h[at : at + n][places]
                        split[k] = [split[k][i] for i in places.tolist()]
                    at += n
                runs = text_runs(h, counts)
                kept = [b" ".join(without_repeats(w, r)).decode() for w, r in zip(split, runs, strict=True)]
                named = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(named, _RUNS), pa.array(kept, pa.string())], names=["__key", "runs", "collapsed"])

    kind = rows.schema["__key"].dataType.simpleString()
    return rows.mapInArrow(run, f"__key {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string").withColumnRenamed("__key", key)


def strongest(runs: Column) -> Column:
    """The run of the greatest length / period, compared exactly; of several the first, null if there is none."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, lambda best, x: F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best))


def listed(runs: Column) -> Column:
    """One line `start,length,period` for each run."""
    return F.array_join(F.transform(runs, lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","), x["period"].cast("string"), F.lit("\n"))), "")
