"""Quality rules with an isolation forest on their statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stash
from .rule_stats import STATS, document_stats

#: Score bins for the calibration: as many pairs of counts reach the driver at most.
BINS = 1000


#: What no text has more of for being long: symbols and digits of word characters, repeated lines, words in repeated
#: windows, capitals of letters, punctuation marks a word, words equal to the one before, and mean lengths.
SHARES = ("symbols", "repeated_lines", "repeats", "capitals", "digits", "punctuation", "adjacent", "word_length", "line_length")


def shares(stats: np.ndarray) -> np.ndarray:
    """The columns of SHARES for rows of STATS; the line length as a logarithm."""
    s = {n: stats[:, i].astype(float) for i, n in enumerate(STATS)}
    words, chars, lines = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1), np.maximum(s["n_lines"], 1)
    letters = np.maximum(s["n_upper"] + s["n_lower"], 1)
    return np.stack([s["n_symbols"] / chars, s["n_dup_lines"] / lines, s["n_repeat_words"] / words, s["n_upper"] / letters, s["n_digits"] / chars, s["n_punct"] / words, s["n_adjacent"] / words, chars / words, np.log1p(chars / lines)], axis=1)


def excesses(x: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """What shares exceed the usual ones by: texts without any differ in nothing that a split could isolate them by."""
    return np.maximum(x - usual, 0)


def _mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n points."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Complete binary trees in arrays: feature (-1 at a leaf), split value and path length of each node."""

    feature: np.ndarray
    split: np.ndarray
    path: np.ndarray
    norm: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 to the minus mean path length over its expectation: near 1 for points that few splits isolate."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, split, path in zip(self.feature, self.split, self.path, strict=True):
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f, 0)] >= split[at]
                at = np.where(inner, 2 * at + 1 + right, at)
            total += path[at]
        return 2.0 ** (-total / (len(self.path) * self.norm)) if self.norm > 0 else np.zeros(len(x))


def fit_forest(x: np.ndarray, *, trees: int = 128, points: int = 256, seed: int = 7) -> Forest:
    """Isolation trees over random parts of x, which do not overlap where x has rows enough: uniform splits of a
    feature drawn among those that vary."""
    rng = np.random.default_rng(seed)
    points = min(points, len(x))
    dealt = np.concatenate([rng.permutation(len(x)) for _ in range(-(-trees * points // len(x)))])
    depth = max(1, int(np.ceil(np.log2(max(points, 2)))))
    size = 2 ** (depth + 1) - 1
    feature, split, path = np.full((trees, size), -1), np.zeros((trees, size)), np.zeros((trees, size))
    for t in range(trees):
        todo = [(0, 0, x[dealt[t * points : (t + 1) * points]])]
        while todo:
            node, level, part = todo.pop()
            low, high = (part.min(0), part.max(0)) if len(part) else (np.zeros(x.shape[1]),) * 2
            varied = np.flatnonzero(high > low)
            if level == depth or len(varied) == 0:
                path[t, node] = level + _mean_path(len(part))
                continue
            f = rng.choice(varied)
            v = rng.uniform(low[f], high[f])
            feature[t, node], split[t, node] = f, v
            right = part[:, f] >= v
            todo += [(2 * node + 1, level + 1, part[~right]), (2 * node + 2, level + 1, part[right])]
    return Forest(feature, split, path, float(_mean_path(points)))


def choose_threshold(counts: list[tuple[int, int, int]], most_good: float) -> float:
    """The score bound with the best gain (share of bad rows above it less share of good rows) among those with at
    most most_good of the good rows above. counts: (bin, quality, rows). No bad rows: nothing is above it."""
    good, bad = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for b, quality, n in counts:
        (good if quality else bad)[b] += n
    if not bad.sum():
        return float("inf")
    g = good[::-1].cumsum()[::-1] / max(good.sum(), 1)
    gain = np.where(g <= most_good, bad[::-1].cumsum()[::-1] / bad.sum() - g, -1.0)
    # of equal gains the middle one: as far from good as from bad rows
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float("inf") if gain.max() <= 0 else best[len(best) // 2] / BINS


def _counts(judged: DataFrame, score: str) -> list[tuple[int, int, int]]:
    counts = judged.groupBy(F.floor(F.col(score) * BINS).cast("int").alias("b"), F.col("quality").cast("int").alias("q")).count().collect()
    return [(r["b"], r["q"], r["count"]) for r in counts]


def quality_rules(docs: DataFrame, labels: DataFrame | None, *, key: str = "doc_id", text: str = "text", trees: int = 128, points: int = 256, most_good: float = 0.003, usual: float = 0.999, slack: float = 0.5, seed: int = 7) -> DataFrame:
    """(key, STATS..., base_failed, score, raw_score, threshold, raw_threshold, kept) of every row of docs.

    base_failed: under 20 words, or over 30 of 100 words in repeated 8-word windows. kept: not base_failed and both
    anomaly scores below their thresholds. score is of a forest on what SHARES exceed the usual ones by (the `usual`
    quantile of the labelled good rows, of all rows where none is labelled, and slack times its distance from their
    median more); raw_score is of a forest on SHARES as
    they are, which tells apart texts that exceed nothing. Every tree has rows of its own, drawn from all rows that pass
    the base rules (trees x points rows of smallest key hash in all). The thresholds come from all labelled rows
    (labels: key, quality; 1 good, 0 bad; of repeated labels the lowest counts, null ones do not): the best gain with
    at most most_good of the good rows above; raw_threshold by the rows below the other, both together within
    most_good. Without labelled bad rows the base rules alone decide. A null text is empty and fails the base rules;
    repeated rows are judged alike; an empty table gives an empty result. Other columns of docs are not read.
    """
    stats = _with_shares(document_stats(docs, key=key, text=text), key)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    stats = stash(stats.withColumn("base_failed", failed), "rule-stats")
    passed = stats.filter("NOT base_failed")
    known = None
    if labels is not None:
        known = stash(labels.filter("quality IS NOT NULL").groupBy(F.col(key).alias("__k")).agg(F.min("quality").alias("quality")), "labels")
    picked = passed.orderBy(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), *STATS).limit(trees * points).select(*SHARES).collect()
    forests = limits = None
    if picked:
        rows = np.array([list(r) for r in picked], float)
        bounds = [F.percentile_approx(n, [0.5, usual], 100_000).alias(n) for n in SHARES]
        found = passed.join(known.filter("quality > 0"), F.col(key) == F.col("__k"), "left_semi").agg(*bounds).first() if known is not None else None
        middle, high = np.array(list(found if found is not None and found[0] is not None else passed.agg(*bounds).first()), float).T
        limits = high + slack * (high - middle)
        forests = [fit_forest(x, trees=trees, points=points, seed=seed) for x in (excesses(rows, limits), rows)]
    scored = stash(_scored(stats, forests, limits, key), "rule-scores")
    threshold = raw_threshold = float("inf")
    if known is not None:
        judged = scored.filter(~F.col("base_failed")).join(known, F.col(key) == F.col("__k"))
        counts = _counts(judged, "score")
        threshold = choose_threshold(counts, most_good)
        good, lost = (sum(n for b, q, n in counts if q and b >= least) for least in (0, threshold * BINS))
        raw_threshold = choose_threshold(_counts(judged.filter(F.col("score") < threshold), "raw_score"), (most_good * good - lost) / max(good - lost, 1))
    kept = ~F.col("base_failed") & (F.col("score") < threshold) & (F.col("raw_score") < raw_threshold)
    return scored.withColumn("threshold", F.lit(threshold)).withColumn("raw_threshold", F.lit(raw_threshold)).withColumn("kept", kept)


def _with_shares(stats: DataFrame, key: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = shares(np.stack([batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(len(STATS))], axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x[:, i]) for i in range(len(SHARES)))], names=["__key", *STATS, *SHARES])

    kind = stats.schema[key].dataType.simpleString()
    schema = f"__key {kind}, " + ", ".join([*(f"{n} long" for n in STATS), *(f"{n} double" for n in SHARES)])
    return stats.select(F.col(key).alias("__key"), *STATS).mapInArrow(run, schema).withColumnRenamed("__key", key)


def _scored(stats: DataFrame, forests: list[Forest] | None, limits: np.ndarray | None, key: str) -> DataFrame:
    names, first = [key, *STATS, "base_failed"], len(STATS) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(first + i).to_numpy(zero_copy_only=False) for i in range(len(SHARES))], axis=1)
            score, raw = (forests[0].scores(excesses(x, limits)), forests[1].scores(x)) if forests else (np.zeros(len(x)), np.zeros(len(x)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:first], pa.array(score), pa.array(raw)], names=["__key", *names[1:], "score", "raw_score"])

    kind = stats.schema[key].dataType.simpleString()
    schema = f"__key {kind}, " + ", ".join(f"{n} long" for n in STATS) + ", base_failed boolean, score double, raw_score double"
    return stats.select(F.col(key).alias("__key"), *names[1:], *SHARES).mapInArrow(run, schema).withColumnRenamed("__key", key)


def keep_quality(docs: DataFrame, labels: DataFrame | None, *, key: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that quality_rules keeps, with the columns of docs."""
    good = quality_rules(docs, labels, key=key, **options).filter("kept").select(F.col(key).alias("__good")).distinct()
    return docs.join(good, F.col(key).eqNullSafe(F.col("__good")), "left_semi")
