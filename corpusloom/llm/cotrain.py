"""A quality classifier from two views that teach each other: what a text says and what is known of its page."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stash
from .common import give_back
from .isolation import BINS, choose_threshold
from .rule_stats import STATS, chunks, text_sizes, text_stats

#: Buckets for words, sources and languages.
WORDS, SOURCES, LANGS = 256, 64, 16


def text_view(texts: Sequence[str | None]) -> np.ndarray:
    """Shares of characters, lines and words, and shares of hashed lower-case words."""
    s = text_stats(texts).astype(float)
    c = {n: s[:, i] for i, n in enumerate(STATS)}
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    letters = np.maximum(c["n_upper"] + c["n_lower"], 1)
    shares = [c["n_symbols"] / chars, c["n_dup_lines"] / np.maximum(c["n_lines"], 1), c["n_repeat_words"] / words, np.maximum(c["n_upper"] / letters - 0.2, 0), c["n_digits"] / chars, np.minimum(c["n_punct"] / words, 2), c["n_adjacent"] / words]
    # square roots bring small shares apart from none
    shares = [np.sqrt(x) for x in shares]
    out = np.zeros((len(texts), WORDS + len(shares)), np.float32)
    out[:, WORDS:] = np.stack(shares, axis=1)
    data = [(t or "").encode().lower() for t in texts]
    for a, b in chunks([len(d) for d in data]):
        bucket: dict[bytes, int] = {}
        for i in range(a, b):
            found = data[i].split()
            if found:
                for w in set(found).difference(bucket):
                    bucket[w] = zlib.crc32(w) % WORDS
                out[i, :WORDS] = np.sqrt(np.bincount(np.fromiter(map(bucket.__getitem__, found), np.int64, len(found)), minlength=WORDS) / len(found))
    return out


def page_view(source: Sequence[str | None], lang: Sequence[str | None], size: Sequence[int | None]) -> np.ndarray:
    """Hashed source and language, and the length's order of magnitude; a null has a bucket of its own."""
    out = np.zeros((len(source), SOURCES + LANGS + 12), np.float32)
    for i, (s, g, n) in enumerate(zip(source, lang, size, strict=True)):
        out[i, 0 if s is None else 1 + zlib.crc32(str(s).encode()) % (SOURCES - 1)] = 1
        out[i, SOURCES + (0 if g is None else 1 + zlib.crc32(str(g).encode()) % (LANGS - 1))] = 1
        out[i, SOURCES + LANGS + (0 if n is None else 1 + min(10, int(np.log2(max(int(n), 1)) / 2)))] = 1
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights and, last, the bias of a ridge logistic regression by Newton steps."""
    x = np.hstack([x.astype(float), np.ones((len(x), 1))])
    w, weight = np.zeros(x.shape[1]), np.ones(len(x)) if weight is None else weight
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + keep * w
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(keep), grad)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


@dataclass
class Views:
    """Both classifiers, their calibrations and the combination. All probabilities are of a bad document."""

    text: np.ndarray
    page: np.ndarray
    calibrations: list[np.ndarray]
    mix: np.ndarray
    exchanged: list[tuple[int, int]]

    def calibrated(self, text: np.ndarray, page: np.ndarray) -> np.ndarray:
        raw = (logit(text, self.text), logit(page, self.page))
        return np.stack([logit(z[:, None], c) for z, c in zip(raw, self.calibrations, strict=True)], axis=1)

    def score(self, text: np.ndarray, page: np.ndarray) -> np.ndarray:
        """Columns: text view, page view, both."""
        z = self.calibrated(text, page)
        return _sigmoid(np.column_stack([z, logit(z, self.mix)]))


#: What a view is surest of: (name, label, text view, page view) of rows, a list for each view.
Surest = Callable[[list[np.ndarray], list[np.ndarray]], list[list[tuple[int, int, np.ndarray, np.ndarray]]]]


def bad_probability(x: np.ndarray, model: np.ndarray, calibration: np.ndarray) -> np.ndarray:
    """Calibrated probabilities, rounded so that the order of sums doesn't decide which row is surer."""
    return np.round(_sigmoid(logit(logit(x, model)[:, None], calibration)), 9)


def co_train(text: np.ndarray, page: np.ndarray, y: np.ndarray, surest: Surest, *, rounds: int = 4, seed: int = 7) -> Views | None:
    """y: 1 bad, 0 good. A fifth of the rows is held out for the calibrations.

    In each round surest(models, calibrations) gives the unlabelled rows that either view is surest of, and the other view
    learns them with half a label's weight."""
    rng = np.random.default_rng(seed)
    known = rng.permutation(len(y))
    held, learn = known[: len(known) // 5], known[len(known) // 5 :]
    if len({*y[learn]}) < 2 or len({*y[held]}) < 2:
        return None
    views = (text, page)
    taught: list[dict[int, tuple[int, np.ndarray]]] = [{}, {}]
    exchanged = []
    for step in range(rounds + 1):
        models, calibrations = [], []
        for x, extra in zip(views, taught, strict=True):
            rows, target = x[learn], y[learn]
            if extra:
                rows, target = np.concatenate([rows, np.stack([r for _, r in extra.values()])]), np.concatenate([target, [k for k, _ in extra.values()]])
            models.append(fit_logistic(rows, target, np.concatenate([np.ones(len(learn)), np.full(len(extra), 0.5)])))
            calibrations.append(fit_logistic(logit(x[held], models[-1])[:, None], y[held], ridge=0.01))
        if step == rounds:
            break
        for v, found in enumerate(surest(models, calibrations)):
            taught[1 - v] |= {name: (label, rows[1 - v]) for name, label, *rows in found}
        exchanged.append((len(taught[0]), len(taught[1])))
    out = Views(*models, calibrations, np.array([1.0, 1.0, 0.0]), exchanged)
    out.mix = fit_logistic(out.calibrated(text[held], page[held]), y[held], ridge=0.01)
    return out


def surest_of(names: np.ndarray, text: np.ndarray, page: np.ndarray, sure: float = 0.97, most: int = 256) -> Surest:
    """Of rows in memory those with a calibrated probability of at least sure, the `most` surest of a class, equal ones by
    name."""

    def find(models: list[np.ndarray], calibrations: list[np.ndarray]) -> list[list[tuple]]:
        out = []
        for x, w, c in zip((text, page), models, calibrations, strict=True):
            p = bad_probability(x, w, c)
            good, bad = np.lexsort((names, p))[:most], np.lexsort((names, -p))[:most]
            out.append([(int(names[i]), 0, text[i], page[i]) for i in good if p[i] <= 1 - sure] + [(int(names[i]), 1, text[i], page[i]) for i in bad if p[i] >= sure])
        return out

    return find


def _surest_in(views: DataFrame, known: DataFrame, sure: float, most: int) -> Surest:
    """The same over a table of views: every round scores all of its unlabelled rows. What comes to the driver are the
    chosen rows, 4 x most."""

    def find(models: list[np.ndarray], calibrations: list[np.ndarray]) -> list[list[tuple]]:
        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                both = [bad_probability(_matrix(batch.column(n)), w, c) if len(batch) else np.zeros(0) for n, w, c in zip((2, 3), models, calibrations, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(p) for p in both)], names=["key", "name", "p0", "p1"])

        kind = views.schema["key"].dataType.simpleString()
        scored = views.mapInArrow(score, f"key {kind}, name bigint, p0 double, p1 double")
        free = stash(scored.join(known, F.col("key") == F.col("__k"), "left_anti").groupBy("name").agg(F.min("p0").alias("p0"), F.min("p1").alias("p1")), "view-scores")
        chosen = []
        for v in range(2):
            p = F.col(f"p{v}")
            for label, ok, order in ((0, p <= 1 - sure, p), (1, p >= sure, -p)):
                chosen += [(r["name"], v, label) for r in free.filter(ok).orderBy(order, "name").limit(most).select("name").collect()]
        names = views.sparkSession.createDataFrame(sorted({(n,) for n, _, _ in chosen}), "__n bigint")
        rows = {r["name"]: r for r in views.join(F.broadcast(names), F.col("name") == F.col("__n")).dropDuplicates(["name"]).select("name", "text", "page").collect()}
        floats = lambda x: np.frombuffer(x, np.float32)
        return [[(n, label, floats(rows[n]["text"]), floats(rows[n]["page"])) for n, u, label in chosen if u == v] for v in range(2)]

    return find


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_buffer(), np.float32) for x in column])


def classify_quality(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", size: str = "n_chars", sample: int = 8192, most_good: float = 0.003, sure: float = 0.97, most: int = 256, seed: int = 7, **options) -> DataFrame:
    """(key, p_text, p_page, p_bad, threshold, kept) of every row of docs.

    Both views start from at most sample labelled rows, those of smallest key hash (labels: key, quality; 1 good, 0 bad;
    the lowest of repeated ones, nulls ignored). In each round every unlabelled row is scored by both, and either view
    passes on the `most` rows of a class that it is surest of. A fifth of the labelled keys, by hash, is kept from
    them; the threshold on p_bad comes from all labelled rows of that fifth: the best gain with at most most_good
    of the good rows above it (from all labelled rows if the fifth lacks a class). Without both classes in the sample
    nothing is rejected and probabilities are 0. Null texts are empty; null metadata have buckets of their
    own; repeated rows are scored alike and teach once; an empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"), docs[source].cast("string").alias("source"), docs[lang].cast("string").alias("lang"), docs[size].cast("long").alias("size"))
    rows = rows.withColumn("name", F.xxhash64(F.col("key").cast("string"), "text", "source", "lang", "size", F.lit(seed)))
    kind = rows.schema["key"].dataType.simpleString()
    # each text is looked at once; rounds and the last scores read the views
    views = stash(rows.mapInArrow(_view_rows, f"key {kind}, name bigint, text binary, page binary"), "views")
    known = stash(labels.filter("quality IS NOT NULL").groupBy(F.col(key).alias("__k")).agg(F.min("quality").cast("int").alias("__quality")), "labels")
    held = F.pmod(F.xxhash64(F.col("__k").cast("string"), F.lit(seed + 1)), F.lit(5)) == 0
    taken = stash(known.filter(~held).orderBy(F.xxhash64(F.col("__k").cast("string"), F.lit(seed)), "__k").limit(sample), "drawn")
    # a key may be repeated, so rows are bounded once more
    drawn = views.join(F.broadcast(taken), F.col("key") == F.col("__k"))
    seen = drawn.select("name", "__quality", "text", "page").orderBy("name", "__quality").limit(2 * sample).collect()
    model = None
    if seen:
        x = [np.stack([np.frombuffer(r[c], np.float32) for r in seen]) for c in ("text", "page")]
        model = co_train(*x, np.array([1 - int(r["__quality"] > 0) for r in seen]), _surest_in(views, known, sure, most), seed=seed, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.score(_matrix(batch.column(1)), _matrix(batch.column(2))) if model and len(batch) else np.zeros((len(batch), 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, i]) for i in range(3))], names=["key", "p_text", "p_page", "p_bad"])

    scored = stash(views.select("key", "text", "page").mapInArrow(run, f"key {kind}, p_text double, p_page double, p_bad double"), "quality-scores")
    threshold = float("inf")
    if model:
        judged = scored.join(known, F.col("key") == F.col("__k"))
        found = judged.groupBy(F.floor(F.col("p_bad") * BINS).cast("int").alias("b"), F.col("__quality").alias("q"), held.alias("h")).count().collect()
        counts = [(r["b"], r["q"], r["count"]) for r in found if r["h"]]
        if len({q > 0 for _, q, _ in counts}) < 2:
            counts = [(r["b"], r["q"], r["count"]) for r in found]
        threshold = choose_threshold(counts, most_good)
    return scored.select(F.col("key").alias(key), "p_text", "p_page", "p_bad", F.lit(threshold).alias("threshold"), (F.col("p_bad") < threshold).alias("kept"))


def _packed(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as one binary value each, without an object for each row."""
    size = x.shape[1] * x.itemsize
    offsets = np.arange(len(x) + 1, dtype=np.int32) * np.int32(size)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x))])


def _view_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    give_back(memos=True)
    for batch in batches:
        for a, b in chunks(text_sizes(batch.column("text"))):
            part = batch.slice(a, b - a)
            page = page_view(*(part.column(n).to_pylist() for n in ("source", "lang", "size")))
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("name"), _packed(text_view(part.column("text").to_pylist())), _packed(page)], names=["key", "name", "text", "page"])
    give_back()


def keep_classified(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that classify_quality keeps, with the columns of docs. Equal keys share one decision:
    a key stays if one of its rows does."""
    good = classify_quality(docs, labels, key=key, **options).filter("kept").select(F.col(key).alias("__good")).distinct()
    return docs.join(good, F.col(key).eqNullSafe(F.col("__good")), "left_semi")
