"""Counts that quality rules and classifiers use, for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

from .common import give_back

#: Names of the counts, in the order of the columns of text_stats.
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower", "n_digits", "n_punct", "n_adjacent", "n_lines")
#: Words of a window that counts as repeated.
WINDOW = 8
#: Bytes of text that are worked on at once.
CHUNK = 4 << 20

_OTHER, _UPPER, _LOWER, _DIGIT, _SYMBOL, _PUNCT, _SPACE, _INSIDE = range(8)
_CLASS = np.zeros(256, np.uint8)
for _name, _chars in ((_UPPER, range(65, 91)), (_LOWER, range(97, 123)), (_DIGIT, range(48, 58)), (_PUNCT, b"!\"'()+,-./:;=?@[\\]^_`{}~"), (_SYMBOL, b"#*$%&|<>"), (_SPACE, b" \t\n\v\f\r"), (_INSIDE, range(128, 192))):
    _CLASS[list(_chars)] = _name


def chunks(sizes: Sequence[int], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours of at most limit bytes in all, or of one longer text."""
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def text_sizes(column: pa.Array) -> list[int]:
    """Bytes of each text of a column, without making Python strings of them; 0 for null."""
    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: Bytes of a word up to which words are hashed together; longer ones are hashed one by one.
LONG = 128
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
_IS_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_hashes(texts: pa.Array | Sequence[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts in a row, and how many words each text has.

    Words are runs of bytes other than space and tab to carriage return, A-Z in lower case if asked. A word is
    hashed eight bytes at a time, all words at once.
    """
    column = texts if isinstance(texts, pa.Array) else pa.array(list(texts), pa.large_string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    size = int(at[-1] - at[0])
    data = np.zeros(size + 8, np.uint8)
    if size:
        data[:size] = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]]
    if lower:
        data = _LOWERED[data]
    at = at - at[0]
    inside = ~_IS_SPACE[data[:size]]
    before, after = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
    before[1:], after[: max(size - 1, 0)] = inside, inside[1:]
    # a text's first and last bytes end words
    before[at], after[at[1:] - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before[:size]), np.flatnonzero(inside & ~after[:size]) + 1
    eights = np.ndarray((size + 1,), "<u8", data, strides=(1,))
    n = ends - starts
    with np.errstate(over="ignore"):
        h = mixed((eights[starts] & _KEEP[np.minimum(n, 8)]) + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        more, k = np.flatnonzero((n > 8) & (n <= LONG)), 8
        while len(more):
            h[more] = mixed(h[more] * np.uint64(0xD1342543DE82EF95) + (eights[starts[more] + k] & _KEEP[np.minimum(n[more] - k, 8)]))
            k += 8
            more = more[n[more] > k]
    for i in np.flatnonzero(n > LONG):
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return h, np.diff(np.searchsorted(starts, at))


def window_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of width neighbours."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = ids[:n].copy()
        for k in range(1, width):
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += ids[k : k + n]
    return mixed(h)


def text_stats(texts: Sequence[str | None]) -> np.ndarray:
    """A row of STATS for each text; a null text counts as an empty one.

    Words are runs of characters other than space and tab to carriage return. Repeated windows are found by
    64-bit hashes of word numbers.
    """
    data = [(t or "").encode() for t in texts]
    out = np.zeros((len(data), len(STATS)), np.int64)
    for a, b in chunks([len(d) for d in data]):
        _chunk_stats(data[a:b], out[a:b])
    return out


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _chunk_stats(data: list[bytes], out: np.ndarray) -> None:
    number, ids, counts = _Numbers(), [], np.zeros(len(data), np.int64)
    for i, d in enumerate(data):
        words = d.split()
        counts[i] = len(words)
        ids.append(np.fromiter(map(number.__getitem__, words), np.uint64, len(words)))
        c = np.bincount(_CLASS[np.frombuffer(d, np.uint8)], minlength=8)
        lines = [x for x in d.split(b"\n") if x and not x.isspace()]
        out[i] = (len(words), len(d) - c[_INSIDE] - c[_SPACE], c[_SYMBOL], len(lines) - len(set(lines)), 0, c[_UPPER], c[_LOWER], c[_DIGIT], c[_PUNCT], 0, len(lines))
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint64)
    if len(flat) == 0:
        return
    owner = np.repeat(np.arange(len(data), dtype=np.uint64), counts)
    same = (flat[1:] == flat[:-1]) & (owner[1:] == owner[:-1])
    out[:, 9] = np.bincount(owner[1:][same].astype(np.int64), minlength=len(data))
    h = window_hashes(flat, WINDOW)
    if len(h) == 0:
        return
    whole = owner[: len(h)] == owner[WINDOW - 1 :]
    with np.errstate(over="ignore"):
        h = mixed(h + owner[: len(h)] * np.uint64(0xD1342543DE82EF95))
    at = np.flatnonzero(whole)
    order = at[np.argsort(h[at], kind="stable")]
    twin = h[order][1:] == h[order][:-1]
    hit = np.zeros(len(order), bool)
    hit[1:] |= twin
    hit[:-1] |= twin
    edge = np.zeros(len(flat) + 1, np.int64)
    np.add.at(edge, order[hit], 1)
    np.add.at(edge, order[hit] + WINDOW, -1)
    covered = np.cumsum(edge[:-1]) > 0
    out[:, 4] = np.bincount(owner[covered].astype(np.int64), minlength=len(data))


def document_stats(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, STATS...) of every row of docs; no shuffle, other columns are not read."""
    rows = docs.select(docs[key].alias("__key"), docs[text].cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back(memos=True)
        for batch in batches:
            texts = batch.column(1)
            s = np.concatenate([np.zeros((0, len(STATS)), np.int64), *(text_stats(texts.slice(a, b - a).to_pylist()) for a, b in chunks(text_sizes(texts)))])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(s[:, i]) for i in range(len(STATS)))], names=["__key", *STATS])
        give_back()

    kind = rows.schema["__key"].dataType.simpleString()
    return rows.mapInArrow(run, f"__key {kind}, " + ", ".join(f"{n} long" for n in STATS)).withColumnRenamed("__key", key)
