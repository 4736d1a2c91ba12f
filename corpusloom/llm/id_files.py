"""Token-id files: documents encoded in key order, written as frames of range-coded blocks and read back."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import CharDelimiterSplit

from ..session import fresh_path, stash
from .context_coder import FRAME, decode_frame, encode_frame
from .prefix_bpe import MEMO, python_pattern
from .rule_stats import chunks, text_sizes


#: Characters of which the library's and this module's pattern think alike, whatever Unicode version either knows
#: (a test compares them); pieces with others are encoded by the library as they are.
_SETTLED = re.compile("[\\0-\u0557\u0900-\u0b7f\u2000-\u206f\u3000-\u30ff\u4e00-\u9fa5\uac00-\ud7a3]*")
_SETTLED_RUN = re.compile(_SETTLED.pattern.replace("*", "+"))
#: A space at either end, or with white space of any kind beside it.
_BESIDE = r"^ | $| [{0}]|[{0}] ".format(r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
#: The pattern of byte-level pre-tokenizers of the library.
_WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions start .. start + size - 1 of each range, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def _joined(column: pa.Array, between: bytes) -> pa.Buffer:
    one = pa.LargeListArray.from_arrays([0, len(column)], column.cast(pa.large_binary()))
    return pc.binary_join(one, pa.scalar(between, pa.large_binary()))[0].as_buffer()


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Of each character up to the last settled one: 1 a letter, 2 a number, 3 neither, 0 what the pattern has to see (white
    space, the apostrophe, control characters), 4 not settled, as is what lies beyond."""
    chars = "".join(map(chr, range(0xD7A5)))
    out = np.full(len(chars), 4, np.uint8)
    for found, kind in ((_SETTLED_RUN.finditer(chars), 3), (regex.finditer(r"\p{L}+", chars), 1), (regex.finditer(r"\p{N}+", chars), 2), (regex.finditer(r"[\s\p{C}']+", chars), 0)):
        for m in found:
            part = out[m.start() : m.end()]
            part[part < 4 if kind < 3 else slice(None)] = kind
    return out


class PieceTokenizer:
    """A byte-level tokenizer of the library that encodes every distinct word once.

    Pieces end before a space between two characters that are not white space. Such a tokenizer always starts a new
    word there, so that a text's ids are its pieces' ids in a row. The distinct pieces of a batch are cut into the
    tokenizer's words, and the library's model encodes each distinct word once. Texts that hold a string of an added
    token, and all texts of tokenizers of another making, are encoded by the library as they are.
    """

    def __init__(self, data: bytes):
        self.library = Tokenizer.from_str(data.decode())
        spec = json.loads(data)
        cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and not spec.get("normalizer") and (spec.get("post_processor") or cut).get("type") == "ByteLevel" and model.get("type") == "BPE" and not model.get("dropout") and not model.get("unk_token")
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.words = regex.compile(python_pattern(_WORD)).findall
        vocab = self.library.get_vocab(with_added_tokens=False)
        self.bytes = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
        for name, i in vocab.items():
            self.bytes[i] = len(name)
        # the same model for words that are spelled already, a line for each
        self.lines = Tokenizer(self.library.model)
        self.lines.pre_tokenizer = CharDelimiterSplit("\n")
        self.kind = np.dtype("<u2") if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.dtype("<u4")
        # Byte-level models spell printable bytes as themselves, other bytes as the characters from U+0100.
        # No text holds the byte 255, which here stands behind each word.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = iter(range(256, 512))
        spelled = [chr(b) if b in shown else chr(next(hidden)) for b in range(255)] + ["\n"]
        self.spelling = np.array([[*c.encode(), 0][:2] for c in spelled], np.uint8)
        self._forget()

    def _forget(self) -> None:
        # words by number, and where in the pool the ids of each number are
        self.numbers: dict[str, int] = {}
        self.pool, self.ends = np.zeros(1 << 16, self.kind), np.zeros(1 << 16, np.int64)
        self.held = 0

    def encode(self, texts: Sequence[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        if len(self.numbers) > MEMO:
            self._forget()
        column = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        whole = np.full(len(column), not self.plain)
        for a in self.added:
            whole |= pc.match_substring(column, a).to_numpy(zero_copy_only=False)
        # texts with white space beside a space are not cut into pieces
        apart = whole | pc.match_substring_regex(column, _BESIDE).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(pc.if_else(pa.array(apart), "", column), " ")
        starts = np.asarray(lists.offsets)[:-1].astype(np.int64)
        first = np.zeros(len(lists.values), bool)
        first[starts] = True
        inner = lists.values.filter(pa.array(~first)).dictionary_encode()
        heads = pc.if_else(pa.array(apart), column, lists.values.take(pa.array(starts))).to_pylist()
        place, ids, sizes = self._pieces(inner.dictionary, heads, whole)
        # pieces of the batch in order: heads are behind the distinct inner pieces
        pieces = np.empty(len(first), np.int64)
        pieces[~first] = place[inner.indices.to_numpy()]
        pieces[first] = len(inner.dictionary) + np.arange(len(heads))
        n_ids = sizes[pieces]
        ids = ids[_ragged((np.cumsum(sizes) - sizes)[pieces], n_ids)]
        return ids, np.add.reduceat(n_ids, starts) if len(starts) else np.zeros(0, np.int64)

    def _pieces(self, inner: pa.Array, heads: list[str], whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each inner piece (which has a space before it) stands in a row of all inner pieces, then heads; the ids of
        this row, and how many each of its pieces has."""
        kept, cut, cut_sizes, odd = self._cut(inner)
        lists, alone = [], []
        for p in inner.take(pa.array(odd)).to_numpy(zero_copy_only=False).tolist():
            settled = _SETTLED.fullmatch(p)
            lists.append(self.words(" " + p) if settled else [" " + p])
            alone.append(not settled)
        for h, far in zip(heads, whole.tolist(), strict=True):
            alone.append(far or not _SETTLED.fullmatch(h))
            lists.append([h] if alone[-1] else self.words(h))
        place = np.empty(len(inner), np.int64)
        place[np.concatenate([kept, odd])] = np.arange(len(inner))
        words = pa.concat_arrays([cut, pa.array([w for ws in lists for w in ws], pa.large_string())]).dictionary_encode()
        names, indices = words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy()
        numbers = np.fromiter(map(self.numbers.get, names, repeat(-1)), np.int64, len(names))
        counts = np.array([len(ws) for ws in lists], np.int64)
        as_is = np.zeros(len(names), bool)
        as_is[indices[(len(cut) + np.cumsum(counts) - counts)[np.array(alone, bool)]]] = True
        missing = numbers < 0
        for which, far in ((np.flatnonzero(missing & ~as_is), False), (np.flatnonzero(missing & as_is), True)):
            if len(which):
                numbers[which] = len(self.numbers) + np.arange(len(which))
                self._learn(words.dictionary.take(pa.array(which)), far)
        numbers = numbers[indices]
        stops, starts = self.ends[numbers + 1], self.ends[numbers]
        through = np.concatenate([[0], np.cumsum(stops - starts)])
        per_piece = np.cumsum(np.concatenate([cut_sizes, counts]))
        return place, self.pool[_ragged(starts, stops - starts)], np.diff(through[per_piece], prepend=0)

    def _cut(self, inner: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
        """The pieces of letters, numbers and other signs alone, their words in a row and how many each has; and the pieces
        that the pattern or the library has to see. Where no such character is, a word ends where their kind changes."""
        if not len(inner):
            return np.zeros(0, np.int64), pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
        data = b" " + _joined(inner, b" ").to_pybytes()
        chars = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        classes = _classes()
        kinds = classes.take(chars, mode="clip")
        # no piece holds a space
        at = np.flatnonzero(chars == 32)
        kinds[at] = 5
        seen = np.add.reduceat((kinds == 0) | (kinds == 4), at, dtype=np.int64)
        start = np.empty(len(chars), bool)
        start[0] = True
        np.not_equal(kinds[1:], kinds[:-1], out=start[1:])
        start[at[at + 1 < len(chars)] + 1] = False
        start[at] = True
        n_words = np.add.reduceat(start, at, dtype=np.int64)
        # by bytes
        begins = np.flatnonzero(start)
        if len(data) > len(chars):
            width = (chars > 0x7F).astype(np.int8) + (chars > 0x7FF) + (chars > 0xFFFF) + np.int8(1)
            begins = (np.cumsum(width, dtype=np.int64) - width)[begins]
        bounds = pa.py_buffer(np.append(begins, len(data)))
        words = pa.LargeStringArray.from_buffers(len(begins), bounds, pa.py_buffer(data))
        plain = seen == 0
        if not plain.all():
            words = words.filter(pa.array(np.repeat(plain, n_words)))
        return np.flatnonzero(plain), words, n_words[plain], np.flatnonzero(~plain)

    def _learn(self, words: pa.Array, far: bool) -> None:
        """Gives new words numbers. Far ones are encoded by the library as they are, the others by its model."""
        names = words.to_numpy(zero_copy_only=False).tolist()
        if far:
            each = [e.ids for e in self.library.encode_batch_fast(names, add_special_tokens=False)]
        else:
            data = self.spelling[np.frombuffer(_joined(words, b"\xff"), np.uint8)].ravel()
            lines = data[data > 0].tobytes().decode()
            new = np.array(self.lines.encode_batch_fast([lines], add_special_tokens=False)[0].ids, self.kind)
            # a word ends where the bytes of its ids do
            through, ends = np.cumsum(self.bytes[new]), np.cumsum(pc.binary_length(words.cast(pa.large_binary())).to_numpy())
            last = np.searchsorted(through, ends)
            each = None
            if not len(through) or through[-1] != ends[-1] or (through[last] != ends).any():
                # a model that lacks some byte
                each = [[t.id for t in self.library.model.tokenize(w)] for w in lines.split("\n")]
        if each is not None:
            new, last = np.array([i for e in each for i in e], self.kind), np.cumsum([len(e) for e in each]) - 1
        known = len(self.numbers)
        self.numbers.update(zip(names, range(known, known + len(names)), strict=True))
        if known + len(names) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(max(len(self.ends), len(names)), np.int64)])
        if self.held + len(new) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(new)), self.kind)])
        self.ends[known + 1 : known + 1 + len(names)] = self.held + 1 + last
        self.pool[self.held : self.held + len(new)] = new
        self.held += len(new)


@lru_cache(maxsize=2)
def _tokenizer(data: bytes) -> PieceTokenizer:
    return PieceTokenizer(data)


def write_id_files(docs: DataFrame, path: str, tokenizer_file: str, *, key: str = "doc_id", text: str = "text", end_id: int = 0) -> None:
    """Writes the ids of every text, each document with end_id behind it, in ascending order of key (null first).

    The files are Parquet. A row is a frame: part and seq (its place), keys and lengths of its documents, and the
    coded ids. Documents are sorted by range, then encoded and coded in one pass. Null texts are empty. Of equal
    keys the lesser text comes first.
    """
    with open(tokenizer_file, "rb") as f:
        data = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(data)
    rows = docs.select(docs[key].alias("__key"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("__text"))
    kind = rows.schema["__key"].dataType.simpleString()
    rows = rows.repartitionByRange("__key").sortWithinPartitions("__key", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, seq = _tokenizer(shared.value), TaskContext.get().partitionId(), 0
        keys: list[pa.Array] = []
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0

        def frame() -> pa.RecordBatch:
            named = pa.concat_arrays(keys)
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(named)], pa.int32()), named),
                pa.array([np.concatenate(sizes)], pa.list_(pa.int64())), pa.array([encode_frame(np.concatenate(ids))], pa.large_binary()),
            ], names=["part", "seq", "keys", "lengths", "ids"])

        for batch in batches:
            for a, b in chunks(text_sizes(batch.column(1))):
                found, n = tok.encode(batch.column(1).slice(a, b - a))
                keys.append(batch.column(0).slice(a, b - a))
                ids.append(np.insert(found, np.cumsum(n), end_id))
                sizes.append(n + 1)
                held += len(ids[-1])
                if held >= FRAME:
                    yield frame()
                    keys, ids, sizes, held, seq = [], [], [], 0, seq + 1
        if keys:
            yield frame()

    rows.mapInArrow(run, f"part int, seq int, keys array<{kind}>, lengths array<long>, ids binary").write.parquet(path)


def read_id_files(spark: SparkSession, path: str, *, with_ids: bool = False) -> DataFrame:
    """(key, start, n_tokens, ids_crc32[, ids]) of every document in the files below path.

    start counts the ids of all documents before it; ids are little-endian unsigned 32-bit integers, ids_crc32 their
    checksum. Blocks with a wrong checksum raise an error. Starts come from sums by part, then by frame of a part.
    """
    files = spark.read.parquet(path)
    kind = files.schema["keys"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, seq, keys, lengths, coded = (batch.column(j)[i] for j in range(5))
                ids, sizes = decode_frame(coded.as_py()), np.array(lengths.as_py(), np.int64)
                ends = np.cumsum(sizes)
                raw = [ids[a:b].tobytes() for a, b in zip(ends - sizes, ends, strict=True)]
                n = len(raw)
                cols = [keys.values, pa.array(np.full(n, part.as_py(), np.int32)), pa.array(np.full(n, seq.as_py(), np.int32)), pa.array(ends - sizes), pa.array(sizes), pa.array([zlib.crc32(r) for r in raw], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(raw, pa.binary())] * with_ids, names=["key", "part", "seq", "inside", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    found = files.select("part", "seq", "keys", "lengths", "ids").mapInArrow(run, f"key {kind}, part int, seq int, inside long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    frames = files.select("part", "seq", F.aggregate("lengths", F.lit(0).cast("long"), lambda x, y: x + y).alias("__n"))
    frames = stash(frames, "id-frames")
    parts = frames.groupBy("part").agg(F.sum("__n").alias("__pn"))
    parts = parts.select("part", (F.sum("__pn").over(Window.orderBy("part")) - F.col("__pn")).alias("__before"))
    inner = F.sum("__n").over(Window.partitionBy("part").orderBy("seq")) - F.col("__n")
    at = frames.withColumn("__inner", inner).join(parts, "part").select("part", "seq", (F.col("__inner") + F.col("__before")).alias("__start"))
    out = found.join(at, ["part", "seq"])
    return out.select("key", (F.col("__start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def round_trip(docs: DataFrame, tokenizer_file: str, *, key: str = "doc_id", path: str | None = None, **options) -> DataFrame:
    """Writes docs as id files and reads them back: (key, start, n_tokens, ids_crc32)."""
    path = path or fresh_path(docs.sparkSession, "ids")
    write_id_files(docs, path, tokenizer_file, key=key, **options)
    return read_id_files(docs.sparkSession, path).withColumnRenamed("key", key)
