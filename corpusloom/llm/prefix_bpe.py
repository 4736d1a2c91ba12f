"""Byte-level BPE by prefix dynamic programming: encoding, appends, edits and decoding.

For every prefix of a byte string there is one last token that an encoding of that prefix can end with. A token
that ends at byte i is the one if the prefix before it ends with a token that may stand to its left: the two
tokens' bytes, encoded alone, give these two tokens. So one left-to-right table of last tokens holds the encoding
of every prefix: appended bytes only add entries, and an edit leaves all entries before it.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import MEMOS, give_back

#: A space between two characters that are not white space: the pattern always starts a new match there.
_BOUNDARY = re.compile(r"(?<=\S) (?=\S)")
#: A space next to other white space, for which _BOUNDARY has to be searched.
_UNSAFE = re.compile(r"[^\S ] | [^\S ]")
#: White space of the Unicode property, which \s means to the tokenizer's library.
_SPACE = r"\t-\r\x20\x85\xa0  -     　"
#: Entries kept in each memo of a worker; a full memo starts afresh, which costs time and changes no result.
MEMO = 400_000


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from the lines 'base64 rank' of a vocabulary file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def python_pattern(pattern: str) -> str:
    """The pattern with white space as the tokenizer's library means it: without Python-only members such as U+001C."""
    return pattern.replace(r"[^\s", "[^" + _SPACE).replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]")


class PrefixTable:
    """The last token of every prefix of a growing byte string; exact after any append."""

    def __init__(self, vocab: Vocabulary, data: bytes = b""):
        self.vocab, self.data, self.last = vocab, b"", []
        self.append(data)

    def append(self, more: bytes) -> PrefixTable:
        at, self.data = len(self.data), self.data + more
        back = min(at, self.vocab.longest - 1)
        last, first = self.last, at - back
        last += [-1] * len(more)
        pairs, pair = self.vocab.neighbours, self.vocab.pair
        for end, (token, size) in self.vocab.ends.iter(self.data[first:].decode("latin-1")):
            end += first
            if last[end] < 0:
                start = end - size
                if start < 0:
                    ok = self.vocab.whole(token)
                else:
                    ok = pairs.get(last[start] << 32 | token)
                    if ok is None:
                        ok = pair(last[start], token)
                if ok:
                    last[end] = token
        if last and min(last[at:], default=0) < 0:
            raise ValueError("a byte is not in the vocabulary")
        return self

    def truncate(self, size: int) -> PrefixTable:
        """Back to the first size bytes; their entries still hold."""
        self.data = self.data[:size]
        del self.last[size:]
        return self

    def tokens(self, size: int | None = None) -> list[int]:
        """The encoding of the first size bytes, all by default."""
        at, out = len(self.data) if size is None else size, []
        while at:
            token = self.last[at - 1]
            out.append(token)
            at -= len(self.vocab.texts[token])
        return out[::-1]


class Vocabulary:
    """Ranks of byte strings, with memos of valid neighbours, encoded matches and encoded pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.texts = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self.matches = regex.compile(python_pattern(pattern)).findall
        # every place where a token can end, found in one pass; bytes stand as the characters of equal number
        self.ends = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.ends.add_word(b.decode("latin-1"), (i, len(b)))
        self.ends.make_automaton()
        self.neighbours: dict[int, bool] = {}
        self._wholes: dict[int, bool] = {}
        self._matches: dict[str, bytes] = {}
        self._first, self._rest = _Pieces(self, ""), _Pieces(self, " ")

    def merged(self, data: bytes) -> list[int]:
        """Plain BPE by merging the neighbours of least rank first; used for single tokens and pairs only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranked = [(r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
            if not ranked:
                break
            _, i = min(ranked)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def whole(self, token: int) -> bool:
        """Do merges of the token's bytes give the token?"""
        ok = self._wholes.get(token)
        if ok is None:
            ok = self._wholes[token] = self.merged(self.texts[token]) == [token]
        return ok

    def pair(self, left: int, right: int) -> bool:
        """May right follow left in an encoding?"""
        key = left << 32 | right
        ok = self.neighbours.get(key)
        if ok is None:
            if len(self.neighbours) > MEMO:
                self.neighbours.clear()
            ok = self.neighbours[key] = self.merged(self.texts[left] + self.texts[right]) == [left, right]
        return ok

    def encode_match(self, match: str) -> bytes:
        """Ids of one match of the pattern as little-endian 32-bit integers. A match in the vocabulary is one id."""
        out = self._matches.get(match)
        if out is None:
            data = match.encode()
            token = self.ranks.get(data)
            ids = [token] if token is not None else PrefixTable(self, data).tokens()
            if len(self._matches) > MEMO:
                self._matches.clear()
            out = self._matches[match] = np.array(ids, "<u4").tobytes()
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers, as a tokenizer without special tokens gives them."""
        if not text:
            return b""
        parts = text.split(" ")
        if "" in parts or _UNSAFE.search(text):
            parts = _BOUNDARY.split(text)
        if len(self._rest) > MEMO:
            self._rest.clear()
        if len(self._first) > MEMO // 10:
            self._first.clear()
        return self._first[parts[0]] + b"".join(map(self._rest.__getitem__, parts[1:]))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.texts.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Pieces(dict):
    """Encodings of pieces between safe boundaries, made when first asked for."""

    def __init__(self, vocab: Vocabulary, lead: str):
        self.vocab, self.lead = vocab, lead

    def __missing__(self, piece: str) -> bytes:
        out = b"".join(map(self.vocab.encode_match, self.vocab.matches(self.lead + piece)))
        if len(piece) < 200:
            self[piece] = out
        return out


class EditableText:
    """A text with its matches and ids, kept exact under appends and replacements by encoding near the edit only."""

    def __init__(self, vocab: Vocabulary, text: str = ""):
        self.vocab, self.text = vocab, text
        self.parts = vocab.matches(text)
        self.encoded = 0

    def append(self, more: str) -> EditableText:
        return self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> EditableText:
        """Matches look at most one match ahead, so those up to two before the edit stay. Behind it, matching
        stops at the first old boundary that it meets: what follows is the same text from the same place."""
        old, at, keep = self.parts, 0, 0
        while keep < len(old) and at + len(old[keep]) <= start:
            at += len(old[keep])
            keep += 1
        for _ in range(min(2, keep)):
            keep -= 1
            at -= len(old[keep])
        text = self.text[:start] + new + self.text[end:]
        shift, bounds, p = len(text) - len(self.text), {}, 0
        for i, part in enumerate(old):
            if p >= end and p + shift >= start + len(new):
                bounds[p + shift] = i
            p += len(part)
        fresh, tail = [], []
        for m in regex.finditer(self.vocab.matches.__self__, text, pos=at):
            if m.start() in bounds:
                tail = old[bounds[m.start()] :]
                break
            fresh.append(m.group())
        self.text, self.parts, self.encoded = text, old[:keep] + fresh + tail, len(fresh)
        return self

    def ids(self) -> bytes:
        return b"".join(map(self.vocab.encode_match, self.parts))


@lru_cache(maxsize=2)
def _vocabulary(data: bytes, pattern: str) -> Vocabulary:
    # what earlier stages have freed goes back before the memos grow
    give_back()
    return Vocabulary(parse_ranks(data), pattern)


MEMOS.append(_vocabulary.cache_clear)


def encode_documents(docs: DataFrame, ranks_file: str, pattern: str, *, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes and decodes every text: (key, n_tokens, ids_sha256, decoded_sha256[, ids]).

    ids are little-endian unsigned 32-bit integers. decoded_sha256 comes from decoding the ids again. A null text
    is encoded as an empty one, which has no ids. Keys pass through, repeated or null ones too. No shuffle: rows
    stay in their partitions; other columns of docs are not read.
    """
    with open(ranks_file, "rb") as f:
        data = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(data)
    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = _vocabulary(shared.value, pattern)
        for batch in batches:
            n, ids_hash, text_hash, kept = [], [], [], []
            for t in batch.column(1):
                ids = vocab.encode(t.as_py() or "")
                n.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                text_hash.append(hashlib.sha256(vocab.decode(ids)).hexdigest())
                if with_ids:
                    kept.append(ids)
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            names = ["key", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols, names = [*cols, pa.array(kept, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
