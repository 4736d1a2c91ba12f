"""Order-aware line diffs of pairs of texts, by a longest common subsequence."""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LINE_END = re.compile(r"\r\n|\r|\n")
_ROWS = pa.schema([("place", pa.int32()), ("kind", pa.string()), ("line", pa.string())])


class _Table:
    """Rows of the table of the lengths of longest common subsequences of the ends of two texts.

    Neighbours in a row differ by 0 or 1, so a row is one integer with a bit for each line of the second text, and a row
    follows from the one below by a few operations on whole integers (Hyyrö 2004). Every step-th row is kept; the rows
    between are made again when they are needed, so that memory grows with the square root of the first text."""

    def __init__(self, a: list[int], b: list[int]) -> None:
        self.a, self.n, self.m = a, len(a), len(b)
        self.ones = (1 << self.m) - 1
        self.where: dict[int, int] = {}
        # bit q stands for line m - 1 - q
        for j, x in enumerate(b):
            self.where[x] = self.where.get(x, 0) | 1 << (self.m - 1 - j)
        self.step = isqrt(self.n) + 1
        self.kept, self.block, self.rows = {self.n: self.ones}, -1, []
        v = self.ones
        for i in range(self.n - 1, -1, -1):
            v = self._above(v, i)
            if i % self.step == 0:
                self.kept[i] = v

    def _above(self, v: int, i: int) -> int:
        u = v & self.where.get(self.a[i], 0)
        return ((v + u) | (v - u)) & self.ones

    def row(self, i: int) -> int:
        """A bit is 0 where the length grows from the next line to this one."""
        if i in self.kept:
            return self.kept[i]
        if i // self.step != self.block:
            self.block, low = i // self.step, i // self.step * self.step
            top = min(low + self.step, self.n)
            v, self.rows = self.kept[top], []
            for k in range(top - 1, low - 1, -1):
                v = self._above(v, k)
                self.rows.append(v)
            self.rows.reverse()
        return self.rows[i % self.step]


def common_order(a: list[int], b: list[int]) -> Iterator[tuple[str, int]]:
    """('UNCHANGED', i), ('REMOVED', i) of lines of a and ('ADDED', j) of b in order, with as many unchanged ones as there
    can be. Equal lines meet as soon as they can; where both are right, a line is removed first."""
    t = _Table(a, b)
    i = j = 0
    # how long a common subsequence of what is left is, from line i and from the one below
    here = t.m - t.row(0).bit_count()
    below = t.m - t.row(1).bit_count() if a else 0
    while i < t.n and j < t.m:
        bit = 1 << (t.m - 1 - j)
        if a[i] == b[j]:
            yield "UNCHANGED", i
            i, j = i + 1, j + 1
            here = below - (0 if t.row(i) & bit else 1)
        elif below >= here - (0 if t.row(i) & bit else 1):
            yield "REMOVED", i
            i += 1
            here = below
        else:
            yield "ADDED", j
            below -= 0 if t.row(i + 1) & bit else 1
            here -= 0 if t.row(i) & bit else 1
            j += 1
            continue
        # the row below is cut off at line j
        below = (t.m - j) - (t.row(i + 1) & ((1 << (t.m - j)) - 1)).bit_count() if i < t.n else 0
    for k in range(i, t.n):
        yield "REMOVED", k
    for k in range(j, t.m):
        yield "ADDED", k


def text_diff(base: str | None, target: str | None) -> list[tuple[str, str]]:
    """(kind, line) of two texts; lines count without white space at their ends."""
    before, after = ([x.rstrip() for x in _LINE_END.split(t or "")] for t in (base, target))
    for lines, text in ((before, base), (after, target)):
        # what follows the last line's end is no line
        if not text or text[-1] in "\r\n":
            lines.pop()
    number: dict[str, int] = {}
    a, b = ([number.setdefault(x, len(number)) for x in lines] for lines in (before, after))
    return [(kind, after[k] if kind == "ADDED" else before[k]) for kind, k in common_order(a, b)]


def diff_lines(pairs: DataFrame, key: str = "pair_id", base: str = "base", target: str = "target") -> DataFrame:
    """(key, place, kind, line) of every line of (key, base, target), in order: UNCHANGED, REMOVED from base or ADDED in
    target. As many lines as can be are unchanged without changing their order, so a moved line is removed and added.

    Whole texts are compared. A pair is one task's; it takes memory for a bit table of the square root of its lines."""
    rows = pairs.select(pairs[key].alias("__key"), pairs[base].cast("string").alias("__base"), pairs[target].cast("string").alias("__target"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = text_diff(batch.column(1)[i].as_py(), batch.column(2)[i].as_py())
                if found:
                    columns = [batch.column(0).take(pa.array([i] * len(found))), pa.array(range(len(found)), pa.int32()), pa.array([x[0] for x in found]), pa.array([x[1] for x in found])]
                    yield pa.RecordBatch.from_arrays(columns, names=["__key", *_ROWS.names])

    kind = rows.schema["__key"].dataType.simpleString()
    return rows.mapInArrow(run, f"__key {kind}, place int, kind string, line string").withColumnRenamed("__key", key)


def version_diff(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    """(key, added, removed, unchanged): numbers of lines of diff_lines; pairs without any line have zeros."""
    counts = diff_lines(pairs, key).groupBy(key).agg(*(F.count_if(F.col("kind") == kind).alias(kind.lower()) for kind in ("ADDED", "REMOVED", "UNCHANGED")))
    return pairs.select(key).join(counts, key, "left").na.fill(0, ["added", "removed", "unchanged"])
