"""Texts cut into chunks that keep headings and places."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, lines, strip, token_estimate


def chunk_places(sizes: np.ndarray, heads: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, heading) of each chunk of one text, counted from 1: its first line, and the last heading line at or before
    that (0 without one). A chunk ends with the line that brings it to limit characters or more.

    The line behind a chunk that starts at any line is found for all lines at once, by binary search on the sums of
    sizes. The chunks' own starts are what these pointers reach from the first line; each step doubles the pointers and
    the known starts, so that a text of n lines and k chunks takes log k passes."""
    n = len(sizes)
    before = np.zeros(n + 1, np.int64)
    np.cumsum(sizes, out=before[1:])
    jump = np.append(np.searchsorted(before, before[:-1] + limit), n)
    jump = np.minimum(jump, n)
    reached = np.zeros(n + 1, bool)
    reached[0] = True
    while not reached[n]:
        reached[jump[np.flatnonzero(reached)]] = True
        jump = jump[jump]
    starts = np.flatnonzero(reached[:n])
    last = np.maximum.accumulate(np.where(heads, np.arange(1, n + 1), 0)) if n else np.zeros(0, np.int64)
    return starts + 1, last[starts]


def _starts(limit: int):
    @F.pandas_udf("struct<line:array<int>,heading:array<int>>")
    def starts(sizes: pd.Series, heads: pd.Series) -> pd.DataFrame:
        found = [chunk_places(s, h, limit) for s, h in zip(sizes, heads, strict=True)]
        return pd.DataFrame({"line": [x for x, _ in found], "heading": [x for _, x in found]})

    return starts


def line_chunks(texts: DataFrame, key: str = "file_id", text: str = "text", limit: int = 1600) -> DataFrame:
    """(key, seq, heading, content, token_count): lines are gathered until limit is reached; long lines stay whole.

    The heading is the last '#' line at or before the chunk's first line, without '#' and space around it. Chunks without
    text are left out. Only the lines' sizes go through Python; a document's lines are cut in one row, each once."""
    base = texts.filter(F.trim(F.coalesce(F.col(text), F.lit(""))) != "").select(key, lines(F.col(text)).alias("__lines"))
    sizes = F.transform("__lines", lambda x: F.length(x) + 1)
    heads = F.transform("__lines", lambda x: F.startswith(strip(x), F.lit("#")))
    placed = base.select(key, "__lines", _starts(limit)(sizes, heads).alias("__at"))

    def cut(s: Column) -> Column:
        def one(line: Column, k: Column) -> Column:
            until = F.coalesce(F.get(s["line"], k + 1), F.size(s["lines"]) + 1)
            at = F.get(s["heading"], k)
            heading = F.when(at > 0, strip(F.regexp_replace(strip(F.get(s["lines"], at - 1)), r"^#+", "")))
            return F.struct(k.alias("seq"), heading.alias("heading"), F.array_join(F.slice(s["lines"], line, until - line), "\n").alias("raw"))

        return F.transform(s["line"], one)

    # a lambda's argument: the arrays are read where they are, not taken out of the row for each chunk
    parts = let(F.struct(F.col("__lines").alias("lines"), F.col("__at.line").alias("line"), F.col("__at.heading").alias("heading")), cut)
    row = placed.select(key, F.explode(parts).alias("c")).select(key, "c.*")
    out = row.select(key, "seq", "heading", strip(F.col("raw")).alias("content"), token_estimate(F.concat("raw", F.lit("\n"))).alias("token_count"))
    return out.filter("content != ''")


def fixed_chunks(pages: DataFrame, key: str, page_no: str, text: str = "text", size: int = 1600) -> DataFrame:
    """(key, page_no, seq, heading, content): page texts cut hard every size characters; blank pages are left out."""
    t = F.col(text)
    parts = F.transform(F.sequence(F.lit(0), F.length(t) - 1, F.lit(size)), lambda i: F.substring(t, i + 1, F.lit(size)))
    found = pages.filter(F.trim(F.coalesce(t, F.lit(""))) != "")
    return found.select(F.col(key), F.col(page_no).alias("page_no"), F.concat(F.lit("第 "), F.col(page_no).cast("string"), F.lit(" 页")).alias("heading"), F.posexplode(parts).alias("seq", "content"))


def overlap_chunks(texts: DataFrame, key: str = "file_id", text: str = "text", size: int = 1200, overlap: int = 150) -> DataFrame:
    """(key, seq, content): windows of size characters, each overlapping the one before."""
    t = F.col(text)
    parts = F.transform(F.sequence(F.lit(0), F.length(t) - 1, F.lit(size - overlap)), lambda i: F.substring(t, i + 1, F.lit(size)))
    return texts.filter(F.length(t) > 0).select(F.col(key), F.posexplode(parts).alias("seq", "content"))


def split_sections(texts: DataFrame, key: str = "file_id", text: str = "text", default: str = "Document") -> DataFrame:
    """(key, section, title, content): a '#' line opens a section; blank and fence lines and empty sections go."""
    row = texts.select(F.col(key), F.posexplode(lines(F.coalesce(F.col(text), F.lit("")))).alias("n", "line"))
    head = F.startswith(strip(F.col("line")), F.lit("#"))
    w = Window.partitionBy(key).orderBy("n")
    row = row.withColumn("head", head).withColumn("section", F.sum(head.cast("int")).over(w))
    kept = row.filter((strip(F.col("line")) != "") & ~F.startswith(strip(F.col("line")), F.lit("```")))
    title = F.max(F.when(F.col("head"), strip(F.regexp_replace(strip(F.col("line")), r"^#+\s*", ""))))
    body = F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("n", "line"))))
    out = kept.groupBy(key, "section").agg(F.coalesce(title, F.lit(default)).alias("title"), F.array_join(F.transform(body, lambda x: x["line"]), "\n").alias("content"))
    return out.filter("content != ''")


def parse_status(text: Column) -> Column:
    return F.when(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", "") == "", "FAILED").otherwise("PARSED")


def chunks_of_file(chunks: DataFrame, file_id: int) -> DataFrame:
    return chunks.filter(F.col("file_id") == file_id).orderBy("seq")


def chunk_with_source(chunks: DataFrame, files: DataFrame, cols: Sequence[str] = ("name", "rel_path")) -> DataFrame:
    return chunks.join(files.select("file_id", *cols), "file_id")
