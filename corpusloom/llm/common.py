"""Joins and graph steps that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stash

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: What empties the memos that a worker keeps from task to task.
MEMOS: list[Callable[[], None]] = []


def give_back(memos: bool = False) -> None:
    """Returns freed memory of a worker to the system, Arrow's too. Workers are used again by later stages, and what the
    allocators keep of large arrays adds up with what these need. With memos, those of other operators go first, which
    costs time when they are asked for again. The C library's part is left out where it cannot do it."""
    if memos:
        for empty in MEMOS:
            empty()
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


#: A key with more than this share of the rows is joined by broadcast; fewer than 1 / HOT_SHARE keys can have it.
HOT_SHARE = 1 / 1000


def lookup(left: DataFrame, right: DataFrame, left_key: str, right_key: str, right_cols: list[str]) -> DataFrame:
    """left with right_cols of the row of right whose right_key (unique) equals left_key; null where there is none.

    Keys that hold over HOT_SHARE of left's rows are fewer than 1 / HOT_SHARE, so their rows of right are
    broadcast; all other keys meet by a shuffle. left is read three times: pass a stashed table.
    """
    total = left.count()
    hot = left.groupBy(F.col(left_key).alias("__hot")).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > total * HOT_SHARE).select("__hot")
    hot = stash(hot.filter("__hot IS NOT NULL"), "hot-keys")
    side = right.select(F.col(right_key).alias("__rk"), *right_cols)
    few = stash(side.join(F.broadcast(hot), F.col("__rk") == F.col("__hot"), "left_semi"), "hot-rows")
    often = left.join(F.broadcast(hot), F.col(left_key) == F.col("__hot"), "left_semi").join(F.broadcast(few), F.col(left_key) == F.col("__rk"), "left")
    rare = left.join(F.broadcast(hot), F.col(left_key) == F.col("__hot"), "left_anti").join(side, F.col(left_key) == F.col("__rk"), "left")
    return often.unionByName(rare).drop("__rk")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for every node of an edge, the smallest node that its edges reach.

    Large-star and small-star steps: every node links its larger neighbours to its smallest one, then its smaller
    neighbours to the smallest; stars with the smallest node at their centre remain. Each round is written to the
    shared folder. Loops and repeated edges are allowed.
    """
    e = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter("u < v").distinct()
    loops = edges.filter(F.col(a) == F.col(b)).select(F.col(a).alias("node")).distinct()
    e = stash(e, "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, F.col("u") == F.col("n")).select(F.col("m").alias("u"), "v").filter("u < v").distinct()
        large = stash(large, "large-star")
        least = large.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("n"), "m")
        small = large.join(least, F.col("v") == F.col("n")).select("u", "v", "m")
        small = small.select(F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("v").alias("v")), F.struct(F.col("m").alias("u"), F.col("u").alias("v")))).alias("x"))
        e = stash(small.select("x.u", "x.v").filter("u < v").distinct(), "small-star")
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    nodes = e.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(e.select(F.col("u").alias("node"), F.col("u").alias("component")))
    nodes = nodes.unionByName(loops.select("node", F.col("node").alias("component")))
    return nodes.groupBy("node").agg(F.min("component").alias("component"))
