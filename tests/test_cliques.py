"""Label propagation on many small groups."""

import os

from pyspark.sql import functions as F

from corpusloom.operators import graph
from corpusloom.session import shared_dir


def test_all_of_many_cliques_settle(spark):
    # after 12 half-steps some of so many groups are still unsettled
    node = spark.range(20_000).select("id", F.explode(F.sequence(F.lit(0), 1 + F.col("id") % 6)).alias("k"))
    n = node.select("id", (F.col("id") * 10 + F.col("k")).alias("node"))
    e = n.select("id", F.col("node").alias("source")).join(n.select("id", F.col("node").alias("target")), "id").filter("source < target").select("source", "target")
    names = lambda: {x for x in os.listdir(shared_dir(spark).removeprefix("file://")) if x.startswith("labels-")}
    before = names()
    found = graph.label_propagation(e, max_iter=6)
    # of the steps' tables the last one is left
    assert len(names() - before) == 1
    groups = found.join(n, "node").groupBy("id").agg(F.count_distinct("label").alias("labels"), F.min("label").alias("low"), F.bool_and("converged").alias("c"))
    assert groups.agg(F.max("labels"), F.bool_and("c"), F.count_distinct("low")).first() == (1, True, 20_000)
