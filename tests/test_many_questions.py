"""Tables of many questions: what is sent to every executor, and how many rows are made on the way to few."""

import random
import time

from pyspark.sql import functions as F

from corpusloom.operators import evidence
from corpusloom.session import stash


def sent_whole(df):
    """Runs df; is a table sent to all executors?"""
    df.write.format("noop").mode("overwrite").save()
    return "BroadcastExchange" in df._jdf.queryExecution().explainString(spark_mode(df))


def spark_mode(df):
    return df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")


def few_bytes(spark):
    """Questions whose files are much smaller than their texts, and entities that are not."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12))
    q = stash(spark.range(20_000).select(F.col("id").alias("question_id"), F.lit("is the blue ring good").alias("question")), "few-bytes")
    e = spark.createDataFrame([(word(), word(), word()) for _ in range(20_000)] + [("blue", "s", "d")], "name string, summary string, description string")
    return q, stash(e, "entities")


def with_threshold(spark, run):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "200k")
    try:
        return run()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_seed_entities_sends_no_questions(spark):
    q, e = few_bytes(spark)
    assert not with_threshold(spark, lambda: sent_whole(evidence.seed_entities(q, e)))
    assert evidence.seed_entities(q, e).filter("name = 'blue'").count() == 20_000


def test_seed_entities_alias_sends_no_questions(spark):
    q, e = few_bytes(spark)
    assert not with_threshold(spark, lambda: sent_whole(evidence.seed_entities_alias(q, e)))
    assert evidence.seed_entities_alias(q, e).filter("name = 'blue'").count() == 20_000


def test_local_relations(spark):
    rng = random.Random(2)
    name = lambda: rng.choice("abcdefg")
    rel = [(name(), name() if rng.random() < 0.9 else None, rng.choice("xy"), rng.choice([0.5, 1.0, 2.0, None])) for _ in range(150)]
    seeds = [(i, n) for i in range(20) for n in rng.sample("abcdefgh", 3)]
    got = evidence.local_relations(spark.createDataFrame(seeds, "question_id long, name string"), spark.createDataFrame(rel, "source string, target string, edge_type string, weight double"), most=5)
    want = []
    for i in range(20):
        own = {n for k, n in seeds if k == i}
        found = sorted({r for r in rel if r[0] in own or r[1] in own}, key=lambda r: (r[3] is None, -(r[3] or 0), r[0], r[1] or "", r[2]))
        want += [(i, *r, k) for k, r in enumerate(found[:5], 1)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_relations_of_a_name_of_many(spark):
    # 80 million relations of questions' seeds, of which 18 count for each question
    seeds = spark.range(20_000).select(F.col("id").alias("question_id"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("name"))
    rel = spark.range(2000).select(F.lit("a").alias("source"), F.lit("b").alias("target"), F.col("id").cast("string").alias("edge_type"), F.col("id").cast("double").alias("weight"))
    start = time.perf_counter()
    assert evidence.local_relations(seeds, rel).count() == 18 * 20_000
    assert time.perf_counter() - start < 20


def test_graph_facts_sends_no_seeds(spark):
    q, e = few_bytes(spark)
    seeds = stash(q.select("question_id", F.lit("blue").alias("name"), F.lit(1).alias("rank")), "seeds")
    rel = spark.createDataFrame([("blue", "ring", "x", 1.0)], "source string, target string, edge_type string, weight double")
    facts = evidence.graph_facts(seeds, e.withColumn("type", F.lit("t")), evidence.local_relations(seeds, rel).hint("merge"))
    assert not with_threshold(spark, lambda: sent_whole(facts.select("facts"))) and facts.count() == 20_000
