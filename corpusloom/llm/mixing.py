"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stash

WORD = r"[^\x20\x09-\x0D]+"
#: Bins for each unit of log odds, and parts of the bin in which a source's cut lies.
BINS, PARTS = 512, 4096


def word_count(text: Column) -> Column:
    """Runs of characters outside space and tab..carriage return; a null text has 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def magnitude(size: Column) -> Column:
    """Binary digits of a size: by how much the mix favours longer documents."""
    return F.length(F.bin(size))


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the parts alone, so that reruns agree."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_order(totals: DataFrame, source: str) -> DataFrame:
    """Adds __rank, the 0-based place of each source by code point with null last.

    Ranks come from range partitions and their counts, so no task holds all sources.
    """
    spread = stash(totals.repartitionByRange(F.col(source).isNull(), F.col(source)).withColumn("__part", F.spark_partition_id()), "mix-order")
    counts = spread.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(F.col(source).asc_nulls_last()))
    return spread.withColumn("__in", inside).join(before, "__part").withColumn("__rank", F.col("__before") + F.col("__in") - 1).drop("__part", "__in", "__before")


def source_targets(totals: DataFrame, source: str, weights: Sequence[float], budget: float, max_copies: float) -> DataFrame:
    """Adds target: shares of budget x all words by weight, none above max_copies x its source.

    What a full source cannot take goes to the others by weight until none is above its limit: target is
    min(limit, level x weight). Each round fixes the sources that the present level fills; only three sums
    reach the driver in a round.
    """
    ordered = source_order(totals, source)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("__rank") % len(weights) + 1).cast("int"))
    rows = stash(ordered.withColumn("__w", weight).withColumn("__limit", F.col("source_size") * float(max_copies)), "mix-weights")
    level, filled = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("__limit") <= F.col("__w") * level
        got = rows.agg(
            F.sum("source_size").alias("words"),
            F.sum(F.when(full, F.col("__limit")).otherwise(0.0)).alias("fixed"),
            F.sum(F.when(full, 0.0).otherwise(F.col("__w"))).alias("open"),
            F.count_if(full).alias("filled"),
        ).first()
        if not got["words"] or not got["open"]:
            break
        if got["filled"] == filled:
            break
        filled, level = got["filled"], (budget * got["words"] - got["fixed"]) / got["open"]
    share = F.lit(0.0) if level is None else F.least(F.col("__limit"), F.col("__w") * level)
    return rows.withColumn("target", share).select(source, "source_size", "target")


def pareto_mix(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    source: str = "source",
    size: Column | None = None,
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    budget: float = 1.5,
    max_copies: int = 2,
    favour: Column | None = None,
    seed: int = 0,
) -> DataFrame:
    """Which documents a mix takes, and how often.

    Returns (key, source, size, source_size, target, copies, taken), a row for each row of docs. A source's
    expected number of copies of a row is rate x favour (1 where favour is None), at most max_copies, with the
    rate that reaches its target. The whole part of it is certain. The rest is an inclusion probability p: rows
    are ranked by random odds u / (1 - u) over inclusion odds p / (1 - p), and the first ones up to the words
    still wanted get one more copy (the last one if its middle word is within them).

    Sizes are words by default. Null texts have size 0; null sources form a source of their own, last in order;
    null favour counts as 0. Rows with equal key and size are tied and share one decision. An empty table gives
    an empty result. Other columns of docs are not read, so their names do not matter.
    """
    size = word_count(F.col("text")) if size is None else size
    # the random number depends on key and size only: rows that repeat a key with another text are told apart
    base = docs.select(
        F.col(key).alias("__key"),
        F.col(source).alias("__src"),
        F.coalesce(size.cast("long"), F.lit(0)).alias("__size"),
        (F.lit(1.0) if favour is None else F.coalesce(favour.cast("double"), F.lit(0.0))).alias("__fav"),
    )
    rows = stash(base, "mix-rows")
    totals = rows.groupBy("__src").agg(F.sum("__size").alias("source_size"))
    targets = source_targets(totals, "__src", weights, budget, max_copies).withColumnRenamed("__src", "__tsrc")
    rates = stash(_rates(rows, targets, float(max_copies), favour is not None), "mix-rates")
    ranked = _ranked(rows, rates, float(max_copies), seed)
    cuts = stash(_cuts(ranked), "mix-cuts").withColumnRenamed("__src", "__csrc")
    out = ranked.join(cuts, F.col("__src").eqNullSafe(F.col("__csrc")), "left")
    copies = F.col("__sure") + F.when((F.col("__p") > 0) & (F.col("__q") <= F.col("__cut")), 1).otherwise(0)
    return out.select(
        F.col("__key").alias(key), F.col("__src").alias(source), F.col("__size").alias("size"), "source_size", "target",
        copies.cast("long").alias("copies"), (copies * F.col("__size")).cast("long").alias("taken"),
    )


def _rates(rows: DataFrame, targets: DataFrame, limit: float, uneven: bool) -> DataFrame:
    """targets with __rate, the number for which min(limit, rate x favour) copies of each row make up the target."""
    if not uneven:
        return targets.withColumn("__rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    rates = targets.withColumn("__rate", F.lit(0.0)).withColumn("__filled", F.lit(-1).cast("long"))
    while True:
        # rows that the present rate fills stay full, as rates only grow; without new ones the rate is found
        full = F.col("__rate") * F.col("__fav") >= limit
        sums = (
            rows.join(rates, F.col("__src").eqNullSafe(F.col("__tsrc")))
            .groupBy("__tsrc", "source_size", "target", "__rate", "__filled")
            .agg(F.sum(F.when(full, F.col("__size") * limit).otherwise(0.0)).alias("fixed"), F.sum(F.when(full, 0.0).otherwise(F.col("__size") * F.col("__fav"))).alias("open"), F.count_if(full).alias("full"))
        )
        moved = (F.col("full") > F.col("__filled")) & (F.col("open") > 0)
        new = F.when(moved, F.greatest(F.col("__rate"), (F.col("target") - F.col("fixed")) / F.col("open"))).otherwise(F.col("__rate"))
        found = stash(sums.select("__tsrc", "source_size", "target", new.alias("__rate"), F.col("full").alias("__filled"), moved.alias("__moved")), "mix-rate")
        rates = found.drop("__moved")
        if found.filter("__moved").isEmpty():
            return rates.drop("__filled")


def _ranked(rows: DataFrame, rates: DataFrame, limit: float, seed: int) -> DataFrame:
    copies = F.least(F.lit(limit), F.col("__rate") * F.col("__fav"))
    u = uniform(F.lit(seed), F.col("__key"), F.col("__size"))
    joined = rows.join(rates, F.col("__src").eqNullSafe(F.col("__tsrc"))).withColumn("__e", copies)
    joined = joined.withColumn("__sure", F.floor("__e")).withColumn("__p", F.col("__e") - F.floor("__e")).withColumn("__u", u)
    odds = (F.col("__u") / (1 - F.col("__u"))) / (F.col("__p") / (1 - F.col("__p")))
    return joined.withColumn("__q", F.when(F.col("__p") > 0, odds))


def _cuts(ranked: DataFrame) -> DataFrame:
    """(__src, __cut): the rank odds up to which a source's rows get one more copy.

    Words are summed by bin of log odds, then by part of the bin in which the wanted words run out, then by
    row in that part. No step gathers a source's rows: bins and parts are of fixed number.
    """
    z = F.floor(F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.log("__q"))) * BINS)
    fine = F.floor((F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.log("__q"))) * BINS - z) * PARTS)
    open_rows = ranked.filter("__p > 0").select("__src", "__size", "__q", z.alias("__z"), fine.alias("__f"))
    wanted = ranked.groupBy("__src").agg(F.first("target").alias("target"), F.sum(F.col("__sure") * F.col("__size")).alias("sure"))
    wanted = stash(wanted.select(F.col("__src").alias("__wsrc"), (F.col("target") - F.col("sure")).alias("__want")), "mix-wanted")
    best = None
    edge = wanted.select(F.col("__wsrc").alias("__src"), F.lit(0).cast("long").alias("__before"), "__want")
    keys: list[str] = []
    for level in ("__z", "__f", "__q"):
        # rows of the present edge, summed by the next finer level
        e = edge.select(F.col("__src").alias("__esrc"), "__before", "__want", *(F.col(k).alias(f"__e{k}") for k in keys))
        on = F.col("__src").eqNullSafe(F.col("__esrc"))
        for k in keys:
            on = on & (F.col(k) == F.col(f"__e{k}"))
        sums = open_rows.join(e, on).groupBy("__src", *keys, level, "__before", "__want").agg(F.sum("__size").alias("__n"), F.max("__q").alias("__top"))
        w = Window.partitionBy("__src").orderBy(level)
        cum = sums.withColumn("__cum", F.col("__before") + F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        level_rows = stash(cum, "mix-level")
        fits = F.col("__cum") - F.col("__n") / 2 <= F.col("__want") if level == "__q" else F.col("__cum") <= F.col("__want")
        taken = level_rows.filter(fits).select("__src", F.col("__top").alias("__cut"))
        best = taken if best is None else best.unionByName(taken)
        if level != "__q":
            first = F.row_number().over(w)
            edge = level_rows.filter(~fits).withColumn("__first", first).filter("__first = 1")
            edge = edge.select("__src", *keys, level, (F.col("__cum") - F.col("__n")).alias("__before"), "__want")
            keys.append(level)
    return best.groupBy("__src").agg(F.max("__cut").alias("__cut"))


def repeat_taken(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as pareto_mix takes it; the columns of docs, nothing else.

    Rows meet their decisions by key and size, which is all that a decision depends on besides the source.
    """
    key, source = options.get("key", "doc_id"), options.get("source", "source")
    size = options.get("size")
    size = word_count(F.col("text")) if size is None else size
    plan = pareto_mix(docs, **options).filter("copies > 0")
    plan = plan.groupBy(F.col(key).alias("__k"), F.col(source).alias("__s"), F.col("size").alias("__n")).agg(F.max("copies").alias("__c"))
    on = F.col(key).eqNullSafe(F.col("__k")) & F.col(source).eqNullSafe(F.col("__s")) & (F.col("__size") == F.col("__n"))
    out = docs.withColumn("__size", F.coalesce(size.cast("long"), F.lit(0))).join(plan, on)
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__c")))).select(*(F.col(f"`{c}`") for c in docs.columns))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS wt, 2.0 * source_size AS lim FROM t),
o AS (SELECT *, row_number() OVER (ORDER BY lim / wt, source NULLS LAST) AS k,
        sum(lim) OVER (ORDER BY lim / wt, source NULLS LAST ROWS UNBOUNDED PRECEDING) - lim AS fixed,
        sum(wt) OVER (ORDER BY lim / wt DESC, source DESC NULLS FIRST ROWS UNBOUNDED PRECEDING) AS open_w,
        sum(source_size) OVER () AS total FROM w),
l AS (SELECT arg_min((1.5 * total - fixed) / open_w, k) AS lev FROM o WHERE (1.5 * total - fixed) / open_w <= lim / wt),
g AS (SELECT source, source_size, CAST(CASE WHEN total = 0 THEN 0 ELSE least(lim, wt * lev) END AS DOUBLE) AS target FROM o, l),
f AS (SELECT d.*, g.source_size, g.target, CAST(length(bin(d.size)) AS BIGINT) AS fav FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
s AS (SELECT source, any_value(target) AS target, fav, sum(size) AS n, sum(size * fav) AS nf FROM f GROUP BY source, fav),
r AS (SELECT source, fav, target, coalesce(sum(2.0 * n) OVER (PARTITION BY source ORDER BY fav DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fixed,
        sum(nf) OVER (PARTITION BY source ORDER BY fav ROWS UNBOUNDED PRECEDING) AS open_nf FROM s),
x AS (SELECT source, arg_max((target - fixed) / nullif(open_nf, 0), fav) AS rate FROM r WHERE coalesce((target - fixed) / nullif(open_nf, 0) * fav, 0) < 2 GROUP BY source),
e AS (SELECT f.*, coalesce(least(2.0, x.rate * fav), CASE WHEN f.source_size > 0 THEN 2.0 ELSE 0 END) AS e,
        (CAST(('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(size AS VARCHAR)), 1, 12)) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
      FROM f LEFT JOIN x ON f.source IS NOT DISTINCT FROM x.source),
q AS (SELECT *, floor(e) AS sure, e - floor(e) AS p, CASE WHEN e - floor(e) > 0 THEN (u / (1 - u)) / ((e - floor(e)) / (1 - (e - floor(e)))) END AS q FROM e),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q NULLS LAST) AS cum, sum(size) OVER (PARTITION BY source, q) AS n,
        target - sum(sure * size) OVER (PARTITION BY source) AS want FROM q)
SELECT doc_id, size, source_size, target, CAST(size * (sure + CASE WHEN p > 0 AND cum - n / 2 <= want THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c
"""
