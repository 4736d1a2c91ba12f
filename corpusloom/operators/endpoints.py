"""Service endpoints in texts: matches with context, noise rules, review decisions."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import any_of, match_offsets, strip
from .classify import is_knowledge_eligible, is_reference

ITEM = "array<struct<itemType:string,keyName:string,value:string,envHint:string,serverHint:string,confidence:double>>"


def trim_trailing_punct(value: Column) -> Column:
    return F.regexp_replace(value, r"[`'\"\\,);|]+$", "")


def plausible_ip(value: Column) -> Column:
    """Four numbers up to 255, and a port or a private network."""
    parts = F.transform(F.split(F.split_part(value, F.lit(":"), F.lit(1)), r"\."), lambda p: p.try_cast("int"))
    ok = (F.size(parts) == 4) & F.coalesce(F.forall(parts, lambda p: p.between(0, 255)), F.lit(False))
    a, b = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    private = (a == 10) | (a == 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
    return ok & (F.contains(value, F.lit(":")) | private)


def endpoint_noise(kind: Column, value: Column) -> Column:
    """Templates, documentation sites, words that are no hosts, numbers that are no addresses."""
    low = F.lower(value)
    host = F.split_part(low, F.lit(":"), F.lit(1))
    return (
        (F.length(value) < 3) | any_of(low, rules.VALUE_MARKERS) | ((kind == "URL") & any_of(low, rules.DOC_DOMAINS))
        | ((kind == "HOST_PORT") & (host.isin(*rules.HOST_BLACKLIST) | F.rlike(host, F.lit(r"^\d+$")))) | ((kind == "IP_PORT") & ~plausible_ip(value))
    )


def example_context(context: Column, value: Column) -> Column:
    """Is the text around a value an example? Words of real deployments overrule example words."""
    low, v = F.lower(F.coalesce(context, F.lit(""))), F.lower(value)
    real = any_of(low, rules.REAL_MARKERS)
    private = F.startswith(v, F.lit("192.168.")) | F.startswith(v, F.lit("10.")) | F.startswith(v, F.lit("172."))
    return F.when(real, False).when(any_of(low, rules.EXAMPLE_MARKERS), True).otherwise(private & any_of(low, rules.REPLACE_MARKERS))


def _in_example(lead: Column, context: Column) -> Column:
    """Does a fence with lead before it hold an example, or the value's context name one?"""
    return any_of(F.lower(lead), ["api", "example", "sample", "demo"]) | any_of(F.lower(context), ["example-host", "/mock/", "/demo"])


def example_code_block(text: Column, start: Column, context: Column) -> Column:
    """Does the value at one place of a text stand in a code fence of an example? For many places of a text see
    extract_endpoints, which looks at its fences once."""
    before = F.substring(text, F.lit(1), start)
    parts = F.split(before, "```")
    fences = F.size(parts) - 1
    opened = F.length(before) - F.length(F.element_at(parts, -1)) - 3
    lead = F.substring(before, F.greatest(opened - 159, F.lit(1)), F.least(opened, F.lit(160)))
    return (fences % 2 == 1) & _in_example(lead, context)


def _around(before: Column, value: Column, after: Column, limit: int = 512) -> Column:
    head = r"\n#{1,3} "
    before = F.regexp_replace(before, rf"(?s)^.*(?={head})", "")
    after = F.regexp_replace(after, rf"(?s){head}.*$", "")
    return F.substring(strip(F.replace(F.concat(before, value, after), F.lit("\n"), F.lit(" "))), 1, limit)


def endpoint_context(text: Column, start: Column, size: Column, around: int = 80, limit: int = 512) -> Column:
    """`around` characters on both sides, not beyond headings of the first three levels."""
    before = F.substring(text, F.greatest(start - around + 1, F.lit(1)), F.least(start, F.lit(around)))
    return _around(before, F.substring(text, start + 1, size), F.substring(text, start + size + 1, F.lit(around)), limit)


#: Characters of a block of a text. A stretch of characters is taken from the blocks that it lies in, as finding a place
#: in a whole text takes a pass from its start.
BLOCK = 256


def _stretch(blocks: Column, start: Column, end: Column) -> Column:
    """Characters start to end (behind the last one) of a text in blocks; what lies outside of the text is left out."""
    start = F.greatest(start, F.lit(0))
    first, last = F.floor(start / BLOCK).cast("int"), F.floor(F.greatest(end - 1, start) / BLOCK).cast("int")
    return F.when(end > start, F.substring(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""), start - first * BLOCK + 1, end - start)).otherwise("")


def _match_events(found: Column, n: int, kind: str, pattern: str, group: int, around: int) -> Column:
    """An event for each of a pattern's matches (match_offsets), with the characters around it."""
    blocks = F.col("__blocks")

    def row(x: Column) -> Column:
        value = F.regexp_extract(x["match"], pattern, group) if group else x["match"]
        end = x["start"] + F.length(x["match"])
        return F.struct(
            x["start"].alias("place"), F.lit(n).alias("pattern_no"), F.lit(kind).alias("key_type"), trim_trailing_punct(strip(value)).alias("key_value"), F.length(x["match"]).alias("size"),
            _stretch(blocks, x["start"] - around, x["start"]).alias("before"), x["match"].alias("match"), _stretch(blocks, end, end + around).alias("after"),
        )

    return F.transform(found, row)


def _fence_events(found: Column) -> Column:
    """An event for each code fence, at the place behind it, with what stands before it."""
    none = F.lit(None).cast("string")

    def row(x: Column) -> Column:
        lead = _stretch(F.col("__blocks"), x["start"] - 160, x["start"])
        return F.struct((x["start"] + 3).alias("place"), F.lit(-1).alias("pattern_no"), none.alias("key_type"), none.alias("key_value"), F.lit(3).alias("size"), lead.alias("before"), none.alias("match"), none.alias("after"))

    return F.transform(found, row)


def endpoint_matches(texts: DataFrame, key: str = "file_id", text: str = "text", around: int = 80) -> DataFrame:
    """(key, pattern_no, key_type, key_value, start, size, context, lead) of every match of every pattern; start and size
    tell where the whole match is. lead is what stands before the code fence that the match lies in, null outside.

    A sweep over each text's events (matches and fences by place): a running count tells if a fence is open, and the
    last one's lead goes along. Texts don't move with their matches."""
    t = F.col("__t")
    # texts without any endpoint leave early: no offsets are counted for them
    likely = texts.filter(F.rlike(F.col(text), F.lit(r"://|\d\.\d|(?i)host|server|addr|broker|endpoint")))
    numbered = likely.select(F.col(key), F.col(text).alias("__t"), F.monotonically_increasing_id().alias("__row"))
    found = {f"__m{n}": match_offsets(t, rule[1]) for n, rule in enumerate(rules.ENDPOINTS)}
    some = F.greatest(*(F.size(c) for c in found)) > 0
    cut = numbered.withColumns(found).filter(some).withColumns({"__blocks": F.regexp_extract_all(t, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0)), "__fences": match_offsets(t, "```")})
    events = F.concat(*(_match_events(F.col(f"__m{n}"), n, *rule, around) for n, rule in enumerate(rules.ENDPOINTS)), _fence_events(F.col("__fences")))
    rows = cut.select(key, "__row", F.explode(events).alias("e")).select(key, "__row", "e.*")
    w = Window.partitionBy("__row").orderBy("place", "pattern_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fence = F.col("pattern_no") == -1
    swept = rows.withColumn("__open", F.count_if(fence).over(w) % 2 == 1).withColumn("__lead", F.last(F.when(fence, F.col("before")), ignorenulls=True).over(w))
    context = _around(F.col("before"), F.col("match"), F.col("after"))
    return swept.filter(~fence).select(key, "pattern_no", "key_type", "key_value", F.col("place").alias("start"), "size", context.alias("context"), F.when(F.col("__open"), F.col("__lead")).alias("lead"))


def extract_endpoints(texts: DataFrame, key: str = "file_id", text: str = "text") -> DataFrame:
    """(key, key_type, key_value, context, pattern_no, start) of all matches that are neither noise nor examples, once
    for each file, type and value (the first by pattern, then place)."""
    row = endpoint_matches(texts, key, text).filter(~endpoint_noise(F.col("key_type"), F.col("key_value")))
    fenced = F.col("lead").isNotNull() & _in_example(F.col("lead"), F.col("context"))
    row = row.filter(~example_context(F.col("context"), F.col("key_value")) & ~fenced)
    return dedupe_first(row.drop("lead", "size"), key)


def dedupe_first(items: DataFrame, key: str = "file_id") -> DataFrame:
    w = Window.partitionBy(key, "key_type", "key_value").orderBy("pattern_no", "start")
    return items.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def extract_scope(files: DataFrame) -> DataFrame:
    """Files to extract from: documents and configurations that are eligible, or references about real deployments."""
    real = is_reference(F.col("status")) & any_of(F.lower(F.coalesce(F.col("text"), F.lit(""))), rules.REAL_MARKERS)
    return files.filter(F.col("category").isin("doc", "config") & (is_knowledge_eligible(F.col("status")) | real))


def carry_review_decisions(items: DataFrame, before: DataFrame) -> DataFrame:
    """items with the review_status that the same file, type and value had; PENDING for new ones."""
    old = before.filter(F.col("review_status").isin("CONFIRMED", "REJECTED")).groupBy("file_id", "key_type", "key_value").agg(F.max("review_status").alias("__old"))
    return items.join(old, ["file_id", "key_type", "key_value"], "left").withColumn("review_status", F.coalesce("__old", F.lit("PENDING"))).drop("__old")


def refine_with_model_output(items: DataFrame, outputs: DataFrame) -> DataFrame:
    """items that a model's answer for their context confirms (items_json: a list of ITEM), or whose context is a real
    deployment; all items of files for which the answers hold no value."""
    values = F.transform(F.from_json("items_json", ITEM), lambda x: F.lower(x["value"]))
    parsed = outputs.select("file_id", "context", F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.length(v) > 0).alias("values"))
    by = parsed.groupBy("file_id", "context").agg(F.flatten(F.collect_list("values")).alias("values"))
    any_ = parsed.groupBy("file_id").agg(F.sum(F.size("values")).alias("total"))
    v = F.lower("key_value")
    agreed = F.coalesce(F.exists("values", lambda x: F.contains(x, v) | F.contains(v, x)), F.lit(False))
    j = items.join(by, ["file_id", "context"], "left").join(any_, "file_id", "left")
    return j.filter((F.coalesce("total", F.lit(0)) == 0) | agreed | any_of(F.lower("context"), rules.REAL_MARKERS)).drop("values", "total")


def config_stats(items: DataFrame) -> DataFrame:
    return items.groupBy("key_type").agg(F.count(F.lit(1)).alias("n"))


def config_list(items: DataFrame, kind: str | None = None, status: str | None = None, page: int = 0, size: int = 20) -> DataFrame:
    out = items.filter(F.col("key_type") == kind) if kind else items
    out = out.filter(F.col("review_status") == status) if status else out
    return out.orderBy("key_type", "key_value", "file_id").offset(page * size).limit(size)


def bulk_review(items: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """items with review_status set for those in ids (file_id, key_type, key_value)."""
    hit = ids.select("file_id", "key_type", "key_value").distinct().withColumn("__hit", F.lit(True))
    return items.join(hit, ["file_id", "key_type", "key_value"], "left").withColumn("review_status", F.when(F.col("__hit"), status).otherwise(F.col("review_status"))).drop("__hit")


