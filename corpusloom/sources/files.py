"""Listing, filtering and reading files; tabular rows and web pages as text; table sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import strip


def enumerate_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, mtime) of all files below root; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"))


def file_totals(files: DataFrame, large: int = 256 << 20) -> DataFrame:
    """One row: n_files, n_bytes, n_large."""
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("n_bytes"), F.count_if(F.col("size") >= large).alias("n_large"))


def ignore_rules(spark: SparkSession, extra: Sequence[str] = ()) -> DataFrame:
    """(rule) of the built-in and extra rules; '#' comments and refused rules are left out."""
    kept = [r.strip() for r in extra if r.strip() and not r.strip().startswith("#") and r.strip() not in rules.REFUSED]
    return spark.createDataFrame([(r,) for r in dict.fromkeys([*rules.IGNORED, *kept])], "rule string")


def ignore_filter(files: DataFrame, rule_rows: DataFrame, path: str = "rel_path") -> DataFrame:
    """files that no rule hits. 'x/' is a directory anywhere, '*.x' a suffix, '~$*' a prefix of the name, other rules
    equal the name in any case or occur in it. Rules are a short list kept by people, far below Spark's broadcast limit."""
    p, name, r = F.col(path), F.element_at(F.split(F.col(path), "/"), -1), F.col("__rule")
    d, suffix = F.expr("substring(__rule, 1, length(__rule) - 1)"), F.lower(F.expr("substring(__rule, 2)"))
    hit = (
        F.when(F.endswith(r, F.lit("/")), F.startswith(p, F.concat(d, F.lit("/"))) | F.contains(p, F.concat(F.lit("/"), d, F.lit("/"))))
        .when(F.startswith(r, F.lit("*.")), F.endswith(F.lower(p), suffix))
        .when(F.startswith(r, F.lit("~$")), F.startswith(name, F.lit("~$")))
        .otherwise((F.lower(name) == F.lower(r)) | F.contains(name, r))
    )
    return files.join(rule_rows.withColumnRenamed("rule", "__rule"), hit, "left_anti")


def file_ext(name: Column) -> Column:
    """What follows the last dot, unless the dot comes first or last; lower case."""
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]+)$", 1))


def file_category(ext: Column, categories: Mapping[str, Sequence[str]] = rules.CATEGORIES) -> Column:
    out = F.lit("other")
    for name, exts in categories.items():
        out = F.when(ext.isin(*exts), name).otherwise(out)
    return out


def parent_dir(path: Column) -> Column:
    """The path before the last slash, '.' where there is none."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def dir_label(directory: Column) -> Column:
    return F.when(directory == ".", "[root]").otherwise(F.element_at(F.split(directory, "/"), -1))


def html_page_text(html: Column) -> Column:
    """Visible text, a line for each block; headings start with '#'."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<(script|style|head)\b.*?</\1\s*>", "")
    for n in range(1, 7):
        out = F.regexp_replace(out, rf"(?i)<h{n}\b[^>]*>", "\n" + "#" * n + " ")
    out = F.regexp_replace(out, r"(?i)<(?:br|/?(?:p|div|li|ul|ol|tr|table|section|article|nav|footer|header|h[1-6]))\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", "")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return strip(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r" ?\n[ \n]*", "\n"))


CSP = "<meta http-equiv=\"Content-Security-Policy\" content=\"default-src 'none'; style-src 'unsafe-inline'; img-src data:\">"


def html_sanitize(html: Column) -> Column:
    """Without scripts, embedded objects, event handlers and script links; with a content policy in the head."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script\b.*?</script\s*>", "")
    out = F.regexp_replace(out, r"(?is)</?(?:iframe|object|embed|link)\b[^>]*>", "")
    out = F.regexp_replace(out, r"(?is)\son[a-z]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "")
    out = F.regexp_replace(out, r"(?i)javascript:", "")
    return F.when(F.instr(out, "<head>") > 0, F.replace(out, F.lit("<head>"), F.lit("<head>" + CSP))).otherwise(F.concat(F.lit(CSP), out))


def clean_text_noise(text: Column, least: int = 50) -> Column:
    """Cuts at the first package part named behind place `least`; drops lines of package paths, media, base64 and
    field codes; runs of spaces become one."""
    places = F.array(*(F.instr(text, m) for m in rules.PACKAGE_PARTS))
    cut = F.array_min(F.filter(places, lambda x: x - 1 > least))
    body = F.when(cut.isNotNull(), F.substring(text, F.lit(1), cut - 1)).otherwise(text)
    body = F.regexp_replace(body, r"\n+$", "")
    part = r"(?i)^(?:(?:docprops|word|customxml|xl|ppt|_rels)/.*\.xml|\[content_types\]\.xml|(?:word|xl|ppt)/media/.*)$"

    def noise(line: Column) -> Column:
        t = strip(line)
        return (t != "") & (F.rlike(t, F.lit(part)) | F.rlike(t, F.lit(r"^[A-Za-z0-9+/=]{81,}$")) | F.contains(t, F.lit("MERGEFORMAT")) | F.startswith(t, F.lit("Normal.dotm")) | F.contains(t, F.lit("WPS Office_")))

    kept = F.filter(F.split(body, "\n"), lambda x: ~noise(x))
    kept = F.transform(kept, lambda x: F.when(strip(x) == "", "").otherwise(F.regexp_replace(x, " {2,}", " ")))
    joined = F.concat(F.array_join(kept, "\n"), F.lit("\n"))
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", text).when(F.size(kept) == 0, "").otherwise(joined)


def column_letters(n: int) -> str:
    """1 is A, 27 is AA."""
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def rows_to_evidence(rows: DataFrame, columns: Sequence[str], sheet: str, order: Sequence[str], limit: int | None = 3000) -> DataFrame:
    """(row_no, cell_range, content) of rows in order: '[Sheet!A1:C1] a | b | c'. Rows without any value are left out,
    and those after the first `limit` of the sheet (the sheet's cap, None for none).

    Row numbers come from a sort and one number for each partition, so no task holds the sheet."""
    values = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    cap = [F.col("row_no") <= limit] if limit else [F.lit(True)]
    numbered = number_rows(rows, order, "row_no").filter(cap[0])
    span = F.concat(F.lit(f"[{sheet}!A"), F.col("row_no").cast("string"), F.lit(f":{column_letters(len(columns))}"), F.col("row_no").cast("string"), F.lit("]"))
    text = F.concat_ws(" | ", *values)
    return numbered.filter(F.concat_ws("", *values) != "").select("row_no", span.alias("cell_range"), F.concat(span, F.lit(" "), text).alias("content"))


def number_rows(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """rows with their place (from 1) in a global order. The last sort column should be unique."""
    from ..session import stash

    spread = stash(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "numbered")
    counts = spread.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return spread.withColumn("__in", inside).join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__in")).drop("__part", "__in", "__before")


def rank_in_groups(rows: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """rows with their place (from 1) among those of equal group, by order, which should be unique in a group.

    Rows are dealt by ranges of group and order together, so that a group of any size lies in many partitions. A row's
    place is its place in its partition and the number of its group's rows in earlier ones. A partition has at most one
    group that began before it, so these numbers are as many as partitions and are broadcast."""
    from ..session import stash

    spread = stash(rows.repartitionByRange(*group, *order).withColumn("__part", F.spark_partition_id()), "ranked")
    inside = F.row_number().over(Window.partitionBy("__part", *group).orderBy(*order))
    counts = spread.groupBy("__part", *group).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("__before", F.sum("__n").over(earlier)).filter("__before > 0")
    before = before.select(F.col("__part").alias("__g_part"), "__before", *(F.col(c).alias(f"__g_{c}") for c in group))
    same = F.col("__part") == F.col("__g_part")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    out = spread.withColumn("__in", inside).join(F.broadcast(before), same, "left")
    return out.withColumn(name, F.col("__in") + F.coalesce("__before", F.lit(0))).select(*rows.columns, name)


def cell_range_of(excerpt: Column) -> Column:
    """The first cell range named in an excerpt, without brackets; null where there is none."""
    return F.nullif(F.regexp_extract(excerpt, r"\[([^\[\]!]+![A-Z]+\d+:[A-Z]+\d+)\]", 1), F.lit(""))


def write_project_tables(df: DataFrame, path: str, partition: str = "project") -> None:
    """Replaces the partitions that df has rows of; other projects' rows stay."""
    df.write.partitionBy(partition).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
