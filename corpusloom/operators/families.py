"""Files that are versions of one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules


def normalize_doc_name(name: Column) -> Column:
    """A file name without extension, version, date, version words and '(n)'; separators become spaces."""
    s = F.regexp_replace(F.coalesce(name, F.lit("")), r"\.[^.]+$", "")
    s = F.regexp_replace(F.regexp_replace(s, rules.VERSION, ""), rules.DATE, "")
    s = F.regexp_replace(s, r"(?i)[_\-\s]*(?:" + "|".join(rules.SUFFIXES) + ")", "")
    s = F.regexp_replace(s, r"[\(（]\d+[\)）]", "")
    return F.lower(F.trim(F.regexp_replace(s, r"[_\-\s]+", " ")))


def version_label(name: Column) -> Column:
    """The first of: version number, date, version word; null if there is none."""
    base = F.regexp_replace(name, r"\.[^.]+$", "")
    hit = lambda p: F.nullif(F.trim(F.regexp_extract(base, p, 0)), F.lit(""))
    return F.coalesce(hit(r"[Vv]\d+(\.\d+)*"), hit(r"\b20\d{6}\b"), hit("|".join(rules.LABEL_SUFFIXES)))


def doc_families(files: DataFrame, key: Column | None = None) -> DataFrame:
    """(project, family, file_count, doc_type, effective_file_id): two or more live documents of one name; the most
    common type, and the file changed last (of equals the smallest id)."""
    k = normalize_doc_name(F.col("name")) if key is None else key
    live = files.filter("NOT deleted AND category = 'doc'").withColumn("family", k).filter("family != ''")
    types = live.filter("doc_type IS NOT NULL").groupBy("project", "family", "doc_type").agg(F.count(F.lit(1)).alias("n")).groupBy("project", "family").agg(F.min_by("doc_type", F.struct(-F.col("n"), "doc_type")).alias("doc_type"))
    by = live.groupBy("project", "family").agg(F.count(F.lit(1)).alias("file_count"), F.max_by("file_id", F.struct("mtime", -F.col("file_id"))).alias("effective_file_id")).filter("file_count >= 2")
    return by.join(types, ["project", "family"], "left").select("project", "family", "file_count", "doc_type", "effective_file_id")


def family_assign(files: DataFrame, families: DataFrame, key: Column | None = None) -> DataFrame:
    """files with family and version_label; both null for files without a family."""
    k = normalize_doc_name(F.col("name")) if key is None else key
    f = families.select("project", F.col("family").alias("__f"))
    j = files.withColumn("__k", F.when(F.expr("NOT deleted AND category = 'doc'"), k)).join(f.withColumnRenamed("project", "__p"), (F.col("project") == F.col("__p")) & (F.col("__k") == F.col("__f")), "left")
    return j.withColumn("family", F.col("__f")).withColumn("version_label", F.when(F.col("__f").isNotNull(), version_label(F.col("name")))).drop("__k", "__f", "__p")


def family_list(families: DataFrame, page: int = 0, size: int = 20) -> DataFrame:
    return families.orderBy(F.desc("file_count"), "family", "project").offset(page * size).limit(size)


def family_members(files: DataFrame, families: DataFrame) -> DataFrame:
    """(family, file_id, place, is_effective): members by last change."""
    j = files.filter("family IS NOT NULL").join(families.select("project", "family", "effective_file_id"), ["project", "family"])
    w = Window.partitionBy("project", "family").orderBy(F.desc("mtime"), "file_id")
    return j.select("project", "family", "file_id", F.row_number().over(w).alias("place"), (F.col("file_id") == F.col("effective_file_id")).alias("is_effective"))
