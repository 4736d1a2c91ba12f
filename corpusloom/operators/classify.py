"""Document types, tags and relevance of files to projects, from rules given as data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import any_of

TEXT_LIMIT, SCORE_LIMIT, PHRASE_LIMIT = 4000, 12000, 5000


def doc_type(path: Column, text: Column, ext: Column, ladder: Sequence[tuple[str, Sequence[str]]] = tuple(rules.DOC_TYPES)) -> Column:
    """The first group of needles in path and the first TEXT_LIMIT characters, else by extension."""
    hay = F.lower(F.concat_ws("\n", path, F.substring(text, F.lit(1), F.lit(TEXT_LIMIT))))
    out = F.when(ext.isin(*rules.DOC_TYPE_CONFIG[1]), rules.DOC_TYPE_CONFIG[0]).when(ext.isin(*rules.DOC_TYPE_TEXT[1]), rules.DOC_TYPE_TEXT[0]).otherwise(rules.DOC_TYPE_OTHER)
    for label, needles in reversed(list(ladder)):
        out = F.when(any_of(hay, [n.lower() for n in needles]), label).otherwise(out)
    return out


def doc_tags(path: Column, text: Column, summary: Column, tags: Sequence[tuple[str, Sequence[str]]] = tuple(rules.TAGS)) -> Column:
    """Tags whose needles occur in path, text or summary, in the rules' order; null when there is none."""
    hay = F.lower(F.concat_ws("\n", path, text, summary))
    found = F.array_compact(F.array(*(F.when(any_of(hay, [n.lower() for n in needles]), label) for label, needles in tags)))
    return F.when(F.size(found) > 0, found)


def normal(text: Column) -> Column:
    """Lower case, letters and digits of any script only."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, rules.PROJECT_SUFFIX, "")


def _useful(a: Column, generic: Sequence[str]) -> Column:
    words = F.array(*(F.lit(g) for g in generic))
    suffix = F.rlike(a, F.lit(rules.PROJECT_SUFFIX))
    return (F.length(a) >= 3) & ~F.array_contains(words, a) & ~F.rlike(a, F.lit(r"^\d+$")) & (~suffix | ((F.length(a) >= 5) & ~F.array_contains(words, _bare(a))))


def project_anchors(projects: DataFrame, generic: Sequence[str] = tuple(rules.GENERIC_WORDS)) -> DataFrame:
    """(project, anchor, strong): words by which texts name a project (project, code, name, root_path)."""
    name = normal(F.col("name"))
    leaf = normal(F.regexp_replace(F.element_at(F.split(F.coalesce(F.col("root_path"), F.lit("")), r"[/\\]"), -1), r"^\d+", ""))

    def derived(text: Column) -> tuple[Column, Column]:
        phrases = F.regexp_extract_all(text, F.lit(rules.PROJECT_PHRASE), F.lit(0))
        parts = F.concat(F.filter(F.split(text, rules.PROJECT_SPLIT), lambda s: F.length(s) >= 3), F.array(text))
        tails = F.flatten(F.transform(parts, lambda s: F.transform(F.sequence(F.lit(4), F.lit(8)), lambda n: F.when(F.length(s) >= n, F.right(s, n)))))
        return F.concat(phrases, F.transform(phrases, _bare), parts, tails), F.transform(parts, lambda s: F.when(F.length(s) >= 3, F.right(s, F.lit(3))))

    (s1, w1), (s2, w2) = derived(name), derived(leaf)
    keep = lambda x: F.filter(F.array_distinct(x), lambda a: a.isNotNull() & _useful(a, generic))
    strong = projects.select("project", F.explode(keep(F.concat(F.array(name, leaf), s1, s2))).alias("anchor"), F.lit(True).alias("strong"))
    weak = projects.select("project", F.explode(keep(F.concat(F.array(normal(F.col("code"))), w1, w2))).alias("anchor"), F.lit(False).alias("strong"))
    return strong.unionByName(weak).distinct()


def anchor_scores(files: DataFrame, anchors: DataFrame) -> DataFrame:
    """(file_id, score): 2 for a strong anchor of five or more characters, 1 for a shorter one, 0.45 for a weak one.

    The join is on the project, so each file meets its own project's few anchors."""
    hay = normal(F.concat_ws("\n", "rel_path", "name", F.substring(F.col("text"), F.lit(1), F.lit(SCORE_LIMIT))))
    points = F.when(~F.col("strong"), F.lit(45)).when(F.length("anchor") >= 5, 200).otherwise(100)
    own = anchors.groupBy("project").agg(F.collect_list(F.struct("anchor", points.alias("points"))).alias("anchors"))
    hit = F.aggregate(F.filter("anchors", lambda a: F.contains(F.col("hay"), a["anchor"])), F.lit(0), lambda s, a: s + a["points"])
    return files.select("file_id", "project", hay.alias("hay")).join(own, "project", "left").select("file_id", (F.coalesce(hit, F.lit(0)) / 100).alias("score"))


def other_project_phrases(files: DataFrame, anchors: DataFrame, generic: Sequence[str] = tuple(rules.GENERIC_WORDS), pattern: str = rules.PROJECT_PHRASE) -> DataFrame:
    """(file_id, phrase): names of projects (matches of pattern) in path, name and text that share nothing with the own
    project's anchors."""
    hay = F.concat_ws("\n", "rel_path", "name", F.substring(F.col("text"), F.lit(1), F.lit(PHRASE_LIMIT)))
    found = files.select("file_id", "project", F.explode(F.array_distinct(F.transform(F.regexp_extract_all(hay, F.lit(pattern), F.lit(0)), normal))).alias("phrase"))
    words = F.array(*(F.lit(g) for g in generic))
    found = found.filter((F.length("phrase") >= 5) & ~F.array_contains(words, _bare(F.col("phrase"))))
    a = anchors.select(F.col("project").alias("p"), "anchor", F.when(F.col("strong"), 3).otherwise(4).alias("least"))
    near = (F.col("project") == F.col("p")) & (F.length("anchor") >= F.col("least")) & (F.contains(F.col("phrase"), F.col("anchor")) | F.contains(F.col("anchor"), F.col("phrase")))
    return found.join(a, near, "left_anti").select("file_id", "phrase")


def relevance(files: DataFrame, anchors: DataFrame, pattern: str = rules.PROJECT_PHRASE) -> DataFrame:
    """(file_id, status, score, scope_type) by the first rule that applies: template paths, other projects' names,
    own anchors, and otherwise assumed to belong."""
    other = other_project_phrases(files, anchors, pattern=pattern).select("file_id").distinct().withColumn("other", F.lit(True))
    template = any_of(F.lower(F.concat_ws("\n", "rel_path", "name")), [w.lower() for w in rules.TEMPLATE_WORDS])
    j = files.select("file_id", template.alias("template")).join(anchor_scores(files, anchors), "file_id").join(other, "file_id", "left")
    s = F.col("score")
    row = lambda status, score, scope: F.struct(F.lit(status).alias("status"), score.alias("score"), F.lit(scope).alias("scope_type"))
    out = (
        F.when(F.col("template") & (s < 3.0), row("REFERENCE", F.greatest(s, F.lit(0.35)), "REFERENCE_MATERIAL"))
        .when(F.col("other").isNotNull(), row("OUT_OF_SCOPE", F.least(s, F.lit(0.2)), "OTHER_PROJECT"))
        .when(s >= 1.0, row("IN_SCOPE", F.least(F.lit(1.0), s / 6.0), "PROJECT_CORE"))
        .when(F.col("template"), row("REFERENCE", F.greatest(s, F.lit(0.3)), "REFERENCE_MATERIAL"))
        .otherwise(row("IN_SCOPE", F.lit(0.45), "PROJECT_ASSUMED"))
    )
    return j.select("file_id", out.alias("r")).select("file_id", "r.*")


def fill_missing_relevance(files: DataFrame, anchors: DataFrame) -> DataFrame:
    """files (status, score, scope_type) with those judged by path and name that lack a status or scope and are live."""
    lacking = ~F.col("deleted") & ((F.coalesce(F.trim("status"), F.lit("")) == "") | (F.coalesce(F.trim("scope_type"), F.lit("")) == ""))
    open_files, done = files.filter(lacking), files.filter(~lacking)
    judged = relevance(open_files.select("file_id", "project", "rel_path", "name", F.lit("").alias("text")), anchors)
    return done.unionByName(open_files.drop("status", "score", "scope_type").join(judged, "file_id").select(files.columns))


def is_out_of_scope(status: Column) -> Column:
    return F.coalesce(status, F.lit("")) == "OUT_OF_SCOPE"


def is_reference(status: Column) -> Column:
    return F.coalesce(status, F.lit("")) == "REFERENCE"


def is_knowledge_eligible(status: Column) -> Column:
    """In scope, or not judged yet."""
    return (F.trim(F.coalesce(status, F.lit(""))) == "") | (status == "IN_SCOPE")
