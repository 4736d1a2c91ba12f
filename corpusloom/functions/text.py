"""Column expressions for text: all JVM-side, none needs Python at run time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE_PUNCT = r"[\s\p{Punct}，。？！、；：「」『』【】《》（）()\[\]{}_-]+"


def any_of(text: Column, needles: Sequence[str]) -> Column:
    """Does text contain one of the needles? One pattern for all: a chain of conditions makes large plans."""
    return F.rlike(text, F.lit("|".join(rf"\Q{n}\E" for n in needles)))


def strip(text: Column) -> Column:
    """Without white space at both ends, the ideographic space included."""
    return F.regexp_replace(text, r"^[\s　]+|[\s　]+$", "")


def normalize_text(text: Column) -> Column:
    """Lower case without white space and punctuation; '' for null."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SPACE_PUNCT, "")


def normalize_query(text: Column, suffixes: Sequence[str]) -> Column:
    """normalize_text without colloquial endings, each taken off once in the order given."""
    out = normalize_text(text)
    for s in suffixes:
        out = F.regexp_replace(out, rf"\Q{s}\E$", "")
    return out


def grams(text: Column, n: int = 2) -> Column:
    """Distinct runs of n characters, by one pass of a lookahead: indexing characters one by one would be quadratic."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def tokenize_question(text: Column, stop: Sequence[str]) -> Column:
    """Distinct lower-case words of two characters or more that are no stop words, then pairs of neighbouring Han characters."""
    stops = F.array(*(F.lit(s) for s in stop))
    text = F.coalesce(text, F.lit(""))
    words = F.transform(F.split(text, r"[\s\p{Punct}，。？！、；：「-』【】《》]+"), lambda x: F.lower(strip(x)))
    words = F.filter(words, lambda x: (F.length(x) >= 2) & ~F.array_contains(stops, x))
    clean = F.regexp_replace(text, r"[\s\p{Punct}]", "")
    pairs = F.filter(grams(clean), lambda x: F.rlike(x, F.lit(r"^[一-鿿]{2}$")) & ~F.array_contains(stops, x))
    return F.array_distinct(F.concat(words, pairs))


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's argument is not put in wherever it is used, as columns are."""
    return F.element_at(F.transform(F.array(value), body), 1)


def match_offsets(text: Column, pattern: str, block: int = 64) -> Column:
    """(match, start) of all matches, 0-based: parts between matches and matches make up the text.

    Lengths are summed by blocks of matches, then within a match's block, so that the cost is linear in matches."""

    def found(s: Column) -> Column:
        sizes = F.transform(s["found"], lambda m, i: F.length(m) + F.length(F.get(s["parts"], i)))
        return let(F.struct(s["found"].alias("found"), s["parts"].alias("parts"), sizes.alias("sizes")), summed)

    def summed(s: Column) -> Column:
        n = F.size(s["sizes"])
        totals = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), lambda b: _total(F.slice(s["sizes"], b * block + 1, F.lit(block))))
        before = F.aggregate(totals, F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))
        return let(F.struct(s["found"].alias("found"), s["parts"].alias("parts"), s["sizes"].alias("sizes"), before.alias("before")), placed)

    def placed(s: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            b = F.floor(i / block).cast("int")
            start = F.get(s["before"], b) + _total(F.slice(s["sizes"], b * block + 1, i % block)) + F.length(F.get(s["parts"], i))
            return F.struct(m.alias("match"), start.alias("start"))

        return F.transform(s["found"], one)

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("parts"))
    return let(both, lambda s: F.when(F.size(s["found"]) > 0, found(s)).otherwise(F.array().cast("array<struct<match:string,start:int>>")))


def _total(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0), lambda a, x: a + x)


def lines(text: Column) -> Column:
    """Lines without the empty ones at the end."""
    return F.split(F.regexp_replace(text, r"\n+$", ""), "\n")


def token_estimate(text: Column) -> Column:
    return (F.length(text) / 1.5).cast("int")


def char_hash_embedding(text: Column, dim: int = 8) -> Column:
    """dim sums of character codes mod 31, by place mod dim, scaled to length one (zeros stay)."""
    codes = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?s)."), F.lit(0)), lambda c: F.ascii(c) % 31)

    def total(k: int) -> Column:
        return F.aggregate(F.transform(codes, lambda c, i: F.when(i % dim == k, c).otherwise(0)), F.lit(0), lambda a, x: a + x)

    sums = [total(k) for k in range(dim)]
    norm = F.sqrt(sum((s * s for s in sums[1:]), sums[0] * sums[0]).cast("double"))
    return F.array(*(F.when(norm > 0, s / norm).otherwise(F.lit(0.0)) for s in sums))
