"""Text functions. White space is what Python calls so: Unicode spaces and U+001C to U+001F."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"

#: Applied in this order to drop code, markup and prompts.
CLEANING = (
    r"```[\s\S]*?```",
    r"`[^`]+`",
    r"(?md)^    .*$",
    r"<![^>]*>",
    r"<[^>]+>",
    r"(?md)^#!/.*$",
    rf">{_SPACE}*[^<\n]+",
    rf"\${_SPACE}*[!][!$^]",
)


def clean_text(t: Column) -> Column:
    """Drops fenced and inline code, indented lines, markup, shebangs, prompts; null: empty."""
    out = F.coalesce(t, F.lit(""))
    for pattern in CLEANING:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(""))
    return out


def strip(t: Column) -> Column:
    return F.regexp_replace(t, F.lit(r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"), F.lit(""))


def rstrip(t: Column) -> Column:
    return F.regexp_replace(t, F.lit(r"(?U)[\s\x1c-\x1f]+\z"), F.lit(""))


def normalize_whitespace(t: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(t, F.lit("")), F.lit(r"(?U)[\s\x1c-\x1f]+"), F.lit(" ")))


def exclamation_counts(t: Column) -> Column:
    """total, opening, closing and mid of the cleaned text. Any line may open; when a text both opens and closes with one, the closing one is not taken from mid."""
    c = clean_text(t)
    total = F.length(c) - F.length(F.replace(c, F.lit("!"), F.lit("")))
    opening = F.regexp_like(strip(c), F.lit(r"(?md)^[^.!?]*!")).cast("int")
    closing = F.endswith(rstrip(c), F.lit("!")).cast("int")
    return F.struct(total.alias("total"), opening.alias("opening"), closing.alias("closing"), (total - opening - F.when(opening != closing, closing).otherwise(0)).alias("mid"))


def word_set(t: Column) -> Column:
    """Distinct lower-cased words without punctuation; underscores and digits stay."""
    bare = F.regexp_replace(F.lower(F.coalesce(t, F.lit(""))), F.lit(r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f]"), F.lit(""))
    return F.array_distinct(F.filter(F.split(bare, r"(?U)[\s\x1c-\x1f]+"), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two word sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def jaccard_similarity(a: Column, b: Column) -> Column:
    return jaccard(word_set(a), word_set(b))


def text_key(t: Column) -> Column:
    """The first 16 hex digits of the text's SHA-256."""
    return F.substring(F.sha2(t, 256), 1, 16)


def preview(t: Column, n: int) -> Column:
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def truncate(t: Column, n: int = 2000) -> tuple[Column, Column]:
    """The first ``n`` characters, and whether something was cut."""
    return F.substring(t, 1, n), F.length(t) > n


def tokens(t: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
