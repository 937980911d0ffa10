"""Text functions on columns. All are native expressions, with Unicode classes where it matters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The letters that normalized text keeps, beside white space.
KEPT = "a-z0-9가-힣áéíóúñüàèìòùçäöüß"
KEPT_CLASS = rf"[^{KEPT}\s/.\-:]"
#: Tokens of the term weights: two or more letters, digits or underscores.
TERM_PATTERN = r"[\p{L}\p{N}_]{2,}"


def ustrip(c: Column) -> Column:
    """Without Unicode white space at both ends (``trim`` knows spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def falsy(c: Column) -> Column:
    """Null where the string is empty."""
    return F.nullif(c, F.lit(""))


def falsy_coalesce(*columns: Column, default: str = "") -> Column:
    """The first column that is neither null nor empty; else the last one, or ``default``."""
    *early, last = columns
    return F.coalesce(*[falsy(c) for c in early], last, F.lit(default))


def normalize_text(c: Column) -> Column:
    """Lower case, kept letters only, single spaces, no outer ones; null becomes empty."""
    kept = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), KEPT_CLASS, " ")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def normalize_query(c: Column) -> Column:
    """Lower case, white space collapsed and stripped; every letter stays."""
    return F.regexp_replace(ustrip(F.lower(F.coalesce(c, F.lit("")))), r"(?U)\s+", " ")


def tokenize(c: Column) -> Column:
    """Words between spaces; empty text has none."""
    return F.array_remove(F.split(c, " "), "")


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct tokens; 0 for two empty arrays."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def term_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TERM_PATTERN), F.lit(0))


def with_bigrams(words: Column) -> Column:
    """An array of words and the pairs of neighbours among them, repeats kept."""
    pairs = F.greatest(F.size(words) - 1, F.lit(0))
    return F.concat(words, F.zip_with(F.slice(words, F.lit(1), pairs), F.slice(words, F.lit(2), pairs), lambda x, y: F.concat(x, F.lit(" "), y)))


def path_segments(path: Column) -> Column:
    return F.transform(F.split(path, ","), ustrip)


def leaf_category(path: Column) -> Column:
    """The last segment that isn't blank, lower-cased, spaces as underscores; null if none."""
    leaf = F.try_element_at(F.filter(path_segments(path), lambda s: s != ""), F.lit(-1))
    return F.replace(F.lower(leaf), F.lit(" "), F.lit("_"))


def category_depth_tags(path: Column) -> Column:
    """``[D1] a [/D1] [D2] b [/D2]``; blank segments keep their depth."""

    def tag(segment: Column, i: Column) -> Column:
        depth = (i + 1).cast("string")
        return F.concat(F.lit("[D"), depth, F.lit("] "), segment, F.lit(" [/D"), depth, F.lit("]"))

    return F.array_join(F.transform(path_segments(path), tag), " ")


def lang_tag(language: Column, query: Column) -> Column:
    return F.concat(F.lit("[LANG="), language, F.lit("] "), query)


def line_value(text: Column, key: str) -> Column:
    """What follows ``key:`` on the first line that starts with it in any case; else empty."""
    line = F.try_element_at(F.filter(F.split(text, "\n"), lambda s: F.lower(s).startswith(f"{key}:")), F.lit(1))
    return F.coalesce(ustrip(F.substr(line, F.lit(len(key) + 2))), F.lit(""))
