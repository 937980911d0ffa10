"""Product attributes from titles, by patterns. Missing word bounds are part of their meaning."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import falsy, ustrip

# Word lists and patterns.
BRANDS = (
    "figma", "good smile", "goodsmile", "max factory", "bandai", "tamashii",
    "shfiguarts", "hasbro", "mattel", "neca", "mcfarlane", "kotobukiya",
    "lego", "tamiya", "revell", "takara", "tomica", "hot wheels", "hotwheels",
)
BRAND_HINTS = (
    r"\bby\s+([A-Za-z0-9\-\_]+)\b",
    r"\bbrand[:\s]+([A-Za-z0-9\-\_]+)\b",
)
EXCLUDED_COLOR_PHRASES = (r"\bred\s+pyramid\s+thing\b",)
COLORS = r"(black|white|off[-\s]?white|ivory|cream|gray|grey|blue|navy|green|red|pink|beige|brown|tan|teak|walnut|oak|maple|cherry|mahogany|silver|gold|bronze|clear|transparent)"
SIZES = r"(\b\d+([./]\d+)?\s?(cm|mm|in(?:ch)?|ft|ml|l|g|kg|oz)\b|\b(xs|s|m|l|xl|xxl)\b|\b\d+\s?(pcs?|pieces?|pack|set)\b|\b\d+\s?[x×]\s?\d+\s?(cm|mm|in|inch)\b)"
MATERIALS = r"(solid wood|engineered wood|mdf|plywood|metal|steel|stainless steel|aluminum|iron|alloy|plastic|pu leather|faux leather|leather|glass|fabric|cotton|linen|polyester|rubber|silicone|rattan|bamboo)"
CATEGORIES = r"(coffee table set|coffee table|end table|side table|desk|chair|sofa|mat|sheet|sheets|shelf|cabinet|crib|mattress|action figure|model kit|model kits?)"
STYLES = (
    r"silent\s*hill\s*2", r"red\s*pyramid\s*thing", r"bubble\s*head\s*nurse",
    r"star\s*wars", r"marvel", r"dc\s*comics", r"pokemon", r"one\s*piece",
    r"gundam", r"naruto", r"dragon\s*ball",
)
FIELDS = ("brand", "category", "material", "color", "size")

_FLAGS = "(?iU)"


def brand_order() -> list[str]:
    """Longest name first; equal lengths by name."""
    return sorted(BRANDS, key=lambda b: (-len(b), b))


def _found(title: Column, pattern: str, strict: bool) -> Column:
    return F.regexp_substr(title, F.lit(_FLAGS + (rf"\b{pattern}\b" if strict else pattern)))


def _underscored(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit("_"))


def extract_brand(title: Column) -> Column:
    """The first name of ``brand_order`` that stands in the title, else what a hint names.

    One pass finds all names: no two of them share a word, so no match hides another.
    """
    names = rf"(?U)\b(?:{'|'.join(map(re.escape, brand_order()))})\b"
    found = F.regexp_extract_all(F.lower(title), F.lit(names), F.lit(0))
    listed = [_underscored(F.get(F.array_intersect(F.array(*map(F.lit, brand_order())), found), F.lit(0)))]
    hinted = [_underscored(F.lower(ustrip(falsy(F.regexp_extract(title, _FLAGS + p, 1))))) for p in BRAND_HINTS]
    return F.coalesce(*listed, *hinted)


def extract_color(title: Column, strict_boundaries: bool = False) -> Column:
    excluded = F.lower(title).rlike("(?U)" + "|".join(EXCLUDED_COLOR_PHRASES))
    return F.when(~excluded, F.lower(_found(title, COLORS, strict_boundaries)))


def extract_size(title: Column) -> Column:
    return F.lower(_found(title, SIZES, False))


def extract_material(title: Column, strict_boundaries: bool = False) -> Column:
    return F.lower(_found(title, MATERIALS, strict_boundaries))


def extract_category(title: Column, strict_boundaries: bool = False) -> Column:
    found = _underscored(F.lower(_found(title, CATEGORIES, strict_boundaries)))
    return F.coalesce(found, F.when(F.lower(title).contains("table"), F.lit("table")))


def extract_styles(title: Column) -> Column:
    """An array in the order of the list, without repeats."""
    low = F.lower(title)
    hits = [F.regexp_replace(F.regexp_substr(low, F.lit(_FLAGS + p)), r"(?U)\s+", "_") for p in STYLES]
    return F.array_distinct(F.array_compact(F.array(*hits)))


def or_unknown(c: Column) -> Column:
    return F.coalesce(falsy(c), F.lit("unknown"))


def attributes_struct(title: Column, qc_leaf: Column | None = None) -> Column:
    """All attributes of a title; a leaf category from a lookup takes the category's place."""
    category = or_unknown(extract_category(title))
    return F.struct(
        or_unknown(extract_brand(title)).alias("brand"),
        or_unknown(extract_color(title)).alias("color"),
        or_unknown(extract_size(title)).alias("size"),
        or_unknown(extract_material(title)).alias("material"),
        (category if qc_leaf is None else F.coalesce(falsy(qc_leaf), category)).alias("category"),
        extract_styles(title).alias("style_list"),
    )


def attributes_str(attributes: Column, qc_leaf: Column | None = None) -> Column:
    """``brand: x, …, style: a|b, qc_leaf: y`` of what is known; ``N/A`` if nothing is."""
    parts = [F.when(attributes[k] != "unknown", F.concat(F.lit(f"{k}: "), attributes[k])) for k in FIELDS]
    styles = attributes["style_list"]
    parts.append(F.when(F.size(styles) > 0, F.concat(F.lit("style: "), F.array_join(styles, "|"))))
    if qc_leaf is not None:
        parts.append(F.concat(F.lit("qc_leaf: "), falsy(qc_leaf)))
    return F.coalesce(falsy(F.concat_ws(", ", *parts)), F.lit("N/A"))


def attr_tag(title: Column, attributes: Column) -> Column:
    """``title [ATTR] attributes`` unless there are none."""
    return F.concat(ustrip(title), F.when(attributes != "N/A", F.concat(F.lit(" [ATTR] "), attributes)).otherwise(F.lit("")))
