"""Text of captions and notes: patterns, labels, quantities, keywords, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a caption, a figure's and a table's caption begin with. Fixed values.
CAPTION = r"(?iU)^\s*(fig\.?|figure|table|tab\.?|scheme|chart|图|表)\b"
FIGURE = r"(?iU)^\s*(fig\.?|figure|scheme|chart|图)\b"
TABLE = r"(?iU)^\s*(table|tab\.?|表)\b"
NUMBER = r"(?i)(?:fig\.?|figure|table|tab\.?)\s*(\d+)"
#: Labels of parts of a figure, in the order they are tried. Fixed values.
LABELS = (r"(?i)\(([a-z])\)", r"(?i)\b([a-z])\)", r"(?i)(?:fig\.?|figure)\s*\d+([a-z])\b")
#: Quantities of an experiment: group 1 is the value. Fixed values.
CONDITIONS = {
    "temperature": r"(\d+(\.\d+)?\s*(K|°C|deg\s*C))",
    "wavelength": r"(\d+(\.\d+)?\s*(nm|μm))",
    "wavenumber": r"(\d+(\.\d+)?\s*cm\^-1)",
    "pressure": r"(\d+(\.\d+)?\s*(Pa|kPa|MPa|bar|Torr))",
    "time": r"(\d+(\.\d+)?\s*(s|min|h|hours|seconds))",
    "ph": r"(pH\s*=?\s*\d+(\.\d+)?)",
}
MATERIAL = r"\b[A-Z][a-z]?\d*([A-Z][a-z]?\d*)*\b"
NOT_MATERIALS = ("The", "In", "On", "At", "To", "For")
MEASUREMENT = r"(\d+(\.\d+)?)\s*([a-zA-Zμ°]+)"


def is_caption(text: Column) -> Column:
    return text.rlike(CAPTION)


def caption_kind(text: Column) -> Column:
    """figure or table for a caption line, null for any other line."""
    t = F.trim(text)
    return F.when(t.rlike(FIGURE), "figure").when(t.rlike(TABLE), "table")


def caption_type(text: Column) -> Column:
    """figure or table by how a text begins, without a word's end; empty for neither."""
    t = F.lower(F.trim(text))
    starts = lambda words: t.rlike("^(" + "|".join(words) + ")")
    return F.when(starts(("fig", "figure", "scheme", "chart", "图")), "figure").when(starts(("table", r"tab\.", "表")), "table").otherwise("")


def figure_number(text: Column) -> Column:
    """The first number after a figure or table word anywhere; -1 without one."""
    found = F.regexp_extract(text, NUMBER, 1)
    return F.when(found == "", F.lit(-1)).otherwise(found.try_cast("int"))


def part_label(text: Column) -> Column:
    """The letter of a part of a figure, null without one."""
    return F.coalesce(*(F.nullif(F.lower(F.regexp_extract(text, p, 1)), F.lit("")) for p in LABELS))


def all_matches(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def conditions(text: Column) -> Column:
    """All quantities as structs of name, value, source and confidence."""

    def named(name: str):
        return lambda v: F.struct(F.lit(name).alias("name"), v.alias("value"), F.lit("regex").alias("source"), F.lit(0.8).alias("confidence"))

    return F.concat(*(F.transform(all_matches(text, p, 1), named(n)) for n, p in CONDITIONS.items()))


def materials(text: Column, most: int = 10) -> Column:
    """Tokens shaped like chemical formulas, each once in order of appearance, the first ``most``."""
    found = F.filter(all_matches(text, MATERIAL, 0), lambda m: (F.length(m) > 1) & ~m.isin(*NOT_MATERIALS))
    return F.slice(F.array_distinct(found), 1, most)


def measurements(text: Column, most: int = 20) -> Column:
    """Numbers with what follows them, as structs of value and unit, the first ``most``."""
    both = F.arrays_zip(all_matches(text, MEASUREMENT, 1).alias("value"), all_matches(text, MEASUREMENT, 3).alias("unit"))
    return F.slice(both, 1, most)


def units(text: Column, most: int = 10) -> Column:
    return F.slice(F.array_distinct(all_matches(text, MEASUREMENT, 3)), 1, most)


def keyword_hits(text: Column, words) -> Column:
    """How many of the words a lower-cased text contains as substrings.

    The words are one constant array: a sum of many tests would make generated code too long to be compiled.
    """
    known = [w.lower() for w in words]
    if not known:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, known)), lambda w: text.contains(w)))
