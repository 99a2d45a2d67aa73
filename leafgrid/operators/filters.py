"""Predicates and cascades over detections, as expressions.

A cascade gives the name of the first rule that rejects a row, null for rows that stay,
so that one projection serves keeping, removing, counting by reason and explaining.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgrid.functions import geometry as g
from leafgrid.functions.geometry import Box

#: Per detector: weight, reliability, least confidence, priority for tables and for figures. Fixed values.
DETECTORS = {
    "doclayout": (0.4, 0.85, 0.5, 2, 2),
    "table_transformer": (0.35, 0.90, 0.7, 3, 1),
    "legacy": (0.25, 0.75, 0.5, 1, 1),
}
#: Other names of detectors. Fixed values.
ALIASES = {
    "publaynet": "legacy", "detectron": "legacy", "detectron2": "legacy",
    "doclayout-yolo": "doclayout", "doclayout_yolo": "doclayout", "table-transformer": "table_transformer",
}
#: Signs of a formula, of a table, and of running text. Fixed values.
MATH_SIGNS = (
    "=", "≠", "≈", "≤", "≥", "<", ">", "+", "-", "×", "÷", "∫", "∑", "∏", "α", "β", "γ", "δ", "ε", "θ", "λ", "μ", "π", "σ", "φ", "ω", "∂", "∇", "∞", "√", "∈", "∉", "⊂", "⊃",
    "\\frac", "\\sum", "\\int", "\\prod", "\\sqrt", "\\alpha", "\\beta", "\\gamma", "\\delta", "，", "。", "、", "；", "：", "（", "）", "【", "】",
    "公式", "方程", "函数", "变量", "常数", "系数", "参数",
)
TABLE_WORDS = (
    "Table", "Tab.", "表", "表格", "Sample", "Condition", "Parameter", "Value", "Result", "Method", "Material", "Property", "Measurement",
    "样品", "条件", "参数", "数值", "结果", "方法", "材料", "性质", "测量",
)
TEXT_WORDS = (
    "abstract", "introduction", "conclusion", "discussion", "methods", "results", "acknowledgment", "appendix", "references", "bibliography",
    "摘要", "引言", "介绍", "结论", "讨论", "方法", "结果", "致谢", "附录", "参考文献",
)
#: What recognised text says about a region. Fixed values.
TITLE_PATTERNS = (
    "abstract", "introduction", "conclusion", "discussion", "methods", "results", "acknowledgment", "appendix",
    "background", "related work", "future work",
)
AUTHOR_PATTERNS = ("author", "affiliation", "university", "department", "institute", "laboratory", "email", "@")
REFERENCE_PATTERNS = ("references", "bibliography", "citation", "[1]", "[2]", "[3]", "[4]", "[5]", "et al", "proc.", "ieee", "acm", "springer")
MARGIN_PATTERNS = ("page", "copyright", "©", "preprint", "submitted", "under review", "draft", "version")
CITATION_PATTERNS = (r"\[\d+\]", r"\(\d{4}\)", r"et al\.", "@", r"\.edu", "department of", "university", "institute", "references", "bibliography")


def first_reason(*rules: tuple[str, Column]) -> Column:
    """Name of the first rule that holds, null if none does."""
    name, holds = rules[0]
    out = F.when(holds, F.lit(name))
    for name, holds in rules[1:]:
        out = out.when(holds, F.lit(name))
    return out


def total(flags: list[Column]) -> Column:
    """How many of the flags hold."""
    return reduce(lambda a, b: a + b, (f.cast("int") for f in flags))


def hits(text: Column, words) -> Column:
    """How many of the words the text contains."""
    return total([text.contains(w) for w in words])


def any_of(text: Column, words) -> Column:
    """The text contains one of the words."""
    return text.rlike("|".join(re.escape(w) for w in words))


def valid(b: Box, kind: Column, score: Column) -> Column:
    known = kind.isin("figure", "table")
    finite = reduce(lambda a, x: a & x, (c.isNotNull() & ~F.isnan(c) for c in b))
    return F.coalesce(finite & known & score.between(0, 1), F.lit(False))


def looked_up(detector: Column, at: int, default: float) -> Column:
    """A property of a detector by its name or its other name."""
    values = {n: v[at] for n, v in DETECTORS.items()}
    values |= {n: values[to] for n, to in ALIASES.items()}
    table = F.create_map(*(F.lit(x) for n, v in values.items() for x in (n, float(v))))
    return F.coalesce(F.try_element_at(table, F.lower(detector)), F.lit(float(default)))


def of_detector(detector: Column, values: dict[str, float], default: float) -> Column:
    """A value of a detector by its name or its other name."""
    known = values | {n: values[to] for n, to in ALIASES.items() if to in values and n not in values}
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for n, v in known.items() for x in (n, float(v)))), F.lower(detector)), F.lit(float(default)))


def updated(values: dict[str, float], changes: dict[str, float]) -> dict[str, float]:
    """Values with changes by lower-cased name; a change that is not between 0 and 1 is left out."""
    return values | {n.lower(): v for n, v in changes.items() if 0 <= v <= 1}


#: Labels of the classes of two layout models, by number. Fixed values.
LAYOUT_CLASSES = ("text", "title", "figure", "table", "caption", "header", "footer", "reference", "equation")
BLOCK_CLASSES = ("Text", "Title", "List", "Table", "Figure")


def class_label(number: Column, labels: tuple[str, ...]) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, labels)), number.cast("int")), F.lit("unknown"))


def layout_kept(label: Column, score: Column, least: float = 0.5) -> Column:
    """Sure figures and tables of a layout."""
    return F.lower(label).isin("figure", "table") & (score >= least)


def weight(detector: Column) -> Column:
    return looked_up(detector, 0, 0.5)


def reliability(detector: Column) -> Column:
    return looked_up(detector, 1, 0.7)


def least_confidence(detector: Column) -> Column:
    return looked_up(detector, 2, 0.5)


def priority(detector: Column, kind: Column) -> Column:
    return F.when(kind == "table", looked_up(detector, 3, 1)).otherwise(looked_up(detector, 4, 1)).cast("int")


def weighted_score(detector: Column, score: Column) -> Column:
    return score * weight(detector) * reliability(detector)


def large_enough(b: Box, least_side: float = 40, least_area: float = 2000) -> Column:
    return (g.width(b) >= least_side) & (g.height(b) >= least_side) & (g.area(b) >= least_area)


def fills_text_page(b: Box, page_area: Column, n_lines: Column, most: float = 0.85, lines: int = 6) -> Column:
    """Covers most of a page that has text."""
    return (g.area(b) / page_area > most) & (n_lines >= lines)


def arxiv_candidate(b: Box, w: Column, h: Column) -> Column:
    """Looks like a preprint stamp: small and wide at the top, or tall at the left margin."""
    cx, cy = g.centre(b)
    share = g.signed_area(b) / (w * h)
    aspect = g.aspect(b, 0.0)
    top = (cy < h * 0.1) & (share < 0.05) & (aspect > 1.5) & (aspect < 8)
    left = (cx < w * 0.15) & (cy > h * 0.2) & (cy < h * 0.8) & (g.height(b) > h * 0.15) & (share > 0.02) & (share < 0.15)
    return top | left


def arxiv_corner(b: Box, w: Column, h: Column) -> Column:
    """A small wide box in the top left corner."""
    cx, cy = g.centre(b)
    aspect = g.aspect(b)
    return (cx < w * 0.3) & (cy < h * 0.2) & (g.signed_area(b) / (w * h) <= 0.05) & ((g.height(b) <= 0) | ((aspect > 1.5) & (aspect < 8)))


def margin_reason(b: Box, w: Column, h: Column) -> Column:
    """Small boxes in the header, the footer or at an edge."""
    cx, cy = g.centre(b)
    low, thin = g.height(b) < h * 0.05, g.width(b) < w * 0.1
    return first_reason(
        ("header", (cy < h * 0.1) & low), ("footer", (cy > h * (1 - 0.1)) & low),
        ("left_edge", (cx < w * 0.05) & thin), ("right_edge", (cx > w * (1 - 0.05)) & thin),
    )


def pattern_reason(text: Column, b: Box, h: Column) -> Column:
    """What recognised text gives a region away as."""
    t = F.lower(F.trim(text))
    return first_reason(
        ("title", any_of(t, TITLE_PATTERNS) & (g.height(b) < h * 0.08)),
        ("author", any_of(t, AUTHOR_PATTERNS) & (g.height(b) < h * 0.1)),
        ("references", hits(t, REFERENCE_PATTERNS) >= 2),
        ("margin", any_of(t, MARGIN_PATTERNS)),
    )


def dense_text(ink: Column, structure: Column, most_ink: float = 0.08, least_structure: float = 200) -> Column:
    """Much ink without the lines of a table."""
    return ((ink > most_ink) & (structure < least_structure)) | ((ink > 0.10) & (structure < 2 * least_structure)) | ((structure < least_structure * 0.5) & (ink > 0.02))


class Lines(NamedTuple):
    """Lines of text seen in a region: how many, mean and deviation of the gaps between them, and their heights added up."""

    n: Column
    gap: Column
    deviation: Column
    heights: Column


def running_text(lines: Lines, height: Column, least_density: float = 0.4) -> Column:
    """Three or more evenly spaced lines that fill much of a region."""
    even = (lines.gap > 0) & (lines.deviation < lines.gap * 0.5)
    spaced = (lines.gap >= F.greatest(F.lit(5.0), height * 0.05)) & (lines.gap <= F.least(F.lit(30.0), height * 0.15))
    return F.coalesce((lines.n >= 3) & even & spaced & (height > 0) & (lines.heights / height > least_density), F.lit(False))


class Seen(NamedTuple):
    """What the text filter looks at: recognised text, ink and structure, lines, and whether a second detector agrees."""

    text: Column
    ink: Column
    structure: Column
    lines: Lines
    confirmed: Column


def text_rules(b: Box, score: Column, seen: Seen, w: Column, h: Column, least_score: float = 0.7) -> dict[str, Column]:
    """The verdict of each rule that takes a table for running text, in their order: a reason or null."""
    flag = lambda holds, name: F.when(F.coalesce(holds, F.lit(False)), F.lit(name))
    return {
        "confidence": flag(score < least_score, "confidence"),
        "place": F.concat(F.lit("place:"), margin_reason(b, w, h)),
        "pattern": F.concat(F.lit("pattern:"), pattern_reason(seen.text, b, h)),
        "lines": flag(running_text(seen.lines, g.height(b)), "lines"),
        "density": flag(dense_text(seen.ink, seen.structure), "density"),
        "unconfirmed": flag(score.between(0.5, 0.7) & ~seen.confirmed, "unconfirmed"),
    }


def text_reason(b: Box, kind: Column, score: Column, seen: Seen, w: Column, h: Column, least_score: float = 0.7, without: tuple[str, ...] = ()) -> Column:
    """The first rule by which a table is taken for running text; figures pass. Rules named in ``without`` are off."""
    rules = text_rules(b, score, seen, w, h, least_score)
    return F.when(kind == "table", F.coalesce(*(r for n, r in rules.items() if n not in without)))


def det_reason(b: Box, kind: Column, score: Column) -> Column:
    """Why a detection is none; null for valid ones."""
    broken = reduce(lambda a, x: a | x, (c.isNull() | F.isnan(c) for c in b))
    return first_reason(("coordinates", broken), ("type", F.coalesce(~kind.isin("figure", "table"), F.lit(True))), ("score", F.coalesce(~score.between(0, 1), F.lit(True))))


def out_of_unit(values: dict[str, Column]) -> Column:
    """Names of the values that are not between 0 and 1, in order; a null value is not looked at."""
    return F.array_compact(F.array(*(F.when(~v.between(0, 1), F.lit(k)) for k, v in values.items())))


def arxiv_removed(kind: Column, candidate: Column, text: Column, recognised: bool = True) -> Column:
    """Figures that look like a preprint stamp and read like one; where no text is recognised, all that look so."""
    says = F.coalesce(F.lower(text).contains("arxiv"), F.lit(False)) if recognised else F.lit(True)
    return (kind == "figure") & candidate & says


def arxiv_suspect(b: Box, kind: Column, w: Column, h: Column) -> Column:
    """Small wide figures at the top of a page."""
    aspect = g.aspect(b)
    return (kind == "figure") & (g.centre(b)[1] < h * 0.1) & (g.signed_area(b) < w * h * 0.05) & (aspect > 1.5) & (aspect < 8)


def text_suspect(kind: Column, ink: Column, h_lines: Column, v_lines: Column, structured: Column) -> Column:
    """Tables full of ink, without lines and without structure."""
    return (kind == "table") & (ink > 0.8) & (h_lines < 100) & (v_lines < 100) & ~structured


def noise_reason(b: Box, ink: Column, least_area: float = 2000) -> Column:
    aspect = g.aspect(b)
    return first_reason(
        ("arrow", ((aspect > 5) | (aspect < 0.2)) & (ink < 0.05)), ("tiny", g.area(b) < 500),
        ("small", g.area(b) < least_area), ("empty", ink < 0.005),
    )


def equation(b: Box, near: Column, edge_ratio: Column) -> Column:
    """A formula: wide and low, more signs than table words nearby, or mostly horizontal edges."""
    signs, words = hits(near, MATH_SIGNS), hits(F.lower(near), [w.lower() for w in TABLE_WORDS])
    return F.coalesce((g.aspect(b, 0.0) > 4) & (g.height(b) < 100), F.lit(False)) | F.coalesce((signs > words) & (signs >= 2), F.lit(False)) | F.coalesce(edge_ratio > 3, F.lit(False))


class Table(NamedTuple):
    """What is seen of a table: its cells, text nearby, ink, structure, pixels of its lines, text lines inside (how many and
    how their widths vary), lines by their look, pixels of a grid, and how much its edges lie."""

    rows: Column
    cols: Column
    near: Column
    ink: Column
    structure: Column
    h_lines: Column
    v_lines: Column
    n_lines: Column
    width_variation: Column
    lines: Lines
    grid_h: Column
    grid_v: Column
    edge_ratio: Column


def table_reason(b: Box, seen: Table, w: Column, h: Column) -> Column:
    """Why a table is no valid table; null for valid ones. What is not known (null) speaks against nothing but missing cells."""
    aspect, (cx, cy), low = g.aspect(b, 0.0), g.centre(b), F.lower(seen.near)
    citations = total([low.rlike(p) for p in CITATION_PATTERNS])
    margin = ((cy < h * 0.1) | (cy > h * 0.9)) & (g.height(b) < h * 0.05)
    edge = ((cx < w * 0.05) | (cx > w * 0.95)) & (g.width(b) < w * 0.1)
    unruled = (seen.h_lines < 30) & (seen.v_lines < 30)
    return first_reason(
        ("area", g.signed_area(b) < 5000), ("aspect", (aspect > 8) | (aspect < 0.15)), ("cells", F.coalesce((seen.rows < 2) | (seen.cols < 2), F.lit(True))),
        ("margin", margin), ("edge", edge), ("citations", citations >= 2), ("section", any_of(low, TEXT_WORDS) & (g.height(b) < h * 0.08)),
        ("paragraph", unruled & (seen.n_lines >= 4) & (seen.width_variation < 0.15)), ("lines", running_text(seen.lines, g.height(b), 0.3)),
        ("ink", (seen.ink > 0.04) & (seen.structure < 400)), ("dense", (seen.ink > 0.08) & (seen.structure < 800)), ("bare", (seen.structure < 200) & (seen.ink > 0.015)),
        ("grid", (seen.grid_h < 50) & (seen.grid_v < 50)), ("equation", equation(b, seen.near, seen.edge_ratio)),
    )


def kept(rows: DataFrame, reason: Column) -> DataFrame:
    return rows.where(reason.isNull())


def removed(rows: DataFrame, reason: Column) -> DataFrame:
    return rows.withColumn("reason", reason).where("reason is not null")
