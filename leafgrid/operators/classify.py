"""Kinds of figures by keywords and features, as expressions.

Keywords are substrings of lower-cased text. Of equal scores the first kind wins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgrid.functions.text import conditions, keyword_hits, materials

# The words of each kind.
SUBTYPES = {
    "microscopy": ["SEM", "TEM", "AFM", "Microscope", "Micrograph", "Scale bar"],
    "spectrum": ["XRD", "FTIR", "Raman", "UV-Vis", "Spectrum", "Spectra", "Absorbance", "Transmittance", "Intensity"],
    "line_plot": ["vs", "dependence", "function of", "plot", "curve"],
}
CHARTS = {
    "bar_chart": ["bar chart", "bar graph", "histogram", "column chart", "vertical bar", "horizontal bar", "bar plot"],
    "pie_chart": ["pie chart", "pie graph", "pie diagram", "donut chart", "circular chart"],
    "line_plot": ["line chart", "line graph", "line plot", "curve", "time series", "trend"],
    "scatter_plot": ["scatter plot", "scatter chart", "scatter diagram", "scatter graph", "correlation plot"],
    "heatmap": ["heat map", "heatmap", "color map", "intensity map", "correlation matrix"],
    "box_plot": ["box plot", "box chart", "box-and-whisker", "boxplot", "quartile plot"],
    "microscopy": ["sem", "tem", "afm", "microscopy", "micrograph", "electron microscope", "optical microscope"],
    "diagram": ["schematic", "diagram", "flowchart", "flow chart", "illustration", "sketch"],
}
MAIN = {
    "chart": ["chart", "graph", "plot", "histogram", "distribution"],
    "microscopy": ["microscopy", "micrograph", "sem", "tem", "afm", "electron", "optical microscope"],
    "diagram": ["flowchart", "flow chart", "schematic", "diagram", "circuit", "illustration", "block diagram"],
    "photo": ["photograph", "photo", "image", "picture", "snapshot"],
    "spectrum": ["spectrum", "spectroscopy", "spectra", "wavelength", "absorption", "emission"],
}
SUB = {
    "bar_chart": ["bar chart", "bar graph", "column chart", "bar plot"],
    "pie_chart": ["pie chart", "pie graph", "donut chart", "circular chart"],
    "line_plot": ["line chart", "line graph", "line plot", "curve", "time series"],
    "scatter_plot": ["scatter plot", "scatter chart", "scatter diagram"],
    "histogram": ["histogram", "distribution", "frequency"],
    "box_plot": ["box plot", "box chart", "box-and-whisker", "boxplot"],
    "violin_plot": ["violin plot", "violin chart"],
    "heatmap": ["heat map", "heatmap", "color map", "intensity map"],
    "microscopy_sem": ["sem", "scanning electron", "electron microscope"],
    "microscopy_tem": ["tem", "transmission electron"],
    "microscopy_optical": ["optical microscope", "light microscope", "micrograph"],
    "diagram_flowchart": ["flowchart", "flow chart", "flow diagram", "process diagram"],
    "diagram_schematic": ["schematic", "circuit", "wiring diagram", "block diagram"],
    "spectrum": ["spectrum", "spectroscopy", "spectra", "wavelength"],
    "photo": ["photograph", "photo", "image", "picture"],
}
HIERARCHY = {
    "chart": ["bar_chart", "pie_chart", "line_plot", "scatter_plot", "histogram", "box_plot", "violin_plot", "heatmap"],
    "microscopy": ["microscopy_sem", "microscopy_tem", "microscopy_optical"],
    "diagram": ["diagram_flowchart", "diagram_schematic"],
    "photo": ["photo"],
    "spectrum": ["spectrum"],
}
#: All kinds, in the order that breaks ties. Fixed values.
KINDS = (
    "bar_chart", "pie_chart", "line_plot", "scatter_plot", "histogram", "box_plot", "violin_plot", "microscopy_sem", "microscopy_tem", "microscopy_optical",
    "diagram_flowchart", "diagram_schematic", "heatmap", "spectrum", "photo", "unknown",
)
#: Weights of keywords, features and context that the pipeline runs with.
WEIGHTS = (0.4, 0.6, 0.1)
#: The longest list of the flat vocabulary, by which its hits are divided.
LONGEST = 7


def total(values) -> Column:
    return reduce(lambda a, b: a + b, values)


def staged(rows: DataFrame, scores: dict[str, Column], prefix: str) -> tuple[DataFrame, dict[str, Column]]:
    """The scores as columns of their own: what uses them then stays small enough to be compiled."""
    return rows.withColumns({prefix + k: v for k, v in scores.items()}), {k: F.col(prefix + k) for k in scores}


def lowered(rows: DataFrame, text: Column) -> tuple[DataFrame, Column]:
    """The lower-cased text as a column of its own, worked out once for all words that are looked for."""
    return rows if "__low" in rows.columns else rows.withColumn("__low", F.lower(text)), F.col("__low")


def best(scores: dict[str, Column], none: str | None = None) -> Column:
    """The first kind of the greatest score; ``none`` if that is 0."""
    top = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    out = F.coalesce(*(F.when(s == top, F.lit(k)) for k, s in scores.items()))
    return out if none is None else F.when(top > 0, out).otherwise(F.lit(none))


def normalised(scores: dict[str, Column], even: bool = False) -> dict[str, Column]:
    """Shares of the sum; where that is 0 all 0, or all alike."""
    whole = total(scores.values())
    rest = 1 / len(scores) if even else 0.0
    return {k: F.when(whole > 0, s / whole).otherwise(F.lit(rest)) for k, s in scores.items()}


def with_subtype_scores(rows: DataFrame, text: Column, white: Column, edges: Column | None = None) -> tuple[DataFrame, dict[str, Column]]:
    """Rows with the score of each subtype: hits, with half a point for dark images as microscopy and white ones as plots,
    and for edges as plots."""
    rows, t = lowered(rows, text)
    rows, hits = staged(rows, {k: keyword_hits(t, words).cast("double") for k, words in SUBTYPES.items()}, "said_")
    hits["microscopy"] = hits["microscopy"] + F.when(white < 0.3, 0.5).otherwise(0.0)
    hits["spectrum"] = hits["spectrum"] + F.when(white > 0.7, 0.3).otherwise(0.0)
    hits["line_plot"] = hits["line_plot"] + F.when(white > 0.7, 0.5).otherwise(0.0)
    if edges is not None:
        hits["line_plot"] = hits["line_plot"] + F.when(edges > 0.05, 0.3).otherwise(0.0)
    return rows, hits


def confidence(scores: dict[str, Column]) -> Column:
    return F.least(F.lit(1.0), F.greatest(*scores.values()) / 3.0)


def with_flat_scores(rows: DataFrame, text: Column, visual: dict[str, Column]) -> tuple[DataFrame, dict[str, Column]]:
    """Rows with the score of each flat kind: keyword share and feature, weighted."""
    rows, t = lowered(rows, text)
    none = F.lit(0.0)
    return staged(rows, {k: 0.4 * (keyword_hits(t, words) / LONGEST) + 0.6 * visual.get(k, none) for k, words in CHARTS.items()}, "kind_")


def main_points(t: Column) -> dict[str, Column]:
    """Keyword points of lower-cased text: 2 for each word of a diagram, 1 for each other word."""
    return {k: keyword_hits(t, words).cast("double") * (2 if k == "diagram" else 1) for k, words in MAIN.items()}


def main_keywords(points: dict[str, Column]) -> dict[str, Column]:
    """Shares of keyword points; those of charts count only without any of a diagram."""
    return normalised(points | {"chart": F.when(points["diagram"] == 0, points["chart"]).otherwise(0.0)})


def context(detector: Column, place: Column, around: Column) -> dict[str, Column]:
    """What detector, place on the page and surrounding text add to charts and photos."""
    a = F.lower(around)
    chart = (
        F.when(F.lower(detector).contains("table"), 0.3).otherwise(0.0)
        + F.when(place.isin("top", "bottom"), 0.2).otherwise(0.0)
        + F.when(a.contains("figure") | a.contains("fig."), 0.3).otherwise(0.0)
    )
    photo = F.when(a.contains("image") | a.contains("photo"), 0.3).otherwise(0.0)
    return {k: {"chart": chart, "photo": photo}.get(k, F.lit(0.0)) for k in MAIN}


def with_main_scores(rows: DataFrame, text: Column, visual: dict[str, Column], around: dict[str, Column]) -> tuple[DataFrame, dict[str, Column]]:
    """Rows with the normalised score of each main category, and these as columns."""
    rows, low = lowered(rows, text)
    rows, points = staged(rows, main_points(low), "points_")
    rows, words = staged(rows, main_keywords(points), "words_")
    none, (by_words, by_look, by_context) = F.lit(0.0), WEIGHTS
    rows, raw = staged(rows, {k: by_words * words[k] + by_look * visual.get(k, none) + by_context * around.get(k, none) for k in MAIN}, "raw_")
    return staged(rows, {k: F.round(v, 9) for k, v in normalised(raw).items()}, "main_")


def with_sub_scores(rows: DataFrame, text: Column, main: str, visual: dict[str, Column] | None = None) -> tuple[DataFrame, dict[str, Column]]:
    """Rows with the share of each kind under a main category, by keyword hits and twice its look; alike without any."""
    visual = visual or {}
    rows, t = lowered(rows, text)
    seen = lambda k: 2.0 * visual[k] if k in visual else F.lit(0.0)
    rows, hits = staged(rows, {k: keyword_hits(t, SUB[k]).cast("double") + seen(k) for k in HIERARCHY[main]}, "hits_")
    return staged(rows, {k: F.round(v, 9) for k, v in normalised(hits, even=True).items()}, "sub_")


def hierarchical(rows: DataFrame, text: Column, main_visual: dict[str, Column], sub_visual: dict[str, Column], around: dict[str, Column], name: str = "kind") -> DataFrame:
    """Rows with a struct ``name`` of main and sub, their calibrated confidences, and the words of the sub kind that the text has."""
    rows, mains = with_main_scores(rows, text, main_visual, around)
    rows = rows.withColumns({"main": best(mains), "main_score": F.greatest(*mains.values())})
    each = []
    for main in HIERARCHY:
        rows, subs = with_sub_scores(rows, text, main, sub_visual)
        top = F.greatest(*subs.values()) if len(subs) > 1 else next(iter(subs.values()))
        rows = rows.withColumns({f"best_{main}": best(subs), f"top_{main}": top})
        each.append(main)
    sub = F.coalesce(*(F.when(F.col("main") == k, F.col(f"best_{k}")) for k in each))
    score = F.coalesce(*(F.when(F.col("main") == k, F.col(f"top_{k}")) for k in each))
    rows = rows.withColumns({"sub": sub, "sub_score": score})
    made = F.struct(
        "main", "sub", F.round(calibrated(F.col("main_score")), 6).alias("main_confidence"), F.round(calibrated(F.col("sub_score")), 6).alias("confidence"), matched(text, F.col("sub")).alias("matched"),
    )
    return rows.withColumn(name, made)


def flat_kinds(rows: DataFrame, text: Column, visual: dict[str, Column], name: str = "kind") -> DataFrame:
    """Rows with a struct ``name``: the kind of all kinds with most keyword hits and twice its look, its calibrated share
    of the sum, and its words that the text has."""
    rows, t = lowered(rows, text)
    rows, scores = staged(rows, {k: keyword_hits(t, SUB.get(k, [])).cast("double") + (2.0 * visual[k] if k in visual else F.lit(0.0)) for k in KINDS}, "flat_")
    rows = rows.withColumns({"flat_best": best(scores), "flat_top": F.greatest(*scores.values()), "flat_sum": total(scores.values())})
    share = F.round(F.when(F.col("flat_sum") > 0, F.col("flat_top") / F.col("flat_sum")).otherwise(F.lit(0.0)), 9)
    return rows.withColumn(name, F.struct(F.col("flat_best").alias("kind"), F.round(calibrated(share), 6).alias("confidence"), matched(text, F.col("flat_best")).alias("matched")))


def with_fallback(first: Column, confidence: Column, second: Column, second_confidence: Column, least: float = 0.3) -> tuple[Column, Column]:
    """The first answer and its confidence, or the second's where the first is unsure or none."""
    unsure = F.coalesce(confidence < least, F.lit(True))
    return F.when(unsure, second).otherwise(first), F.when(unsure, second_confidence).otherwise(confidence)


def merged_annotations(first: Column, confidence: Column, conditions: Column, keywords: Column, second: Column, second_confidence: Column, more_conditions: Column, more_keywords: Column) -> dict[str, Column]:
    """One annotation of two: the second subtype where the first is unknown or unsure, all conditions, each keyword once in order."""
    unsure = (first == "unknown") | (confidence < 0.4)
    return {
        "subtype": F.when(unsure, second).otherwise(first), "confidence": F.when(unsure, second_confidence).otherwise(confidence),
        "conditions": F.concat(conditions, more_conditions), "keywords": F.array_sort(F.array_union(keywords, more_keywords)),
    }


def calibrated(score: Column, a: float = 1.0, b: float = 0.0) -> Column:
    return 1 / (1 + F.exp(-(a * score + b)))


def matched(text: Column, kind: Column) -> Column:
    """The words of the kind that the text contains, in the order of its list."""
    words = F.create_map(*(x for k, v in SUB.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    t = F.lower(text)
    return F.filter(F.try_element_at(words, kind), lambda w: t.contains(w))


def reclassified(kind: Column, figures: Column, tables: Column) -> Column:
    """The kind that a page's captions speak for, twice as many and at least two."""
    to_figure = (kind == "table") & (figures > 2 * tables) & (figures >= 2)
    to_table = (kind == "figure") & (tables > 2 * figures) & (tables >= 2)
    return F.when(to_figure, "figure").when(to_table, "table").otherwise(kind)


def analysed(valid: Column, text: Column, scores: dict[str, Column], sure: float = 0.6) -> dict[str, Column]:
    """Subtype, confidence, conditions and materials of a figure by its subtype scores; those of an image that cannot be
    analysed are unknown and empty."""
    level = F.round(confidence(scores), 6)
    name = F.concat(best(scores, "unknown"), F.when(level < sure, "_low_confidence").otherwise(""))
    found = lambda c: F.when(valid, c).otherwise(F.slice(c, 1, 0))
    return {
        "subtype": F.when(valid, name).otherwise(F.lit("unknown")), "confidence": F.when(valid, level).otherwise(F.lit(0.0)),
        "conditions": found(conditions(text)), "materials": found(materials(text)),
        "method": F.when(valid, F.lit("analysed")).otherwise(F.lit("validation_failed")),
    }
