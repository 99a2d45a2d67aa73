"""Detectors, recognisers and classifiers that users bring: hooks, their cascade, and what joins their answers.

A hook is a function of one page's or one crop's bytes that yields dicts. It runs in
executors, loads its model there once a task, and a page on which it fails is a row with an
error, not a failed job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgrid.functions.geometry import Box
from leafgrid.operators import filters as f
from leafgrid.operators import merging as m
from leafgrid.sources.files import hooked

FOUND = "x0 double, y0 double, x1 double, y1 double, label string, score double"
Hook = Callable[[bytes], Iterator[dict]]


def detect(pages: DataFrame, page: list[str], detector: str, hook: Hook, least: float = 0.5, image: str = "image") -> DataFrame:
    """Page, corners, type, score and detector of the sure figures and tables that a detector's hook finds; null images have none."""
    rows = hooked(pages.where(F.col(image).isNotNull()), page, image, hook, FOUND).where("error is null")
    kept = rows.where(f.layout_kept(F.col("label"), F.col("score"), least))
    return kept.select(*page, *Box._fields, F.lower("label").alias("type"), "score", F.lit(detector).alias("detector"))


def cascade(answers: list[DataFrame], page: list[str]) -> DataFrame:
    """Of each page the boxes of the first detector, in the order given, that found any there."""
    rows = None
    for k, found in enumerate(answers):
        own = found.withColumn("turn", F.lit(k))
        rows = own if rows is None else rows.unionByName(own)
    first = rows.groupBy(*page).agg(F.min("turn").alias("turn"))
    return rows.join(first, [*page, "turn"]).drop("turn")


def pooled(answers: list[DataFrame], page: list[str], score: float = 0.8, most: float = 0.7) -> DataFrame:
    """Boxes of several runs of one finder, each once: the first run's first; all have one score."""
    rows = None
    for k, found in enumerate(answers):
        own = found.withColumns({"run": F.lit(k), "place": F.monotonically_increasing_id()})
        rows = own if rows is None else rows.unionByName(own)
    order = [F.col("run").alias("o1"), F.col("y0").alias("o2"), F.col("x0").alias("o3"), F.col("y1").alias("o4"), F.col("x1").alias("o5")]
    return m.greedy_distinct(rows, page, order, most, ("run",)).withColumn("score", F.lit(score))


def recognised(crops: DataFrame, key: list[str], hook: Hook, image: str = "image") -> DataFrame:
    """Key and ``ocr_text`` of each crop: what the hook's dicts have as text, joined by spaces; empty where it reads nothing or fails."""
    rows = hooked(crops.where(F.col(image).isNotNull()).withColumn("__n", F.monotonically_increasing_id()), [*key, "__n"], image, hook, "text string")
    texts = rows.groupBy(*key).agg(F.concat_ws(" ", F.collect_list("text")).alias("ocr_text"))
    return crops.select(*key).join(texts, key, "left").select(*key, F.coalesce("ocr_text", F.lit("")).alias("ocr_text"))


def stamps(figures: DataFrame, key: list[str], hook: Hook | None, w: Column, h: Column) -> DataFrame:
    """Figures with ``removed``: those taken for a preprint's stamp, read by the hook if there is one. Figures carry type, corners and image."""
    looks = f.arxiv_candidate(Box.of(), w, h)
    if hook is None:
        return figures.withColumn("removed", f.arxiv_removed(F.col("type"), looks, F.lit(None).cast("string"), False))
    read = recognised(figures.where(looks & (F.col("type") == "figure")), key, hook)
    return figures.join(read, key, "left").withColumn("removed", f.arxiv_removed(F.col("type"), looks, F.col("ocr_text")))


def structure(tables: DataFrame, key: list[str], hook: Hook, least: float = 0.6, image: str = "image") -> DataFrame:
    """Key and how many sure rows, columns and cells the hook sees in each table (labels row, column, cell)."""
    seen = hooked(tables.where(F.col(image).isNotNull()), key, image, hook, "label string, score double").where(F.col("score") >= least)
    n = lambda label: F.count_if(F.col("label") == label).alias(f"n_{label}s")
    counted = seen.groupBy(*key).agg(n("row"), n("column"), n("cell"))
    return tables.select(*key).join(counted, key, "left").na.fill(0, ["n_rows", "n_columns", "n_cells"])


def classified(crops: DataFrame, key: list[str], first: Hook, fallback: Hook, least: float = 0.3, image: str = "image") -> DataFrame:
    """Key, kind and confidence by a user's classifier; by the fallback where the first is unsure, fails or says nothing."""
    schema = "kind string, confidence double"
    one = hooked(crops, key, image, first, schema).where("error is null").select(*key, F.col("kind").alias("k1"), F.col("confidence").alias("c1"))
    rows = crops.select(*key, image).join(one, key, "left")
    unsure = rows.where(F.coalesce(F.col("c1") < least, F.lit(True)))
    two = hooked(unsure.select(*key, image), key, image, fallback, schema).select(*key, F.col("kind").alias("k2"), F.col("confidence").alias("c2"))
    out = rows.join(two, key, "left")
    use = F.coalesce(F.col("c1") < least, F.lit(True))
    return out.select(*key, F.coalesce(F.when(use, F.col("k2")).otherwise(F.col("k1")), F.lit("unknown")).alias("kind"), F.coalesce(F.when(use, F.col("c2")).otherwise(F.col("c1")), F.lit(0.0)).alias("confidence"))
