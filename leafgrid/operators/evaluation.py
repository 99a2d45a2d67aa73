"""Precision, recall and F1 of detections against annotations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgrid.functions.geometry import Box
from leafgrid.operators import merging
from leafgrid.operators import pages as p


def matches(truth: DataFrame, found: DataFrame, doc: str, page: str, least: float = 0.5) -> DataFrame:
    """One-to-one matches (doc, page, gt, pred, iou) of boxes of one page and type with an IoU of at least ``least``; both have a column id.

    A box matches on its own page alone, so that greedy matching page by page gives the
    same pairs as over the whole document.
    """
    side = lambda df, k: df.select(doc, page, "type", "id", *Box._fields, F.lit(k).alias("side"))

    def run(own: pa.Table) -> dict:
        b, ids, side, kinds = p.corners(own), own["id"].to_numpy(), own["side"].to_numpy(), own["type"].combine_chunks().dictionary_encode()
        codes = kinds.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        parts = [overlapping(b, np.flatnonzero((codes == k) & (side == 0)), np.flatnonzero((codes == k) & (side == 1)), least) for k in range(len(kinds.dictionary))]
        gt, pred, iou = (np.concatenate(x) for x in zip(*parts, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), strict=True))
        at = merging.greedy_match(ids[gt], ids[pred], iou)
        return {"gt": ids[gt[at]], "pred": ids[pred[at]], "iou": iou[at]}

    kind = dict(truth.dtypes)["id"]
    return p.whole_pages(side(truth, 0).unionByName(side(found, 1)), [doc, page], ["side", "id"], run, f"gt {kind}, pred {kind}, iou double")


def overlapping(b: p.Corners, own: np.ndarray, others: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of places of own and other boxes with an IoU of at least ``least``, which is above 0, and the IoU.

    Such boxes share at least that part of the longer side of each, both ways, so that the other one's
    low corner lies near; own boxes go by strips of the page, each against the others near it, by height.
    """
    out = [(own[:0], others[:0], np.zeros(0))]
    w, h = b[2] - b[0], b[3] - b[1]
    low, high = (1 - least) / least, 1 - least
    by_y = others[np.argsort(b[1][others], kind="stable")]
    strips = np.array_split(own[np.argsort(b[0][own], kind="stable")], max(1, min(16, own.size // 64)))
    for strip in strips if own.size and others.size else ():
        lo, hi = np.nanmin(b[0][strip] - low * w[strip]), np.nanmax(b[0][strip] + high * w[strip])
        near = by_y[(b[0][by_y] >= lo - 1e-6 * (1 + abs(lo))) & (b[0][by_y] <= hi + 1e-6 * (1 + abs(hi)))] if len(strips) > 1 else by_y
        for block, part in p.bands(b[1][strip] - low * h[strip], b[1][strip] + high * h[strip], b[1][near], 0.0):
            mine, those = strip[block], near[part]
            iou = p.iou(tuple(x[mine, None] for x in b), tuple(x[None, those] for x in b))
            i, k = np.nonzero(iou >= least)
            out.append((mine[i], those[k], iou[i, k]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def report(truth: DataFrame, found: DataFrame, doc: str, page: str, least: float = 0.5) -> DataFrame:
    """Counts and rates of each document and, with a null document, of all together."""
    n = lambda df, name: df.groupBy(doc).agg(F.count("*").alias(name))
    hit = matches(truth, found, doc, page, least).groupBy(doc).agg(F.count("*").alias("tp"), F.sum("iou").alias("iou_sum"))
    docs = n(truth, "n_gt").join(n(found, "n_pred"), doc, "full").join(hit, doc, "left").na.fill(0).na.fill(0.0)
    sums = docs.rollup(doc).agg(*(F.sum(c).alias(c) for c in ("n_gt", "n_pred", "tp", "iou_sum")))
    precision, recall = share(F.col("tp"), F.col("n_pred")), share(F.col("tp"), F.col("n_gt"))
    return sums.select(
        doc, "n_gt", "n_pred", "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_gt") - F.col("tp")).alias("fn"),
        F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1(precision, recall), 6).alias("f1"),
        F.round(share(F.col("iou_sum"), F.col("tp")), 6).alias("mean_iou"),
    )


def evaluable(truth: DataFrame, found: DataFrame, doc: str) -> tuple[DataFrame, DataFrame]:
    """Annotations and detections of the documents that have both; a document without detections is skipped, not counted as missed."""
    both = truth.select(doc).distinct().join(found.select(doc).distinct(), doc)
    return truth.join(both, doc), found.join(both, doc)
