"""Features of grey rasters: numpy kernels behind one Arrow function.

A raster is a binary column of height * width bytes, row by row, with its height and
width beside it. Kernels look at one raster; nothing crosses rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INK, WHITE = 245, 240
FEATURES = "ink double, white double, x0 int, y0 int, x1 int, y1 int, across_pixels long, down_pixels long, components int, largest int, text_rows int"


def run_pixels(dark: np.ndarray, least: int) -> int:
    """Pixels in horizontal runs of at least ``least``: what an opening with such a bar leaves."""
    padded = np.zeros((dark.shape[0], dark.shape[1] + 2), np.int8)
    padded[:, 1:-1] = dark
    step = np.diff(padded, axis=1)
    begin, end = np.nonzero(step == 1)[1], np.nonzero(step == -1)[1]
    long = end - begin
    return int(long[long >= least].sum())


def labelled(dark: np.ndarray) -> np.ndarray:
    """The 8-connected component of each dark pixel by its smallest index plus one; 0 elsewhere."""
    labels = np.where(dark, np.arange(1, dark.size + 1).reshape(dark.shape), 0)
    while True:
        padded = np.where(labels > 0, labels, dark.size + 2)
        padded = np.pad(padded, 1, constant_values=dark.size + 2)
        h, w = dark.shape
        least = np.min([padded[i : i + h, j : j + w] for i in range(3) for j in range(3)], axis=0)
        now = np.where(dark, least, 0)
        # follow labels to the label of the pixel they name
        flat = np.concatenate([[0], now.ravel()])
        now = np.where(dark, flat[now], 0)
        if np.array_equal(now, labels):
            return labels
        labels = now


def text_rows(dark: np.ndarray, share: float = 0.3, least: int = 5) -> int:
    """Bands of at least ``least`` rows in which some ink spans at least that share of the width."""
    span = np.array([np.ptp(np.flatnonzero(row)) + 1 if row.any() else 0 for row in dark]) if dark.size else np.zeros(0)
    full = np.concatenate([[0], (span >= share * dark.shape[1]).astype(np.int8), [0]])
    begin, end = np.flatnonzero(np.diff(full) == 1), np.flatnonzero(np.diff(full) == -1)
    return int((end - begin >= least).sum())


def features(grey: np.ndarray, line: int = 40) -> tuple:
    """All features of one raster, in the order of FEATURES."""
    dark = grey <= INK
    if not grey.size:
        return (0.0, 0.0, None, None, None, None, 0, 0, 0, 0, 0)
    ys, xs = np.nonzero(dark)
    bounds = (int(xs.min()), int(ys.min()), int(xs.max()), int(ys.max())) if len(xs) else (None,) * 4
    sizes = np.unique(labelled(dark)[dark], return_counts=True)[1]
    return (
        float(dark.mean()), float((grey > WHITE).mean()), *bounds, run_pixels(dark, line), run_pixels(dark.T, line),
        len(sizes), int(sizes.max()) if len(sizes) else 0, text_rows(dark),
    )


def with_features(rasters: DataFrame, key: list[str], line: int = 40) -> DataFrame:
    """Key and features of each raster in columns pixels, height and width; a null raster is empty."""
    types = dict(rasters.dtypes)
    names = [x.split(" ")[0] for x in FEATURES.split(", ")]
    kinds = {"double": pa.float64(), "int": pa.int32(), "long": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data, h, w in zip(*(batch.column(c).to_pylist() for c in ("pixels", "height", "width")), strict=True):
                rows.append(features(np.frombuffer(data or b"", np.uint8).reshape(h if data else 0, w if data else 0), line))
            if rows:
                made = [pa.array(c, kinds[x.split(" ")[1]]) for c, x in zip(zip(*rows, strict=True), FEATURES.split(", "), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in key), *made], names=[*key, *names])

    return rasters.select(*key, "pixels", "height", "width").mapInArrow(run, ", ".join(f"{k} {types[k]}" for k in key) + ", " + FEATURES)


def largest_component(rasters: DataFrame, key: list[str], dark: int) -> DataFrame:
    """Key, width, height, x and y of the pixels of each raster's largest 8-connected component of grey at most ``dark``;
    of equal ones that of the first pixel, row by row."""
    types = dict(rasters.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (data, h, w) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("pixels", "height", "width")), strict=True)):
                labels = labelled(np.frombuffer(data or b"", np.uint8).reshape(h if data else 0, w if data else 0) <= dark)
                names, sizes = np.unique(labels[labels > 0], return_counts=True)
                if len(names):
                    y, x = np.nonzero(labels == names[np.argmax(sizes)])
                    same = pa.array(np.full(len(x), i))
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(c).take(same) for c in (*key, "width", "height")), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32))], names=[*key, "width", "height", "x", "y"]
                    )

    return rasters.select(*key, "pixels", "height", "width").mapInArrow(run, ", ".join(f"{k} {types[k]}" for k in key) + ", width int, height int, x int, y int")


def from_pixels(pixels: DataFrame, image: list[str], height: int, width: int, blank: int = 255) -> DataFrame:
    """Rasters of fixed size from rows of x, y and v; a pixel without a row is blank."""
    types = dict(pixels.dtypes)
    held = F.collect_list(F.struct((F.col("y") * width + F.col("x")).cast("int").alias("at"), F.col("v").cast("int").alias("v")))
    grouped = pixels.groupBy(*image).agg(held.alias("held")).select(*image, F.col("held.at").alias("at"), F.col("held.v").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at, v in zip(batch.column("at").to_pylist(), batch.column("v").to_pylist(), strict=True):
                raster = np.full(height * width, blank, np.uint8)
                raster[at] = v
                out.append(raster.tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in image), pa.array(out, pa.binary())], names=[*image, "pixels"])

    made = grouped.mapInArrow(run, ", ".join(f"{k} {types[k]}" for k in image) + ", pixels binary")
    return made.select(*image, "pixels", F.lit(height).alias("height"), F.lit(width).alias("width"))
