"""What grey rasters show: bounds, lines of text, structure, texture, kinds, splits and crops, as numpy kernels.

Each kernel looks at one raster. Edges are places where grey changes by more than a
level from one pixel to the next; where a rule asks for traced lines, counts of lines enter as
numbers, so that any detector may give them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leafgrid.operators.raster import INK, WHITE, labelled, run_pixels

_KINDS = {"double": pa.float64(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}


def measured(rasters: DataFrame, key: list[str], kernel: Callable[[np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """Key and the rows that a kernel makes of each raster (columns pixels, height, width), as tuples of ``schema``; a null raster is empty."""
    types = dict(rasters.dtypes)
    fields = [x.split(" ") for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, rows = [], []
            for i, (data, h, w) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("pixels", "height", "width")), strict=True)):
                made = kernel(np.frombuffer(data or b"", np.uint8).reshape(h if data else 0, w if data else 0))
                place += [i] * len(made)
                rows += made
            cols = zip(*rows, strict=True) if rows else [()] * len(fields)
            at = pa.array(place, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in key), *(pa.array(c, _KINDS[t]) for c, (_, t) in zip(cols, fields, strict=True))], names=[*key, *(n for n, _ in fields)])

    return rasters.select(*key, "pixels", "height", "width").mapInArrow(run, ", ".join(f"{k} {types[k]}" for k in key) + ", " + schema)


def bounds(dark: np.ndarray) -> tuple[int, int, int, int] | None:
    """The box of what is dark, its far sides one beyond."""
    ys, xs = np.nonzero(dark)
    return (int(xs.min()), int(ys.min()), int(xs.max()) + 1, int(ys.max()) + 1) if len(xs) else None


def refined(grey: np.ndarray, pad: int = 5) -> tuple[int, int, int, int]:
    """The box of the ink and ``pad`` around it, within the raster; all of a blank one."""
    h, w = grey.shape
    found = bounds(grey <= INK)
    if found is None:
        return 0, 0, w, h
    x0, y0, x1, y1 = found
    left, top = max(0, x0 - pad), max(0, y0 - pad)
    return left, top, left + min(w - left, x1 - x0 + 2 * pad), top + min(h - top, y1 - y0 + 2 * pad)


def precision(grey: np.ndarray) -> float:
    """How much of the raster the box of its ink fills."""
    found = bounds(grey <= INK)
    return min(1.0, (found[2] - found[0]) * (found[3] - found[1]) / grey.size) if found else 0.0


def edges(grey: np.ndarray, level: int = 50) -> np.ndarray:
    """Pixels that differ by more than ``level`` from the next one to the right or below."""
    wide = grey.astype(np.int16)
    out = np.zeros(grey.shape, bool)
    out[:, :-1] |= np.abs(np.diff(wide, axis=1)) > level
    out[:-1] |= np.abs(np.diff(wide, axis=0)) > level
    return out


def otsu(grey: np.ndarray) -> int:
    """The level that parts dark from light best: the greatest variance between the two."""
    n = np.bincount(grey.ravel(), minlength=256).astype(np.float64)
    below, mass = n.cumsum(), (n * np.arange(256)).cumsum()
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    return int(np.nanargmax(np.where((below > 0) & (above > 0), between, -1.0)))


def _window(dark: np.ndarray, rows: int, cols: int, fold) -> np.ndarray:
    """Each pixel folded over a window of rows by cols around it; beyond the raster nothing counts."""
    out = dark
    for size, axis in ((rows, 0), (cols, 1)):
        before, after = size // 2, size - 1 - size // 2
        pad = [(0, 0), (0, 0)]
        pad[axis] = (before, after)
        padded = np.pad(out, pad, constant_values=fold is np.logical_and)
        n = out.shape[axis]
        out = fold.reduce([padded.take(range(k, k + n), axis) for k in range(size)])
    return out


def dilated(dark: np.ndarray, rows: int, cols: int) -> np.ndarray:
    return _window(dark, rows, cols, np.logical_or)


def closed(dark: np.ndarray, size: int = 5) -> np.ndarray:
    """Gaps of less than ``size`` filled."""
    return _window(dilated(dark, size, size), size, size, np.logical_and)


def components(dark: np.ndarray) -> list[tuple[int, int, int, int, int, float, float]]:
    """Box, pixels and centre of each 8-connected component, in the order of their first pixels."""
    labels = labelled(dark)
    names, of, n = np.unique(labels[dark], return_inverse=True, return_counts=True)
    ys, xs = np.nonzero(dark)
    if not len(names):
        return []
    low = lambda v: np.minimum.reduceat(v[order], cuts)
    high = lambda v: np.maximum.reduceat(v[order], cuts)
    order = np.argsort(of, kind="stable")
    cuts = np.concatenate([[0], np.cumsum(n)[:-1]])
    mean = lambda v: np.add.reduceat(v[order], cuts) / n
    return [tuple(x) for x in zip(low(xs).tolist(), low(ys).tolist(), (high(xs) + 1).tolist(), (high(ys) + 1).tolist(), n.tolist(), mean(xs).tolist(), mean(ys).tolist(), strict=True)]


LINES = "t_n int, t_gap double, t_deviation double, t_heights double"


def text_lines(grey: np.ndarray, share: float = 0.3, least: int = 5) -> tuple[int, float, float, float]:
    """Lines of text: parts that are joined when dark pixels spread by a fiftieth of the width, wide and tall enough.

    How many, mean and deviation of the gaps between them from top to bottom, and their heights together.
    """
    if not grey.size:
        return 0, 0.0, 0.0, 0.0
    h, w = grey.shape
    found = sorted((y0, y1) for x0, y0, x1, y1, *_ in components(dilated(grey <= otsu(grey), 1, max(int(w * 0.02), 5))) if x1 - x0 >= w * share and y1 - y0 >= least)
    gaps = [b[0] - a[1] for a, b in zip(found[:-1], found[1:], strict=True)]
    return len(found), float(np.mean(gaps)) if gaps else 0.0, float(np.std(gaps)) if gaps else 0.0, float(sum(y1 - y0 for y0, y1 in found))


def drawn_in(grey: np.ndarray, line: int = 50) -> tuple[int, int, int, int]:
    """The box of a table's rules and some space around them; without rules that of the rows and columns with much ink;
    all of the raster where too little would be left."""
    h, w = grey.shape
    pad = max(15, int(min(w, h) * 0.08))
    e = edges(grey, 40)
    ruled = dilated(dilated(_long(e, line) | _long(e.T, line).T, 7, 7), 7, 7)
    found = bounds(ruled)
    if found is not None and ruled.sum() > 80:
        box = max(0, found[0] - pad), max(0, found[1] - pad), min(w, found[2] + pad), min(h, found[3] + pad)
        if (box[2] - box[0]) * (box[3] - box[1]) > h * w * (0.2 if ruled.mean() > 0.01 else 0.4):
            return box
    dark = grey <= otsu(grey) if grey.size else grey > 0
    spans = []
    for axis, n in ((0, w), (1, h)):
        sums = dark.sum(axis=axis)
        full = np.flatnonzero(sums > sums.max(initial=0) * 0.3)
        spans.append((max(0, int(full[0]) - pad), min(n, int(full[-1]) + pad)) if len(full) else (0, n))
    (x0, x1), (y0, y1) = spans
    return (x0, y0, x1, y1) if (x1 - x0) * (y1 - y0) > h * w * 0.25 else (0, 0, w, h)


def _long(dark: np.ndarray, least: int) -> np.ndarray:
    """Pixels in horizontal runs of at least ``least``."""
    padded = np.zeros((dark.shape[0], dark.shape[1] + 2), np.int8)
    padded[:, 1:-1] = dark
    step = np.diff(padded, axis=1)
    rows, begin = np.nonzero(step == 1)
    end = np.nonzero(step == -1)[1]
    marks = np.zeros((dark.shape[0], dark.shape[1] + 1), np.int32)
    keep = end - begin >= least
    np.add.at(marks, (rows[keep], begin[keep]), 1)
    np.add.at(marks, (rows[keep], end[keep]), -1)
    return marks.cumsum(axis=1)[:, :-1] > 0


def beside_caption(page: np.ndarray, captions: list[tuple], lines: list[tuple], least: int = 40, least_area: int = 2000) -> list[tuple[int, int, int, int]]:
    """For each figure caption (corners) the largest piece of ink above it, or else below, that is no text and large enough."""
    h, w = page.shape
    ink = page <= INK
    for x0, y0, x1, y1 in lines:
        ink[max(0, int(y0)) : max(0, int(y1)), max(0, int(x0)) : max(0, int(x1))] = False
    ink = closed(ink)
    out = []
    for _, y0, _, y1 in captions:
        regions = [(int(max(0, y0 - h * 0.6)), int(y0))] * (y0 > h * 0.2) + [(int(y1), int(min(h, y1 + h * 0.6)))] * (y1 < h * 0.8)
        for top, bottom in regions:
            if bottom - top < least:
                continue
            parts = components(ink[top:bottom])
            if not parts:
                continue
            a = max(parts, key=lambda p: p[4])
            if a[2] - a[0] >= least and a[3] - a[1] >= least and (a[2] - a[0]) * (a[3] - a[1]) >= least_area:
                out.append((a[0], top + a[1], a[2], top + a[3]))
                break
    return out


def in_grid(points: list[tuple[float, float]], near: float = 50.0) -> bool:
    """Whether points stand in a grid: the rule of ``figures.in_grid`` for values."""
    rows: list[list[tuple[float, float]]] = []
    for p in sorted(points, key=lambda p: p[1]):
        if rows and p[1] - rows[-1][-1][1] < near:
            rows[-1].append(p)
        else:
            rows.append([p])
    sizes = [len(r) for r in rows]
    if len(rows) < 2 or max(sizes) - min(sizes) > 1:
        return False
    xs = [sorted(x for x, _ in r) for r in rows]
    if min(sizes) >= 2:
        pairs = list(zip(xs[0], xs[1], strict=False))
        return sum(abs(a - b) <= near for a, b in pairs) >= len(pairs) / 2
    return max(sizes) == 1 and max(x[0] for x in xs) - min(x[0] for x in xs) <= near


def composite(grey: np.ndarray, channels: int = 1) -> bool:
    """Two to nine large pieces of ink in a grid."""
    large = [p for p in components(grey <= INK) if p[4] > grey.size * channels * 0.01]
    return 2 <= len(large) <= 9 and in_grid([(p[5], p[6]) for p in large])


def split(grey: np.ndarray, pad: int = 10, apart: float = 20.0) -> list[tuple[int, int, int, int]]:
    """Boxes of two to four large pieces of ink that stand apart, with ``pad`` around them; none where there is nothing to split."""
    h, w = grey.shape
    large = [p for p in components(grey <= INK) if p[4] >= max(grey.size * 0.02, 1000)]
    if not 2 <= len(large) <= 4:
        return []
    for k, a in enumerate(large):
        for b in large[k + 1 :]:
            dx, dy = max(0, max(a[0], b[0]) - min(a[2], b[2])), max(0, max(a[1], b[1]) - min(a[3], b[3]))
            if (dx * dx + dy * dy) ** 0.5 < apart:
                return []
    out = []
    for x0, y0, x1, y1, *_ in large:
        left, top = max(0, x0 - pad), max(0, y0 - pad)
        out.append((left, top, left + min(w - left, x1 - x0 + 2 * pad), top + min(h - top, y1 - y0 + 2 * pad)))
    return out


def laplacian_variance(grey: np.ndarray) -> float:
    """Variance of the second differences: how sharp a raster is. Beyond its sides it is mirrored."""
    if not grey.size:
        return 0.0
    g = np.pad(grey.astype(np.float64), 1, mode="reflect" if min(grey.shape) > 1 else "edge")
    return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var())


def entropy(grey: np.ndarray) -> float:
    """Bits of the distribution of grey."""
    p = np.bincount(grey.ravel(), minlength=256) / max(grey.size, 1)
    return float(-(p * np.log2(p + 1e-10)).sum())


def frequency_peak(grey: np.ndarray) -> bool:
    """One frequency stands out ten times above the mean."""
    size = np.abs(np.fft.fft2(grey))
    return bool(grey.size and size.max() > 10 * size.mean())


def text_likeness(grey: np.ndarray) -> float:
    """How much a region looks like text: horizontal strokes, evenly spaced rows of ink, many small pieces and few large ones."""
    if not grey.size:
        return 0.0
    h, w = grey.shape
    score = 0.3 * (run_pixels(edges(grey), 40) / grey.size > 0.01)
    rows = peaks((grey < 200).sum(axis=1), 10, w * 0.1)
    steps = np.diff(rows)
    if len(rows) >= 3 and steps.mean() > 0 and steps.std() / steps.mean() < 0.3:
        score += 0.4
    sizes = [p[4] for p in components(grey <= 200)]
    small, large = sum(10 < s < grey.size * 0.01 for s in sizes), sum(s > grey.size * 0.1 for s in sizes)
    return min(1.0, score + 0.3 * (small > 20 and large < 3))


def peaks(values: np.ndarray, apart: int, least: float) -> np.ndarray:
    """Places of local maxima (the middle of flat ones) of at least ``least``, the higher first, none nearer than ``apart`` to one taken."""
    found, k, n = [], 1, len(values)
    while k < n - 1:
        if values[k - 1] < values[k]:
            end = k
            while end < n - 1 and values[end + 1] == values[k]:
                end += 1
            if end < n - 1 and values[end + 1] < values[k]:
                found.append((k + end) // 2)
            k = end
        k += 1
    found = [p for p in found if values[p] >= least]
    kept: list[int] = []
    for p in sorted(found, key=lambda p: (-values[p], -p)):
        if all(abs(p - q) >= apart for q in kept):
            kept.append(p)
    return np.array(sorted(kept), np.int64)


def ruled_boxes(grey: np.ndarray, line: int = 40, least: tuple[int, int] = (100, 50), aspect: tuple[float, float] = (0.5, 20.0)) -> list[tuple[int, int, int, int]]:
    """Boxes of long dark rules that hang together, large enough and of a table's shape."""
    dark = grey <= otsu(grey) if grey.size else grey > 0
    found = [p[:4] for p in components(_long(dark, line) | _long(dark.T, line).T)] if grey.size else []
    fits = lambda b: b[2] - b[0] >= least[0] and b[3] - b[1] >= least[1] and aspect[0] <= (b[2] - b[0]) / (b[3] - b[1]) <= aspect[1]
    return [b for b in found if fits(b)]


RULES = "h_pixels long, v_pixels long, h_rules int, v_rules int, grid boolean, simple boolean, crossings double"


def table_rules(grey: np.ndarray, line: int = 40) -> tuple[int, int, int, int, bool, bool, float]:
    """Pixels and number of horizontal and vertical rules, whether they make a grid or a table of a few rules, and the share of their crossings."""
    e = edges(grey)
    across, down = _long(e, line), _long(e.T, line).T
    h_pixels, v_pixels = int(across.sum()), int(down.sum())
    h_rules, v_rules = len(components(across)), len(components(down))
    simple = 2 <= h_rules <= 10 and v_rules <= 3 and h_pixels > 100
    return h_pixels, v_pixels, h_rules, v_rules, h_pixels > 100 and v_pixels > 100, simple, float((across & down).sum() / max(grey.size, 1))


SCORES = "microscopy double, sem double, tem double, chart double, heatmap double, spectrum double, figure string"


def scores(grey: np.ndarray, traced: int = 0, bottom_lines: int = 0, channel_deviation: float | None = None) -> tuple:
    """How much a raster looks like each kind, and what figure it is by its edges.

    traced: straight lines that a detector traced; bottom_lines: those in the lowest fifth;
    channel_deviation: mean deviation of the colours, null for grey rasters.
    """
    if not grey.size:
        return (0.0,) * 6 + ("unknown",)
    white, sharp = float((grey > WHITE).mean()), laplacian_variance(grey)
    e = edges(grey)
    edge_share = float(e.mean())
    h_pixels, v_pixels, *_, crossings = table_rules(grey)
    microscopy = 0.4 * (sharp > 300) + 0.3 * (white < 0.2) + 0.3 * (entropy(grey) > 5)
    sem = 0.5 * (int(grey.max()) - int(grey.min()) > 150) + 0.5 * (0.05 < edge_share < 0.3)
    tem = 0.5 * (sharp > 500) + 0.5 * frequency_peak(grey)
    inked = float((grey <= WHITE).mean())
    chart = min(1.0, 0.4 * (traced >= 1) + 0.3 * (h_pixels > 50 and v_pixels > 50) + 0.6 * (0.05 < inked < 0.8))
    heatmap = min(1.0, crossings * 50) if 0.001 < crossings < 0.1 else 0.0
    steep = int((np.diff(grey, axis=0) > 20).sum())  # differences of bytes go round, as they do where this rule comes from
    spectrum = min(1.0, 0.4 * (traced >= 10) + 0.3 * (steep > 100) + 0.3 * (bottom_lines >= 1))
    figure = "photo" if (channel_deviation or 0) > 50 or edge_share > 0.15 else "diagram" if edge_share > 0.05 else "chart"
    return microscopy, sem, tem, chart, heatmap, spectrum, figure


def photo_score(saturation: float, traced: int, variance: float) -> float:
    """Rich colours, few straight lines, a middling variance of grey."""
    return 0.3 * (saturation > 50) + 0.4 * (traced < 5) + 0.3 * (500 < variance < 3000)


def png(grey: np.ndarray) -> bytes:
    """A grey raster as a PNG file."""
    h, w = grey.shape
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    lines = np.concatenate([np.zeros((h, 1), np.uint8), grey], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def crop(grey: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """The part of a raster in a box, cut to whole pixels of it."""
    x0, y0, x1, y1 = (int(v) for v in box)
    return grey[max(0, y0) : max(0, y1), max(0, x0) : max(0, x1)]


def previews(boxes: DataFrame, rasters: DataFrame, page: list[str], key: list[str]) -> DataFrame:
    """Key and ``png`` of each box's crop of its page's raster; null where the box lies outside."""
    rows = boxes.select(*key, "x0", "y0", "x1", "y1").join(rasters, page)
    types = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, h, w, *box in zip(*(batch.column(c).to_pylist() for c in ("pixels", "height", "width", "x0", "y0", "x1", "y1")), strict=True):
                own = crop(np.frombuffer(data or b"", np.uint8).reshape(h if data else 0, w if data else 0), tuple(box))
                out.append(png(own) if own.size else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in key), pa.array(out, pa.binary())], names=[*key, "png"])

    return rows.mapInArrow(run, ", ".join(f"{k} {types[k]}" for k in key) + ", png binary")
