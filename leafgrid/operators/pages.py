"""Streams of pages through Arrow: the boxes of a page beside its lines, or all rows of a page at once.

A page with many boxes and many lines has too many pairs to make rows of. Here no pair is a row:
the lines of one page are held as arrays, its boxes pass by in batches, and each step works on a
block of boxes by a run of lines. Memory holds the lines of one page, a batch and a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from leafgrid.functions.geometry import Box
from leafgrid.session import importable

CORNERS = Box._fields
#: Elements of a block of boxes by lines, boxes by lines taken first.
BLOCK, FIRST = 1 << 18, 16
SIDE, DEALT = "__side", "__dealt"

Corners = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def floats(rows, name: str) -> np.ndarray:
    """A column as doubles, null as NaN."""
    return np.asarray(pc.cast(_one(rows[name]), pa.float64()).to_numpy(zero_copy_only=False), np.float64)


def equals(rows, name: str, value: str) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.equal(_one(rows[name]), value), False).to_numpy(zero_copy_only=False), bool)


def corners(rows, prefix: str = "") -> Corners:
    return tuple(floats(rows, prefix + c) for c in CORNERS)


def _one(column):
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _starts(batch: pa.RecordBatch, by: list[str]) -> np.ndarray:
    """Where runs of equal keys begin, and the number of rows."""
    n = batch.num_rows
    new = np.zeros(max(n - 1, 0), bool)
    for c in by:
        a, b = batch[c].slice(1), batch[c].slice(0, n - 1)
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        new |= differ.to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(new) + 1, [n]]) if n else np.zeros(1, int)


def _dealt(rows: DataFrame, page: list[str]) -> DataFrame:
    """Dealt by a hash column, as an exchange on the key itself may be dropped where a union claims to be dealt by it."""
    importable(rows.sparkSession)
    return rows.withColumn(DEALT, F.xxhash64(*page, F.lit("leafgrid"))).repartition(DEALT)


def beside_each(items: DataFrame, lines: DataFrame, page: list[str], order: list[str], prepare: Callable, run: Callable, added: str, most: int = 10_000) -> DataFrame:
    """Items with the columns ``added`` that ``run(items, prepared)`` gives, as Arrow arrays.

    ``prepare`` takes the lines of a page in ``order``, their columns under l_, once; ``run`` takes
    at most ``most`` items of that page. Items on a page without lines meet none.
    """
    own = lines.dropna(subset=page).select(*page, *(F.col(c).alias("l_" + c) for c in lines.columns if c not in page), F.lit(0).alias(SIDE))
    both = _dealt(items.withColumn(SIDE, F.lit(1)).unionByName(own, allowMissingColumns=True), page)
    names, held = items.columns, ["l_" + c for c in lines.columns if c not in page]
    extra = StructType.fromDDL(added)
    schema = StructType([*items.schema.fields, *extra.fields])
    arrow = to_arrow_schema(extra)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, found, ready = None, [], None
        for batch in batches:
            cuts = _starts(batch, [*page, SIDE])
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                now = tuple(batch[c][i].as_py() for c in page)
                if now != key:
                    key, found, ready = now, [], None
                if batch[SIDE][i].as_py() == 0:
                    found.append(batch.slice(i, j - i).select(held))
                    continue
                if ready is None:
                    ready = prepare(pa.Table.from_batches(found, pa.schema([batch.schema.field(c) for c in held])).combine_chunks())
                    found = []
                for k in range(i, j, most):
                    part = batch.slice(k, min(most, j - k))
                    made = [pc.cast(a, f.type) for a, f in zip(run(part, ready), arrow, strict=True)]
                    yield pa.RecordBatch.from_arrays([*(part[c] for c in names), *made], names=[*names, *arrow.names])

    ordered = both.sortWithinPartitions(DEALT, *page, SIDE, *("l_" + c for c in order))
    return ordered.select(*names, *held, SIDE).mapInArrow(_joined(stream), schema)


def _joined(stream: Callable, most: int = 4_000) -> Callable:
    """Small batches put together, so that small pages cost no message each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in stream(batches):
            held.append(b)
            n += b.num_rows
            if n >= most:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


def whole_pages(rows: DataFrame, page: list[str], order: list[str], run: Callable[[pa.Table], dict], added: str) -> DataFrame:
    """The page and the columns ``added`` that ``run`` makes of all its rows in order; each of its arrays has one entry a row made."""
    extra = StructType.fromDDL(added)
    schema = StructType([*(rows.schema[c] for c in page), *extra.fields])
    arrow = to_arrow_schema(schema)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                made = run(pa.Table.from_batches(held).combine_chunks())
                n = len(next(iter(made.values())))
                if n:
                    cols = [pa.array([v] * n, arrow.field(c).type) for c, v in zip(page, key, strict=True)]
                    own = (pa.array(x) if isinstance(x, np.ndarray) else _one(x) for x in (made[f] for f in extra.names))
                    yield pa.RecordBatch.from_arrays([*cols, *(pc.cast(x, arrow.field(f).type) for x, f in zip(own, extra.names, strict=True))], names=arrow.names)

        for batch in batches:
            cuts = _starts(batch, page)
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                now = tuple(batch[c][i].as_py() for c in page)
                if now != key:
                    yield from done()
                    key, held = now, []
                held.append(batch.slice(i, j - i))
        yield from done()

    columns = rows.columns
    return _dealt(rows, page).sortWithinPartitions(DEALT, *page, *order).select(*columns).mapInArrow(_joined(stream), schema)


def least(n: int, m: int, score: Callable[[np.ndarray, slice], np.ndarray], floor: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """The least score of each of ``n`` boxes over ``m`` lines and the first line that has it; infinite and -1 for none.

    ``score(boxes, lines)`` gives a block, infinite where a line does not count. A box that has met its
    ``floor``, which no score is below, is done: a line later in order can only be as good. So a
    crowded page costs each box the lines to its first perfect one, not all of them.
    """
    best, at = np.full(n, np.inf), np.full(n, -1, np.int64)
    floor = np.broadcast_to(np.asarray(floor, float), (n,))
    open_, lo, step = np.arange(n), 0, FIRST
    while lo < m and open_.size:
        hi = min(m, lo + step)
        size = max(1, BLOCK // (hi - lo))
        for k in range(0, open_.size, size):
            own = open_[k : k + size]
            s = score(own, slice(lo, hi))
            s = np.where(np.isnan(s), np.inf, s)
            first = s.argmin(1)
            value = s[np.arange(own.size), first]
            better = value < best[own]
            best[own[better]], at[own[better]] = value[better], first[better] + lo
        open_ = open_[best[open_] > floor[open_]]
        lo, step = hi, min(step * 2, 1024)
    return best, at


def taken(lines, name: str, at: np.ndarray):
    """A column of the lines at places, null for -1."""
    return _one(lines[name]).take(pa.array(at, pa.int64(), mask=at < 0))


def at_boxes(b: Corners, own: np.ndarray) -> Corners:
    return tuple(x[own, None] for x in b)


def at_lines(b: Corners, part: slice) -> Corners:
    return tuple(x[None, part] for x in b)


# ---- the algebra of functions.geometry and operators.captions on arrays, in the same order of operations


def gap_sides(a: Corners, b: Corners) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vertical gap of a line b from a box a, and whether it is below or above."""
    below, above = b[1] > a[3], b[3] < a[1]
    return np.where(below, b[1] - a[3], np.where(above, a[1] - b[3], 0.0)), below, above


def area(a: Corners) -> np.ndarray:
    return np.maximum(0.0, a[2] - a[0]) * np.maximum(0.0, a[3] - a[1])


def intersection(a: Corners, b: Corners) -> np.ndarray:
    return np.maximum(0.0, np.minimum(a[2], b[2]) - np.maximum(a[0], b[0])) * np.maximum(0.0, np.minimum(a[3], b[3]) - np.maximum(a[1], b[1]))


def ratio(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.where(whole > 0, part / np.where(whole > 0, whole, 1.0), 0.0)


def iou(a: Corners, b: Corners) -> np.ndarray:
    both = intersection(a, b)
    return ratio(both, area(a) + area(b) - both)


def overlap(a: Corners, b: Corners) -> np.ndarray:
    return ratio(intersection(a, b), np.minimum(area(a), area(b)))


def across(a: Corners, b: Corners) -> np.ndarray:
    """Shared width over the narrower width, 1 at least."""
    return np.maximum(0.0, np.minimum(a[2], b[2]) - np.maximum(a[0], b[0])) / np.maximum(1.0, np.minimum(a[2] - a[0], b[2] - b[0]))


def distance(a: Corners, b: Corners) -> np.ndarray:
    dx = np.maximum(0.0, np.maximum(a[0], b[0]) - np.minimum(a[2], b[2]))
    dy = np.maximum(0.0, np.maximum(a[1], b[1]) - np.minimum(a[3], b[3]))
    return np.sqrt(dx * dx + dy * dy)


def stands_above(a: Corners, b: Corners) -> np.ndarray:
    """``geometry.position`` of b is above."""
    dx, dy = (b[0] + b[2]) / 2 - (a[0] + a[2]) / 2, (b[1] + b[3]) / 2 - (a[1] + a[3]) / 2
    both, one, two = intersection(a, b), area(a), area(b)
    return (dy <= 0) & (np.abs(dx) <= np.abs(dy)) & ~(ratio(both, np.minimum(one, two)) >= 0.8) & ~(ratio(both, one + two - both) > 0.1)


def bands(low: np.ndarray, high: np.ndarray, at: np.ndarray, longest: float, held: int = BLOCK) -> Iterator[tuple[np.ndarray, slice]]:
    """Blocks of boxes and the run of lines that may lie within their ``low`` to ``high``: lines begin at ``at``, in order, and
    are ``longest`` at most. A box with a NaN meets none. Runs are a little wider than that, against rounding."""
    slack = lambda x: 1e-9 * (1.0 + np.abs(x) + longest)
    low, high = low - slack(low) - longest, high + slack(high)
    fine = np.flatnonzero(~(np.isnan(low) | np.isnan(high)))
    order = fine[np.argsort(low[fine], kind="stable")]
    i = 0
    while i < order.size:
        j = min(order.size, i + 256)
        first = int(np.searchsorted(at, low[order[i]], "left"))
        while True:
            own = order[i:j]
            last = int(np.searchsorted(at, high[own].max(), "right"))
            if own.size == 1 or own.size * (last - first) <= held:
                break
            j = i + own.size // 2
        if last > first:
            yield own, slice(first, last)
        i = j


def by_height(lines) -> tuple[Corners, np.ndarray, float]:
    """Corners of lines by their upper side, their places in order, and the tallest one's height; lines with a NaN are left out."""
    b = corners(lines, "l_")
    fine = np.flatnonzero(~np.isnan(np.stack(b)).any(0))
    order = fine[np.argsort(b[1][fine], kind="stable")]
    b = tuple(x[order] for x in b)
    return b, order, float(np.maximum(0.0, b[3] - b[1]).max()) if order.size else 0.0


def nearest_points(aim_x: np.ndarray, aim_y: np.ndarray, x: np.ndarray, y: np.ndarray, most: float) -> np.ndarray:
    """The point nearest to each aim and less than ``most`` away, the first in order of equally near ones; -1 for none.

    Points are searched in strips around the aim's height that widen until the nearest one found is
    nearer than the strip's edge, so that the strip narrows as the page gets crowded.
    """
    n, m = aim_x.size, x.size
    best, at = np.full(n, np.inf), np.full(n, -1, np.int64)
    fine = np.flatnonzero(~(np.isnan(x) | np.isnan(y)))
    order = fine[np.argsort(y[fine], kind="stable")]
    if not order.size:
        return at
    xs, ys = x[order], y[order]
    reach = min(most, max((ys[-1] - ys[0]) * FIRST / m, most / 64))
    open_ = np.arange(n)
    while open_.size:
        for own, part in bands(aim_y[open_] - reach, aim_y[open_] + reach, ys, 0.0):
            own = open_[own]
            far = np.sqrt((xs[None, part] - aim_x[own, None]) ** 2 + (ys[None, part] - aim_y[own, None]) ** 2)
            best[own] = far.min(1)
            at[own] = np.where(far == best[own, None], order[None, part], m).min(1)
        if reach >= most:
            break
        open_ = open_[~(best[open_] <= reach)]
        reach = min(most, reach * 4)
    return np.where(best < most, at, -1)
