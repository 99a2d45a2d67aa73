"""Order-dependent operators on the boxes of a page: merging, de-duplication, matching, clustering.

Pages are the unit of parallelism throughout: the boxes of one page, in order, are arrays in an
Arrow stream (``pages``), so that a step over all that is left of a page costs one pass.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafgrid.functions import geometry as g
from leafgrid.functions.geometry import Box
from leafgrid.operators import pages as p
from leafgrid.session import importable

CORNERS = Box._fields


def _of(s: Column) -> Box:
    return Box(*(s[c] for c in CORNERS))


def greedy_distinct(rows: DataFrame, page: list[str], order: list[Column], most: float, carry: tuple[str, ...]) -> DataFrame:
    """First wins: in the given order a box stays if no box that stayed overlaps it by more than ``most`` (IoU)."""
    types = dict(rows.dtypes)
    names = [f"__o{k}" for k in range(len(order))]
    columns = list(dict.fromkeys([*carry, *CORNERS]))

    def run(own: pa.Table) -> dict:
        kept = pa.array(first_wins(p.corners(own), most))
        return {c: own[c].take(kept) for c in columns}

    ordered = rows.select(*page, *(o.alias(n) for o, n in zip(order, names, strict=True)), *columns)
    return p.whole_pages(ordered, page, [*names, *columns], run, ", ".join(f"{c} {types[c]}" for c in columns)).select(*page, *carry, *CORNERS)


def first_wins(b: p.Corners, most: float) -> np.ndarray:
    """Places of the boxes that stay: each strikes out all later ones that it overlaps by more than ``most``."""
    left, kept = np.arange(len(b[0])), []
    while left.size:
        kept.append(left[0])
        own, left = left[0], left[1:]
        left = left[~(p.iou(tuple(x[own] for x in b), tuple(x[left] for x in b)) > most)]
    return np.array(kept, np.int64)


def iou_value(a: tuple, b: tuple) -> float:
    inter = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    sides = [max(0.0, x[2] - x[0]) * max(0.0, x[3] - x[1]) for x in (a, b)]
    whole = sum(sides) - inter
    return inter / whole if whole > 0 else 0.0


def overlap_value(a: tuple, b: tuple) -> float:
    inter = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    least = min(max(0.0, x[2] - x[0]) * max(0.0, x[3] - x[1]) for x in (a, b))
    return inter / least if least > 0 else 0.0


def union_value(boxes: list[tuple]) -> tuple:
    return (min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes))


def _merged(rows: list[dict]) -> dict:
    """One box of several: the union, the greatest score, the type of the first best, and how many they are."""
    best = max(rows, key=lambda r: r["score"])
    return {"box": union_value([r["box"] for r in rows]), "score": best["score"], "type": best["type"], "n": len(rows)}


def merge_rounds(rows: list[dict], joins, rounds: int) -> list[dict]:
    """Each box takes all later boxes that join it as it was, until a round changes nothing or ``rounds`` are over."""
    for _ in range(rounds):
        out, left = [], rows
        while left:
            first, others = left[0], left[1:]
            joined = [r for r in others if joins(first, r)]
            left = [r for r in others if not joins(first, r)]
            out.append(_merged([first, *joined]) if joined else first)
        if len(out) == len(rows):
            break
        rows = out
    return rows


def absorb(rows: list[dict], joins) -> list[dict]:
    """Each box grows by every later box that joins it as it has grown, until nothing joins anything.

    Counts add up, the type is that of the higher score (of ties the growing box's), and a
    box without a signature takes that of what it absorbs.
    """
    changed = True
    while changed:
        changed, out, left = False, [], rows
        while left:
            own, rest = left[0], []
            for r in left[1:]:
                if not joins(own, r):
                    rest.append(r)
                    continue
                better = own if own["score"] >= r["score"] else r
                own = {"box": union_value([own["box"], r["box"]]), "score": better["score"], "type": better["type"], "n": own["n"] + r["n"], "sig": own["sig"] or r["sig"]}
                changed = True
            out.append(own)
            left = rest
        rows = out
    return rows


def absorb_signed(rows: list[dict], joins) -> list[dict]:
    """``absorb`` for rows that never join under different signatures; ``joins`` takes two boxes.

    A box meets those of its own signature and those without one alone.
    """
    changed = True
    while changed:
        changed, out, gone, by = False, [], [False] * len(rows), {}
        for i, r in enumerate(rows):
            by.setdefault(r["sig"], []).append(i)
        bare = by.get("", [])

        def after(i: int, sig: str, by=by, bare=bare) -> list[int]:
            own = by[sig][bisect_right(by[sig], i) :]
            return sorted(own + bare[bisect_right(bare, i) :]) if bare else own

        for i, first in enumerate(rows):
            if gone[i]:
                continue
            own, sig = first, first["sig"]
            todo, k = after(i, sig) if sig else range(i + 1, len(rows)), 0
            while k < len(todo):
                j = todo[k]
                k += 1
                if gone[j] or not joins(own["box"], rows[j]["box"]):
                    continue
                r = rows[j]
                better = own if own["score"] >= r["score"] else r
                own = {"box": union_value([own["box"], r["box"]]), "score": better["score"], "type": better["type"], "n": own["n"] + r["n"], "sig": sig or r["sig"]}
                gone[j] = changed = True
                if own["sig"] != sig:
                    sig = own["sig"]
                    todo, k = after(j, sig), 0
            out.append(own)
        rows = out
    return rows


def each_group(rows: DataFrame, by: list[str], order: list[str], run: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """``run`` on the rows of each group in order, as dicts; its dicts become rows of ``schema``.

    Groups are dealt by key, sorted and streamed, so that small groups cost no call of
    their own and memory holds one group and one batch. They are dealt by a hash column: an
    exchange on the key itself may be dropped where the input claims to be dealt by it, and the
    branches of a union may then be cut at different keys.
    """
    names = [x.strip().split(" ")[0] for x in schema.split(", ")]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        key: tuple | None = None
        for batch in batches:
            out: list[dict] = []
            for r in batch.to_pylist():
                now = tuple(r[k] for k in by)
                if now != key and held:
                    out += run(held)
                    held = []
                key = now
                held.append(r)
            if out:
                yield to_batch(out)
        if held:
            out = run(held)
            if out:
                yield to_batch(out)

    def to_batch(out: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], arrow[n]) for n in names], names=names)

    kinds = {"int": pa.int32(), "bigint": pa.int64(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    arrow = {x.strip().split(" ")[0]: kinds[x.strip().split(" ")[1]] for x in schema.split(", ")}
    columns = rows.columns
    importable(rows.sparkSession)
    dealt = rows.withColumn("__dealt", F.xxhash64(*by, F.lit("leafgrid"))).repartition("__dealt")
    return dealt.sortWithinPartitions("__dealt", *by, *order).select(*columns).mapInArrow(stream, schema)


_MERGED = "merged_ord int, x0 double, y0 double, x1 double, y1 double, score double, type string, merged_from int"


def _schema(rows: DataFrame, page: list[str]) -> str:
    types = dict(rows.dtypes)
    return ", ".join(f"{p} {types[p]}" for p in page) + ", " + _MERGED


def _out(page: dict, rows: list[dict]) -> list[dict]:
    return [page | {"merged_ord": k + 1, "score": r["score"], "type": r["type"], "merged_from": r["n"]} | dict(zip(CORNERS, r["box"], strict=True)) for k, r in enumerate(rows)]


def _box(r: dict) -> tuple:
    return tuple(r[c] for c in CORNERS)


def overlap_merge(rows: DataFrame, page: list[str], least_iou: float = 0.3, least_overlap: float = 0.7, again: int = 10) -> DataFrame:
    """Boxes of a page merged while they overlap: one pass, then at most ``again`` more while one changes something."""

    def joins(own: p.Corners, others: p.Corners) -> np.ndarray:
        both, one, two = p.intersection(own, others), p.area(own), p.area(others)
        return (p.ratio(both, one + two - both) >= least_iou) | (p.ratio(both, np.minimum(one, two)) >= least_overlap)

    def run(own: pa.Table) -> dict:
        b, score, kind, n = merged_arrays(p.corners(own), p.floats(own, "score"), joins, 1 + again)
        made = dict(zip(CORNERS, b, strict=True)) | {"merged_ord": np.arange(1, len(n) + 1), "score": pa.array(score, from_pandas=True), "type": own["type"].take(pa.array(kind)), "merged_from": n}
        return made

    return p.whole_pages(rows.select(*page, "ord", *CORNERS, "score", "type"), page, ["ord"], run, _MERGED)


def merged_arrays(b: p.Corners, score: np.ndarray, joins: Callable, rounds: int) -> tuple[p.Corners, np.ndarray, np.ndarray, np.ndarray]:
    """``merge_rounds`` on arrays: corners, scores, the places whose type each has, and counts."""
    b, score, kind, n = [x.copy() for x in b], score.copy(), np.arange(len(score)), np.ones(len(score), np.int64)
    for _ in range(rounds):
        left, out = np.arange(len(n)), []
        while left.size:
            own, left = left[0], left[1:]
            hit = joins(tuple(x[own] for x in b), tuple(x[left] for x in b))
            if hit.any():
                group = np.concatenate([[own], left[hit]])
                best = group[np.where(np.isnan(score[group]), -np.inf, score[group]).argmax()]
                for k, f in enumerate((np.min, np.min, np.max, np.max)):
                    b[k][own] = f(b[k][group])
                score[own], kind[own], n[own] = score[best], kind[best], group.size
                left = left[~hit]
            out.append(own)
        done = len(out) == len(n)
        keep = np.array(out, np.int64)
        b, score, kind, n = [x[keep] for x in b], score[keep], kind[keep], n[keep]
        if done:
            break
    return tuple(b), score, kind, n


def _span(a0: float, a1: float, b0: float, b1: float) -> float:
    return max(0.0, min(a1, b1) - max(a0, b0)) / max(1.0, min(a1 - a0, b1 - b0))


def beside_value(a: tuple, b: tuple, aligned: float = 0.65, gap: float = 16.0) -> bool:
    """Aligned boxes with a small gap, one above the other or side by side."""
    down, across = max(a[1], b[1]) - min(a[3], b[3]), max(a[0], b[0]) - min(a[2], b[2])
    return (_span(a[0], a[2], b[0], b[2]) >= aligned and max(0.0, down) <= gap) or (_span(a[1], a[3], b[1], b[3]) >= aligned and max(0.0, across) <= gap)


def barrier_value(a: tuple, b: tuple, lines: list[tuple], least: float = 0.6) -> bool:
    """A line crosses the gap between two boxes: the rule of ``captions.barrier`` for values."""
    for along in (1, 0):  # one above the other, then side by side
        across = 1 - along
        if not (a[along + 2] <= b[along] or b[along + 2] <= a[along]):
            continue
        first, second = (a, b) if a[along] < b[along] else (b, a)
        slot = [0.0] * 4
        slot[along], slot[along + 2] = first[along + 2], second[along]
        slot[across], slot[across + 2] = max(first[across], second[across]), min(first[across + 2], second[across + 2])
        if slot[along + 2] <= slot[along] + 2 or slot[across + 2] <= slot[across]:
            return False
        for line in lines:
            touches = all(min(line[k + 2], slot[k + 2]) > max(line[k], slot[k]) for k in (0, 1))
            if touches and all(_span(line[across], line[across + 2], x[across], x[across + 2]) >= least for x in (slot, first, second)):
                return True
    return False


def barred(a: tuple, b: tuple, lines: np.ndarray, least: float = 0.6) -> bool:
    """``barrier_value`` for lines in an array of corners."""
    if not len(lines) or (a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]):
        return False
    lo, hi = (min(a[k], b[k]) for k in (0, 1)), (max(a[k], b[k]) for k in (2, 3))
    (x0, y0), (x1, y1) = lo, hi
    near = lines[(lines[:, 0] < x1) & (lines[:, 2] > x0) & (lines[:, 1] < y1) & (lines[:, 3] > y0)]
    return barrier_value(a, b, [tuple(line) for line in near.tolist()], least)


def proximity_merge(signed: DataFrame, lines: DataFrame, page: list[str], aligned: float = 0.65, gap: float = 16.0) -> DataFrame:
    """Boxes of a page absorbed by aligned ones close by, to the fixpoint.

    Boxes carry the text of their nearest caption as ``signature``; two that have different ones
    stay apart, and so do two with a line (corners, line_no) between them.
    """

    def run(own: list[dict]) -> list[dict]:
        bars = np.array([_box(r) for r in own if r["score"] is None], float).reshape(-1, 4)
        start = [{"box": _box(r), "score": r["score"], "type": r["type"], "n": 1, "sig": r["signature"] or ""} for r in own if r["score"] is not None]
        return _out({p: own[0][p] for p in page}, absorb_signed(start, lambda a, b: beside_value(a, b, aligned, gap) and not barred(a, b, bars)))

    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    boxes = signed.select(*page, F.col("ord").cast("long").alias("ord"), *CORNERS, "score", "type", "signature")
    bars = lines.select(*page, F.col("line_no").cast("long").alias("ord"), *CORNERS, null("double", "score"), null("string", "type"), null("string", "signature"))
    return each_group(boxes.unionByName(bars), page, ["ord"], run, _schema(signed, page))


def replacing_distinct(rows: DataFrame, page: list[str], order: list[Column], worth: Column, most: float, carry: tuple[str, ...]) -> DataFrame:
    """In the given order a box stays if no kept one overlaps it by more than ``most`` (IoU); of the first kept one
    that does, the box takes the place at the end if it is worth more. ``place`` is the place among the kept, from 1."""
    struct = F.struct(*order, worth.alias("worth"), *(F.col(c).alias("k_" + c) for c in carry), *(F.col(c) for c in CORNERS))
    grouped = rows.groupBy(*page).agg(F.array_sort(F.collect_list(struct)).alias("all"))

    def step(acc: Column, x: Column) -> Column:
        hit = F.get(F.filter(F.transform(acc, lambda y, i: F.when(g.iou(_of(y), _of(x)) > most, i)), lambda i: i.isNotNull()), F.lit(0))
        worse = F.get(acc, hit)["worth"] < x["worth"]
        return F.when(hit.isNull(), F.concat(acc, F.array(x))).when(worse, F.concat(F.filter(acc, lambda y, i: i != hit), F.array(x))).otherwise(acc)

    kept = F.aggregate("all", F.slice(F.col("all"), 1, 0), step)
    out = grouped.select(*page, F.posexplode(kept).alias("place", "b"))
    return out.select(*page, (F.col("place") + 1).alias("place"), *(F.col(f"b.k_{c}").alias(c) for c in carry), *(F.col(f"b.{c}") for c in CORNERS))


def components(edges: DataFrame, nodes: DataFrame, page: list[str]) -> DataFrame:
    """The smallest node of each node's connected component, page by page; edges in columns a and b."""

    def run(own: list[dict]) -> list[dict]:
        up = {r["a"]: r["a"] for r in own if r["b"] is None}

        def top(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for r in own:
            if r["b"] is not None:
                p, q = top(r["a"]), top(r["b"])
                up[max(p, q)] = min(p, q)
        return [{p: own[0][p] for p in page} | {"ord": x, "comp": top(x)} for x in up]

    types = dict(nodes.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in page) + ", ord int, comp int"
    own = nodes.select(*page, F.col("ord").cast("int").alias("a"), F.lit(None).cast("int").alias("b"))
    both = own.unionByName(edges.select(*page, F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b")))
    return each_group(both, page, ["a", "b"], run, schema)


def greedy_match(gt: np.ndarray, pred: np.ndarray, iou: np.ndarray) -> np.ndarray:
    """Places of one-to-one matches of pairs: the greatest IoU first, then the lower gt, then the lower pred.

    In each round all pairs that come first for both their boxes are taken; few rounds do.
    """
    order = np.lexsort((pred, gt, -iou))
    (gt, n_gt), (pred, n_pred) = ((np.searchsorted(u := np.unique(x), x[order]), u.size) for x in (gt, pred))
    left, taken = np.arange(order.size), []
    while left.size:
        first_gt, first_pred = np.full(n_gt, -1), np.full(n_pred, -1)
        back = left[::-1]
        first_gt[gt[back]], first_pred[pred[back]] = back, back
        won = left[(first_gt[gt[left]] == left) & (first_pred[pred[left]] == left)]
        taken.append(won)
        used_gt, used_pred = np.zeros(n_gt, bool), np.zeros(n_pred, bool)
        used_gt[gt[won]], used_pred[pred[won]] = True, True
        left = left[~(used_gt[gt[left]] | used_pred[pred[left]])]
    return order[np.concatenate(taken)] if taken else order


def clusters(rows: DataFrame, by: list[str], order: list[str], breaks: Column, name: str = "run") -> DataFrame:
    """Gaps and islands: rows numbered by runs that begin where ``breaks`` holds or is null."""
    w = Window.partitionBy(*by).orderBy(*order)
    flagged = rows.withColumn("__breaks", F.coalesce(breaks, F.lit(True)).cast("int"))
    return flagged.withColumn(name, F.sum("__breaks").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__breaks")


def upper_median(values: Column) -> Column:
    """The element in the middle of a sorted array, the later one of two."""
    ordered = F.array_sort(values)
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


def variation(value: Column) -> Column:
    """Coefficient of variation, the mean counting 1 at least."""
    return F.stddev_pop(value) / F.greatest(F.lit(1.0), F.avg(value))


