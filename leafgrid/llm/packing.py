"""Best-fit packing of token sequences.

Lengths are at most the capacity, so that a histogram of them holds all that best-fit
decreasing looks at. The plan takes the lengths from the longest and asks a segment tree
over remaining capacities for the tightest open bin that fits, in logarithmic time; runs
of documents of one length and of bins with one remaining capacity move together. It is
worked out once from the histogram, whose size does not depend on the input, and is
the same packing as one document at a time. Documents then find their place by their rank
among those of their length; pieces that fill a sequence need none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafgrid.llm import textnum
from leafgrid.llm.bpe_ids import encoder
from leafgrid.llm.store import keep, small_batches

CAPACITY = 1024
END = 2
#: Pieces of one length are ranked in groups of about so many rows, as one length may hold most of them;
#: and the most groups of a table, beside one for each length, whose sizes the driver sees.
GROUP_ROWS, MOST_GROUPS = 500, 100_000


class SegmentTree:
    """Open bins by remaining capacity 0..capacity; answers which least capacity >= x has any."""

    def __init__(self, capacity: int) -> None:
        self.half = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.half)

    def add(self, remaining: int, bins: int) -> None:
        at = self.half + remaining
        while at:
            self.open[at] += bins
            at //= 2

    def tightest(self, x: int) -> int | None:
        """The least remaining capacity of at least x with an open bin."""
        at = self.half + x
        if self.open[at]:
            return x
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.half:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.half
            at //= 2
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, documents, first bin, documents in each bin, offset) that place every document.

    Rank k of a row is in bin ``first bin + (k - first rank) // each`` at
    ``offset + (k - first rank) % each * length``.
    """
    tree, runs, rows, bins = SegmentTree(capacity), {}, [], 0

    def open_run(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            tree.add(remaining, n)
            runs.setdefault(remaining, []).append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                # new bins, all that this length still needs: each takes as many as fit, as a bin just used is the tightest
                each = capacity // length
                full = left // each
                first, remaining, n = bins, capacity, full + (left % each > 0)
                bins += n
            else:
                first, n = runs[remaining].pop()
                tree.add(remaining, -n)
                each = remaining // length
            full = min(n, left // each)
            if full:
                rows.append((length, rank, full * each, first, each, capacity - remaining))
                open_run(remaining - each * length, first, full)
                left, rank = left - full * each, rank + full * each
            if full < n and left:
                few = min(left, each)
                rows.append((length, rank, few, first + full, few, capacity - remaining))
                open_run(remaining - few * length, first + full, 1)
                left, rank, full = left - few, rank + few, full + 1
            open_run(remaining, first + full, n - full)
    return rows


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, number long"


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of n ids: the first piece takes what the others leave."""
    if n <= capacity:
        return [n]
    first = n % capacity
    return [first] * (first > 0) + [capacity] * (n // capacity)


def _pieces(path: str, capacity: int, end: int):
    tail = np.array([end], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for batch in batches:
            for part in textnum.by_size(batch, "text"):
                cols: list[list] = [[], [], [], [], []]
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = np.concatenate([own.ids(text), tail]).astype("<u4", copy=False)
                    start = 0
                    for k, n in enumerate(cut_lengths(len(ids), capacity)):
                        row = (doc, k, start, n, zlib.crc32(ids[start : start + n]))
                        for c, v in zip(cols, row, strict=True):
                            c.append(v)
                        start += n
                numbers = np.arange(number, number + len(cols[0]))
                number += len(cols[0])
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)), pa.array(numbers)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "number"],
                )

    return run


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the pieces of every row, and a number of each."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_pieces(vocabulary, capacity, end), _PIECES)


def place(items: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The items with ``sequence_id`` and ``offset``; ``items`` is a written table with distinct numbers.

    A piece of the whole capacity is a sequence, named by its number below zero. The others are
    ranked among those of their length: in groups dealt by number, each after the rows of the
    groups before it. What goes to all tasks is bounded by the capacity and MOST_GROUPS.
    """
    spark = items.sparkSession
    total = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    total.pop(capacity, None)
    size = max(group_rows, sum(total.values()) // MOST_GROUPS)
    groups = spark.createDataFrame([(n, -(-k // size)) for n, k in sorted(total.items())], "length long, groups long")
    salt = F.pmod(F.xxhash64("number"), F.col("groups")).cast("int")
    salted = items.where(F.col("length") < capacity).join(F.broadcast(groups), "length").withColumn("salt", salt).drop("groups")
    before: dict[int, int] = {}
    starts = []
    for r in sorted(salted.groupBy("length", "salt").agg(F.count("*").alias("n")).collect()):
        starts.append((r["length"], r["salt"], before.get(r["length"], 0)))
        before[r["length"]] = before.get(r["length"], 0) + r["n"]
    first = spark.createDataFrame(starts, "length long, salt int, before long")
    rows = spark.createDataFrame(plan(total, capacity), "of_length long, rank_from long, n long, bin_from long, each long, base long")
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "number")
    ranked = salted.join(F.broadcast(first), ["length", "salt"]).withColumn("rank", F.col("before") + F.row_number().over(within) - 1)
    on = (F.col("length") == F.col("of_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_from") + F.col("n"))
    placed = ranked.join(F.broadcast(rows), on)
    out = ("doc_id", "piece", "start", "length", "ids_crc32")
    k = F.col("rank") - F.col("rank_from")
    shared = placed.select(*out, (F.col("bin_from") + F.expr("(rank - rank_from) div each")).alias("sequence_id"), (F.col("base") + k % F.col("each") * F.col("length")).alias("offset"))
    alone = items.where(F.col("length") == capacity).select(*out, (-1 - F.col("number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return shared.unionByName(alone)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Every document's pieces and where they are: sequence_id and offset.

    A null or empty text is its end id alone; repeated rows are packed each; rows
    without doc_id are packed too; no rows give no rows; further columns are ignored.
    """
    return place(keep(pieces(docs, vocabulary, capacity, end), "pieces"), capacity)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 ids."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
