"""Document fingerprints: 64-bit SimHash and search by block tables.

Terms are runs of two words; each weighs one and the logarithm of its count, in sixteenths.
The bits of a term's hash vote for or against each bit of the fingerprint. Two
fingerprints within radius r differ by at most r // blocks bits in some block, so that
tables keyed by one block each, asked for all keys that near, find every such pair.

Equal fingerprints are one class, named by its smallest doc_id; classes are searched, so
that copies cost no pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrid.llm import textnum
from leafgrid.llm.store import keep, small_batches

TERM_WORDS = 2
#: Texts whose sets of five-word runs have Jaccard 0.8 or more are up to 13 bits apart (README).
RADIUS, BLOCKS = 13, 7
#: Pairs of fingerprints looked at together.
PAIRS = 1 << 20
#: Terms whose bits are added up at once.
SLICE = 1 << 16
#: Classes of one cell of a table that are dealt to one task, about.
CELL_ROWS = 200_000
#: Rows of one class that a shuffle brings together; larger classes reach theirs by a broadcast, of so many classes at most.
HOT_COPIES, BROADCAST_CLASSES = 500, 1_000_000


def simhash(words: np.ndarray) -> int:
    """The fingerprint of a text given by the hashes of its words; 0 without words."""
    terms, counts = np.unique(textnum.shingles(words, TERM_WORDS), return_counts=True)
    weights = np.rint(16 * (1 + np.log(counts)))
    votes = np.zeros(64)
    for at in range(0, len(terms), SLICE):
        bits = np.unpackbits(terms[at : at + SLICE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes += weights[at : at + SLICE] @ (2.0 * bits - 1.0)
    return int(np.packbits(votes > 0).view(">u8")[0])


def likeness(a: int, b: int) -> float:
    """Share of equal bits."""
    return 1 - (a ^ b).bit_count() / 64


def simhashes(texts: list[str | None]) -> list[int]:
    """The fingerprint of each text, a few MB at a time."""
    out: list[int] = []
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    for part in textnum.by_size(batch, "text"):
        words, _, bounds = textnum.words(part.column("text"))
        out += [simhash(words[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many first code points of the following text, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_ROW = "kind int, part int, doc_id long, n_chars long, edited_sha256 string, fp long, edited_fp long, next_fp long, text string"
_SCHEMA = pa.schema(
    [("kind", pa.int32()), ("part", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fp", pa.int64()), ("edited_fp", pa.int64()), ("next_fp", pa.int64()), ("text", pa.string())]
)
DONE, FIRST, LAST = 0, 1, 2


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _finished(rows: list[tuple[int | None, str, int, str, int]]) -> list[tuple]:
    """Result rows of (doc_id, text, fingerprint, following text, its fingerprint)."""
    changed = [edited(t, f) for _, t, _, f, _ in rows]
    return [
        (DONE, None, d, len(t), hashlib.sha256(e.encode()).hexdigest(), _signed(own), _signed(fp), _signed(nxt), None)
        for (d, t, own, _, nxt), e, fp in zip(rows, changed, simhashes(changed), strict=True)
    ]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of all rows of a sorted partition but the last; its first and last row as they are."""
    before: tuple[int | None, str, int] | None = None
    number = TaskContext.get().partitionId() if TaskContext.get() else 0
    for batch in batches:
        for part in textnum.by_size(batch, "text"):
            ids, texts = part.column("doc_id").to_pylist(), [t or "" for t in part.column("text").to_pylist()]
            own = simhashes(texts)
            rows = list(zip(ids, texts, own, strict=True))
            out = []
            if before is None and rows:
                out.append((FIRST, number, rows[0][0], None, None, _signed(rows[0][2]), None, None, rows[0][1]))
            pairs = zip([before, *rows[:-1]] if before else rows[:-1], rows if before else rows[1:], strict=True)
            out += _finished([(*a, b[1], b[2]) for a, b in pairs])
            before = rows[-1] if rows else before
            if out:
                yield _batch(out)
    if before:
        yield _batch([(LAST, number, before[0], None, None, _signed(before[2]), None, None, before[1])])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            rows = [(r["doc_id"], r["text"], r["fp"] % (1 << 64), r["next_text"], r["next_fp"] % (1 << 64)) for r in batch.to_pylist()]
            yield _batch(_finished(rows))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """Every row with its fingerprint, that of its edited text, and that of the next row by doc_id.

    Rows are dealt by ranges of doc_id and sorted there, so that the next row is at hand;
    the rows at the edges of ranges meet in a join of two rows a range. Rows without
    doc_id come first; equal doc_ids follow in the order of a hash of their texts; a null text is
    empty; one row alone follows itself; no rows give no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    made = keep(rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").select("doc_id", "text").mapInArrow(_in_order, _ROW), "fingerprints")
    parts = sorted(r["part"] for r in made.where(F.col("kind") == FIRST).select("part").collect())  # one for each range
    follows = [(a, parts[(k + 1) % len(parts)]) for k, a in enumerate(parts)]
    follows = F.broadcast(spark.createDataFrame(follows, "part int, follower int"))
    edge = lambda kind: made.where(F.col("kind") == kind).select("part", "doc_id", "text", "fp")
    nexts = edge(FIRST).select(F.col("part").alias("follower"), F.col("text").alias("next_text"), F.col("fp").alias("next_fp"))
    at_edges = edge(LAST).join(follows, "part").join(nexts, "follower").select("doc_id", "text", "fp", "next_text", "next_fp").mapInArrow(_pairs, _ROW)
    return made.where(F.col("kind") == DONE).unionByName(at_edges).drop("kind", "part", "text")


def _masks(blocks: int) -> list[int]:
    edges = [64 * k // blocks for k in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges[:-1], edges[1:], strict=True)]


def block_cells(fp, blocks: int, off: int):
    """An array of cells, each a table and the value of its block, with at most ``off`` bits of the block changed."""
    cells = []
    for table, mask in enumerate(_masks(blocks)):
        low, width = (mask & -mask).bit_length() - 1, mask.bit_count()
        changes = [sum(1 << b for b in bits) for n in range(off + 1) for bits in combinations(range(width), n)]
        own = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1)) + F.lit(table << 40)
        cells += [own.bitwiseXOR(F.lit(x)) for x in changes]
    return F.array(*cells)


_NEAR = "array<struct<class_id: long, fp: long, distance: int, n_docs: long>>"
_NEAR_TYPE = pa.struct([("class_id", pa.int64()), ("fp", pa.int64()), ("distance", pa.int32()), ("n_docs", pa.int64())])


def _cell_pairs(radius: int, blocks: int, shares: int):
    """Of rows sorted by cell, searched fingerprints first: each query of a cell with what is near it and meets it in no earlier table."""
    off, masks = radius // blocks, np.array(_masks(blocks), np.uint64)

    def near(table: int, index: list[np.ndarray], asked: np.ndarray) -> Iterator[pa.RecordBatch]:
        fps, ids, null, sizes = index
        step = max(1, PAIRS // len(fps))
        for at in range(0, len(asked), step):
            part = asked[at : at + step]
            apart = part[:, None] ^ fps
            bits = np.bitwise_count(apart)
            q, x = np.nonzero((bits <= radius) & (bits > 0))
            change = apart[q, x]
            first = np.ones(len(q), bool)
            for mask in masks[:table]:
                first &= np.bitwise_count(change & mask) > off
            q, x = q[first], x[first]
            if len(q):
                fields = [pa.array(ids[x], pa.int64(), mask=null[x]), pa.array(fps[x].view(np.int64)), pa.array(bits[q, x].astype(np.int32)), pa.array(sizes[x])]
                some, starts = np.unique(q, return_index=True)
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(q)).astype(np.int32)), pa.StructArray.from_arrays(fields, fields=list(_NEAR_TYPE)))
                yield pa.RecordBatch.from_arrays([pa.array(part[some].view(np.int64)), lists], names=["query", "near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            cells, sizes, fps = (batch.column(c).to_numpy() for c in ("cell", "n_docs", "fp"))
            ids, null = batch.column("class_id").fill_null(0).to_numpy(), batch.column("class_id").is_null().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(cells)) + 1 if len(cells) else []
            for a, b in zip([0, *cuts], [*cuts, len(cells)], strict=True) if len(cells) else ():
                if cells[a] != cell:
                    cell, held = cells[a], []
                middle = a + int((sizes[a:b] > 0).sum())
                if middle > a:
                    held.append([fps[a:middle].view(np.uint64), ids[a:middle], null[a:middle], sizes[a:middle]])
                if b > middle and held:
                    held = [[np.concatenate(x) for x in zip(*held, strict=True)]] if len(held) > 1 else held
                    yield from near(int(cell) // shares >> 40, held[0], fps[middle:b].view(np.uint64))

    return run


def near_classes(classes: DataFrame, queries: DataFrame, radius: int, blocks: int) -> DataFrame:
    """query and near: for each queried fingerprint that has any, all other classes at most ``radius`` bits apart.

    Classes have fp, class_id and n_docs, one row for each fp; queries have distinct fp.
    """
    small_batches(classes.sparkSession)
    # a cell holds one of so many blocks' values; its classes are dealt in shares, and each query asks all of them
    shares = -(-classes.count() // (CELL_ROWS << 64 // blocks)) or 1
    share = F.pmod(F.xxhash64("fp"), F.lit(shares))
    index = classes.select(F.explode(block_cells(F.col("fp"), blocks, 0)).alias("cell"), share.alias("share"), "n_docs", "fp", "class_id")
    none = F.lit(None).cast("long")
    asked = queries.select(F.explode(block_cells(F.col("fp"), blocks, radius // blocks)).alias("cell"), "fp")
    asked = asked.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))).alias("share"), F.lit(0).cast("long").alias("n_docs"), "fp", none.alias("class_id"))
    rows = index.unionByName(asked).select((F.col("cell") * shares + F.col("share")).alias("cell"), "n_docs", "fp", "class_id")
    met = rows.repartition("cell").sortWithinPartitions("cell", F.col("n_docs").desc()).mapInArrow(_cell_pairs(radius, blocks, shares), f"query long, near {_NEAR}")
    return met.groupBy("query").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("near"))


def within_radius(index: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Pairs (query, fp) of distinct fingerprints at most ``radius`` bits apart, equal ones left out.

    Both inputs have a column fp and are taken as sets; nulls match nothing.
    """
    of = lambda df: df.select("fp").where("fp is not null").distinct()
    classes = of(index).select("fp", F.col("fp").alias("class_id"), F.lit(1).cast("long").alias("n_docs"))
    return near_classes(classes, of(queries), radius, blocks).select("query", F.explode("near.fp").alias("fp"))


def _hex(c: str):
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def fingerprint_report(docs: DataFrame, every: int = 20, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Fingerprints, likenesses and class of every row; rows whose doc_id is divisible by ``every``
    also search all fingerprints, equal ones too.

    class_id is the smallest doc_id with the fingerprint (null if none has one). n_near is, for
    searching rows, the number of other rows within the radius (null for the rest). near lists the
    other classes within the radius of a class with a searching row, on the row whose doc_id is
    the class_id (null on other rows): members of two classes are near if their classes are.
    """
    made = fingerprinted(docs)
    searches = F.coalesce(F.pmod("doc_id", F.lit(every)) == 0, F.lit(False))
    classes = keep(made.groupBy("fp").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_docs"), F.max(searches).alias("asked")), "classes")
    near = keep(near_classes(classes.drop("asked"), classes.where("asked").select("fp"), radius, blocks), "near-classes")
    others = near.select(F.col("query").alias("fp"), F.aggregate("near.n_docs", F.lit(0).cast("long"), lambda a, b: a + b).alias("n_others"))
    # a row whose class has no other and does not search knows all of its class
    facts = classes.where("n_docs > 1 or asked").join(others.hint("merge"), "fp", "left").drop("asked")
    most = max(HOT_COPIES, (classes.agg(F.sum("n_docs")).first()[0] or 0) // BROADCAST_CLASSES)
    large = facts.where(F.col("n_docs") > most).select(*(F.col(c).alias("large_" + c) for c in facts.columns))
    rows = made.join(F.broadcast(large), F.col("fp") == F.col("large_fp"), "left")
    found = [F.col("large_class_id").alias("class_id"), F.col("large_n_docs").alias("n_docs"), F.col("large_n_others").alias("n_others")]
    there = rows.where("large_fp is not null").select(*made.columns, *found)
    rest = rows.where("large_fp is null").select(*made.columns).join(facts.where(F.col("n_docs") <= most).hint("merge"), "fp", "left")
    rest = rest.select(*made.columns, F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_docs", F.lit(1)).alias("n_docs"), "n_others")
    lists = classes.where("asked").join(near.withColumnRenamed("query", "fp").hint("merge"), "fp", "left")
    lists = lists.select(F.col("fp").alias("list_fp"), F.col("class_id").alias("list_id"), F.coalesce("near", F.array().cast(_NEAR)).alias("near"))
    alike = lambda a, b: 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / 64
    out = there.unionByName(rest).join(lists.hint("merge"), (F.col("doc_id") == F.col("list_id")) & (F.col("fp") == F.col("list_fp")), "left")
    named = lambda x: F.struct(x["class_id"].alias("class_id"), _hex(x["fp"]).alias("fingerprint"), x["distance"].alias("distance"), x["n_docs"].alias("n_docs"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", _hex("fp").alias("fingerprint"), _hex("edited_fp").alias("edited_fingerprint"),
        alike("fp", "edited_fp").alias("near_edited"), alike("fp", "next_fp").alias("near_next"),
        F.when(searches, F.col("n_docs") - 1 + F.coalesce("n_others", F.lit(0))).cast("long").alias("n_near"),
        "class_id", F.transform("near", named).alias("near"),
    )


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with fingerprints and classes, and the neighbours of every twentieth."""
    return fingerprint_report(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
