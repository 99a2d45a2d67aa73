"""N-gram Jaccard join: exact links between texts whose shingle sets agree by 80 of 100.

Steps
1. One pass gives each text a digest of its words, its number of shingles, and a share of
   a count sketch of all shingles. Texts of equal words form a class; its smallest doc_id
   stands for it. Large classes, a bounded list, reach their rows by a broadcast.
2. One pass orders each class's shingles rare first (by the sketch, then by hash) and emits
   its prefix: a linked partner must share a shingle of it. Entries are dealt and sorted by
   shingle, those of a shingle that the sketch calls frequent by a share of the documents too;
   those that one class alone has go at once, and each other entry gets the smallest class
   of its shingle, its centre, beside it.
3. Pairs that share a prefix shingle pass the length and positional filters and are made
   distinct; a suffix filter bounds the overlap by how both sets, prefix and suffix, spread over 128 cells of
   the hash space; what is left is verified once on the whole sets.
4. The first round pairs each entry with its centre alone, and links are contracted to
   components. Pairs inside one component need no test, so that a later round pairs only
   strays, entries whose component is not their centre's, with the entries of other
   components that share their shingle. Every link between components is found; large
   groups of near copies cost their size, not its square.

The sketch only orders shingles, so its errors cost time and never change the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrid.llm import textnum
from leafgrid.llm.messages import pressed, released
from leafgrid.llm.store import forget, keep, small_batches

WORDS = 5
#: Two sets link at SHARE[0] / SHARE[1] or more.
SHARE = (80, 100)
#: Counters of the sketch and the parts that tasks send them in.
SKETCH, PARTS = 1 << 20, 16
#: Cells of the suffix filter.
CELLS = 128
#: Ids up to this number go to all executors (16 MB); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Entries of one shingle that are dealt to one task, about, and copies of one text that a shuffle brings together.
HOT_ENTRIES, HOT_COPIES = 1_000, 500
#: All remaining pairs are made when they are at most so many for each entry; else rounds of stars shrink them first.
PAIRS_PER_ENTRY = 32
STAR_ROUNDS = 2


def shingle_set(hashes: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Distinct shingle hashes of a text's words, ascending."""
    return np.unique(textnum.shingles(hashes, words))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, np.ndarray]]:
    for batch in batches:
        for part in textnum.by_size(batch, "text"):
            found, _, bounds = textnum.words(part.column("text"))
            for i, doc in enumerate(part.column("doc_id").to_pylist()):
                yield doc, found[bounds[i] : bounds[i + 1]]


_FACTS = "doc_id long, n_shingles long, d1 long, d2 long, part int, counts binary"


def _facts(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.uint32)
        rows: list[tuple] = []
        schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("part", pa.int32()), ("counts", pa.binary())])

        def made(of: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*of), schema, strict=True)], schema=schema)

        for doc, hashes in _texts(batches):
            own = shingle_set(hashes, words)
            cells = (own & np.uint64(SKETCH - 1)).astype(np.int64)
            if len(own) > SKETCH // 64:
                counts += np.bincount(cells, minlength=SKETCH).astype(np.uint32)
            else:
                np.add.at(counts, cells, np.uint32(1))
            rows.append((doc, len(own), *textnum.digests(hashes), None, None))
            if len(rows) >= 20_000:
                yield made(rows)
                rows = []
        if rows:
            yield made(rows)
        if counts.any():
            small = counts.reshape(PARTS, -1)
            yield made([(None, None, None, None, k, pressed(small[k].tobytes())) for k in range(PARTS)])

    return run


def _sum(pdf):
    """The sum of some counters of one part."""
    import pandas as pd

    total = np.zeros(SKETCH // PARTS, np.uint64)
    for blob in pdf["counts"]:
        total += np.frombuffer(released(blob, 4 * SKETCH // PARTS), np.uint32)
    total = np.minimum(total, 2**32 - 1).astype(np.uint32)
    return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "counts": [pressed(total.tobytes())]})


def _sketch(facts: DataFrame, together: int = 256) -> np.ndarray:
    """The summed counters: 4 MB, whatever the input. They are added in levels, ``together`` of a part at a time."""
    rows = facts.where("part is not null").select("part", "counts", F.monotonically_increasing_id().alias("n"))
    count = rows.count() // PARTS
    made = None
    while count > together:
        count = -(-count // together)
        summed = rows.groupBy("part", F.pmod(F.xxhash64("n"), F.lit(count)).alias("g")).applyInPandas(_sum, "part int, counts binary")
        before, made = made, keep(summed, "counters")
        if before is not None:
            forget(before)
        rows = made.withColumn("n", F.monotonically_increasing_id())
    out = np.zeros((PARTS, SKETCH // PARTS), np.uint32)
    for r in rows.groupBy("part").applyInPandas(_sum, "part int, counts binary").collect():
        out[r["part"]] = np.frombuffer(released(r["counts"], 4 * SKETCH // PARTS), np.uint32)
    if made is not None:
        forget(made)
    return out.reshape(-1)


def prefix_length(n: np.ndarray | int, share: tuple[int, int] = SHARE):
    """Shingles of a set of n of which a linked partner must have one."""
    return n - -(-n * share[0] // share[1]) + 1


_ENTRY = "tok long, salt int, doc long, n int, pos int"
_CENTRED = _ENTRY + ", rank int, c_doc long, c_n int, c_pos int"


def _prefixes(sketch, words: int, share: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        held, size = [], 0
        for doc, hashes in _texts(batches):
            own = shingle_set(hashes, words)
            n = len(own)
            if doc is None or not n:
                continue
            seen = counts[(own & np.uint64(SKETCH - 1)).astype(np.int64)]
            rare = np.argsort(seen, kind="stable")[: prefix_length(n, share)]
            shares = seen[rare] // HOT_ENTRIES
            salt = np.where(shares > 0, 1 + _spread(doc) % (shares.astype(np.uint64) + np.uint64(1)), 0)
            held.append((own[rare].view(np.int64), salt.astype(np.int32), doc, n))
            size += len(rare)
            if size > 200_000:
                yield _entries(held)
                held, size = [], 0
        if held:
            yield _entries(held)

    return run


def _spread(doc: int) -> np.uint64:
    return textnum.mix(np.array([doc], np.int64).view(np.uint64))[0]


def _entries(held: list[tuple]) -> pa.RecordBatch:
    toks, salts, docs, sizes = zip(*held, strict=True)
    long = np.array([len(t) for t in toks])
    starts = np.concatenate([[0], np.cumsum(long)[:-1]])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate(toks)),
            pa.array(np.concatenate(salts)),
            pa.array(np.repeat(np.array(docs, np.int64), long)),
            pa.array(np.repeat(np.array(sizes, np.int32), long)),
            pa.array((np.arange(long.sum()) - np.repeat(starts, long)).astype(np.int32)),
        ],
        names=["tok", "salt", "doc", "n", "pos"],
    )


def _shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of entries sorted by shingle, share and class, those whose shingle another has, with their rank in it and its first entry.

    Entries of a frequent shingle's share all stay, as other shares may have it. Equal entries
    count once. The last entry seen is held back until the next one is known.
    """
    names = ["tok", "salt", "doc", "n", "pos", "rank", "c_doc", "c_n", "c_pos"]
    held: list[np.ndarray] | None = None
    run = None  # rank and first entry of the run that the held row is in
    for batch in batches:
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        fresh = np.ones(len(cols[0]), bool)
        fresh[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
        tok, salt, doc, n, pos = cols = [c[fresh] for c in cols]
        begins = np.ones(len(tok), bool)
        begins[1:] = (tok[1:] != tok[:-1]) | (salt[1:] != salt[:-1])
        first = np.flatnonzero(begins)
        of = np.cumsum(begins) - 1
        rank = np.arange(len(tok)) - first[of]
        c_doc, c_n, c_pos = doc[first][of], n[first][of], pos[first][of]
        if run is not None:  # the first rows go on with a run that began before
            own = of == 0
            rank[own] += run[0]
            c_doc[own], c_n[own], c_pos[own] = run[1:]
        shared = (rank > 0) | (salt > 0)
        shared[:-1] |= ~begins[1:]
        held, run = [c[-1:] for c in cols], (int(rank[-1]), c_doc[-1], c_n[-1], c_pos[-1])
        out = [c[:-1][shared[:-1]] for c in (*cols, rank.astype(np.int32), c_doc, c_n, c_pos)]
        if len(out[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=names)
    if held is not None and (run[0] > 0 or held[1][0] > 0):
        last = [*held, np.array([run[0]], np.int32), *(np.array([v]) for v in run[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in last], names=names)


def _centred(entries: DataFrame) -> DataFrame:
    """Entries with the centre of their shingle: those of frequent shingles, dealt in shares, get that of all shares.

    Their rank is the number of the shingle's entries, and entries that no other class shares go.
    """
    hot = entries.where("salt > 0")
    centres = hot.groupBy("tok").agg(F.count("*").alias("k"), F.min(F.struct("c_doc", "c_n", "c_pos")).alias("c")).where("k > 1")
    centres = keep(centres, "centres")
    if centres.isEmpty():
        return entries.where("salt = 0").drop("salt")
    own = hot.select("tok", "doc", "n", "pos").join(_small(centres), "tok")
    own = own.select("tok", "doc", "n", "pos", F.least("k", F.lit(2**31 - 1)).cast("int").alias("rank"), "c.c_doc", "c.c_n", "c.c_pos")
    return keep(entries.where("salt = 0").drop("salt").unionByName(own), "entries")


_SETS = "doc long, n int, cells binary, shingles binary"


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def made() -> pa.RecordBatch:
            docs, ns, cells, sets = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ns, pa.int32()), pa.array(cells, pa.binary()), pa.array(sets, pa.binary())], names=["doc", "n", "cells", "shingles"])

        for doc, hashes in _texts(batches):
            own = shingle_set(hashes, words)
            spread = np.bincount((own >> np.uint64(57)).astype(np.int64), minlength=CELLS).astype(np.uint32)
            held.append((doc, len(own), spread.tobytes(), own.tobytes()))
            size += 8 * len(own)
            if size > 4_000_000:
                yield made()
                held, size = [], 0
        if held:
            yield made()

    return run


def _overlap_needed(n: np.ndarray, m: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """The least overlap of linked sets of n and m."""
    return -(-share[0] * (n.astype(np.int64) + m) // (share[0] + share[1]))


def _suffix_filter(share: tuple[int, int]):
    """Pairs whose sets can still overlap enough, by how both spread over the cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, CELLS) for c in ("cells_a", "cells_b"))
                most = np.minimum(x, y).sum(axis=1, dtype=np.int64)
                n, m = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b"))
                yield batch.select(["a", "b"]).filter(pa.array(most >= _overlap_needed(n, m, share)))

    return run


def _verify(share: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(share[1] * both >= share[0] * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _possible(n, m, i, j, share: tuple[int, int]):
    """Length and positional filter as expressions; i, j: places of a shared shingle.

    Were it the first that both share, no more than it and what follows could be shared. The
    first one of a link passes, so that a pair may be made of those that pass alone.
    """
    small, large = F.least(n, m), F.greatest(n, m)
    most = 1 + F.least(n - i - 1, m - j - 1)
    return (share[1] * small >= share[0] * large) & ((share[0] + share[1]) * most >= share[0] * (n + m))


def _small(ids: DataFrame) -> DataFrame:
    """The rows of ids, sent to all executors if they are few, and otherwise joined by a shuffle; ids is a written table."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge")


def components(links: DataFrame) -> DataFrame:
    """(doc, comp) for every end of a link that is not the smallest doc it reaches: comp is that doc.

    Each round hooks every doc to the smallest beside it, follows hooks to their roots by
    doubling, and goes on with the links between different roots. Groups are reduced by a
    minimum alone; each round is written out.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    rounds: list[DataFrame] = []
    while True:
        # of each link the larger end hooks; a doc's hook is the smallest doc beside it
        hooks = keep(edges.groupBy("u").agg(F.min("v").alias("r")), "hooks")
        while True:
            up = _small(hooks.select(F.col("u").alias("r"), F.col("r").alias("r2")))
            further = hooks.join(up, "r")
            if further.isEmpty():
                break
            before, hooks = hooks, keep(hooks.join(up, "r", "left").select("u", F.coalesce("r2", "r").alias("r")), "hooks")
            forget(before)
        rounds.append(hooks)
        to = _small(hooks)
        at = lambda c: to.select(F.col("u").alias(c), F.col("r").alias(f"{c}_r"))  # noqa: B023, E731
        moved = edges.join(at("u"), "u", "left").join(at("v"), "v", "left")
        moved = moved.select(F.coalesce("u_r", "u").alias("x"), F.coalesce("v_r", "v").alias("y")).where("x <> y")
        edges = keep(moved.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges")
        if edges.isEmpty():
            break
    out = rounds[0]
    for later in rounds[1:]:
        # roots that a later round moved, and what hooked to them
        moved = _small(later.select(F.col("u").alias("r"), F.col("r").alias("r2")))
        out = keep(out.join(moved, "r", "left").select("u", F.coalesce("r2", "r").alias("r")).unionByName(later), "hooks")
    return out.select(F.col("u").alias("doc"), F.col("r").alias("comp"))


def near_duplicates(docs: DataFrame, words: int = WORDS, share: tuple[int, int] = SHARE) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``.

    Empty and null texts have no shingles and stand alone; repeated texts are linked;
    rows of one doc_id are one document to links; a row without doc_id links with
    nothing and has a null component; no rows give no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    facts = keep(docs.mapInArrow(_facts(words), _FACTS), "facts")
    sketch = spark.sparkContext.broadcast(_sketch(facts))
    named = keep(_classes(facts.where("part is null").select("doc_id", "n_shingles", "d1", "d2")), "classes")
    forget(facts)
    # doc_ids all of whose texts another stands for
    copies = named.where("rep is not null").groupBy("doc_id").agg(F.bool_and(F.col("rep") != F.col("doc_id")).alias("copy")).where("copy").select("doc_id")
    copies = keep(copies, "copies")
    entries = (
        docs.join(_small(copies), "doc_id", "left_anti")
        .mapInArrow(_prefixes(sketch, words, share), _ENTRY)
        .repartition("tok", "salt")
        .sortWithinPartitions("tok", "salt", "doc", "n", "pos")
        .mapInArrow(_shared_only, _CENTRED)
    )
    entries = _centred(keep(entries, "entries"))
    forget(copies)
    links = _links(docs, entries, words, share)
    # equal words but another representative: one link to it
    same = named.where("rep <> doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    comps = _small(components(links.unionByName(same)).withColumnRenamed("doc", "doc_id"))
    out = named.join(comps, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"))


def _classes(rows: DataFrame) -> DataFrame:
    """doc_id, n_shingles and rep: the smallest doc_id with the same words, null without words or without doc_id.

    The classes of many rows reach these by a broadcast: at most BROADCAST_IDS of them, as each has
    more than its share of the rows.
    """
    same = ["n_shingles", "d1", "d2"]
    whole = rows.where("n_shingles > 0 and doc_id is not null")
    classes = keep(whole.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("k")).where("k > 1"), "copies")
    most = max(HOT_COPIES, (classes.agg(F.sum("k")).first()[0] or 0) // BROADCAST_IDS)
    large = classes.where(F.col("k") > most).select(*same, F.col("rep").alias("large"))
    small = classes.where(F.col("k") <= most).select(*same, F.col("rep").alias("small"))
    known = rows.join(F.broadcast(large), same, "left")
    # a row of a large class, or of none, has its place already and needs no partner
    word = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    others = known.where("large is null").drop("large").join(small.hint("merge"), same, "left")
    others = others.select("doc_id", "n_shingles", F.when(word, F.coalesce("small", "doc_id")).alias("rep"))
    return known.where("large is not null").select("doc_id", "n_shingles", F.when(word, F.col("large")).alias("rep")).unionByName(others)


def _strays(entries: DataFrame, comps: DataFrame) -> DataFrame:
    """Entries with their component and their centre's, where these differ."""
    to = _small(comps)
    own, centre = to, to.select(F.col("doc").alias("c_doc"), F.col("comp").alias("c_comp"))
    both = entries.join(own, "doc", "left").join(centre, "c_doc", "left")
    both = both.withColumn("comp", F.coalesce("comp", "doc")).withColumn("c_comp", F.coalesce("c_comp", "c_doc"))
    return keep(both.where("comp <> c_comp"), "strays")


def _pairs(rows: DataFrame, of: tuple[str, str, str], share: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of each row's entry and the entry in the columns ``of`` that pass length and positional filter."""
    doc, n, pos = (F.col(c) for c in of)
    possible = rows.where(F.col("doc") != doc).where(_possible(F.col("n"), n, F.col("pos"), pos, share))
    return possible.select(F.least("doc", doc).alias("a"), F.greatest("doc", doc).alias("b"))


def _links(docs: DataFrame, entries: DataFrame, words: int, share: tuple[int, int]) -> DataFrame:
    """Verified links (a, b) that join all classes that any links join."""
    spark = docs.sparkSession
    links = spark.createDataFrame([], "a long, b long")
    ids = keep(entries.select(F.col("doc").alias("doc_id")).distinct(), "ids")
    if ids.isEmpty():
        return links
    sets = keep(docs.join(_small(ids), "doc_id", "left_semi").mapInArrow(_sets(words), _SETS), "sets")
    pairs = keep(_pairs(entries, ("c_doc", "c_n", "c_pos"), share).distinct(), "pairs")
    tested = pairs
    for turn in range(STAR_ROUNDS + 1):
        links = links.unionByName(keep(_verified(pairs, sets, share), "links"))
        strays = _strays(entries, components(links))
        left, deepest = strays.agg(F.count("*"), F.max("rank")).first()
        if not left:
            return links
        most = PAIRS_PER_ENTRY * entries.count() + 1_000_000
        whole = turn == STAR_ROUNDS or left * (deepest + 1) <= most
        of_tok = strays.groupBy("tok").agg(F.count("*").alias("k"), F.min_by(F.struct("doc", "n", "pos", "comp"), F.xxhash64(F.col("doc"), F.lit(turn))).alias("s"))
        if not whole:  # a closer count
            whole = (entries.join(of_tok, "tok").agg(F.sum("k")).first()[0] or 0) <= most
        if whole:
            break
        # a star around one stray of each shingle, chosen anew each round
        around = strays.join(of_tok, "tok").where("comp <> s.comp")
        pairs = keep(_pairs(around, ("s.doc", "s.n", "s.pos"), share).distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = tested.unionByName(pairs)
    one = strays.select("tok", "doc", "n", "pos", "comp", "c_comp")
    # every other entry of the shingle: those of the centre's component, and strays of a third one once
    to = _small(components(links))
    other = entries.join(to, "doc", "left").select("tok", F.col("doc").alias("doc2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.coalesce("comp", "doc").alias("comp2"))
    met = one.join(other, "tok").where("comp <> comp2 and (comp2 = c_comp or doc < doc2)")
    pairs = keep(_pairs(met, ("doc2", "n2", "pos2"), share).distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
    return links.unionByName(keep(_verified(pairs, sets, share), "links"))


def _verified(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Of distinct pairs the linked ones: suffix filter on the cells, then the whole sets."""
    left = sets.select(F.col("doc").alias("a"), F.col("n").alias("n_a"), F.col("cells").alias("cells_a"))
    right = sets.select(F.col("doc").alias("b"), F.col("n").alias("n_b"), F.col("cells").alias("cells_b"))
    near = keep(pairs.join(right, "b").join(left, "a").mapInArrow(_suffix_filter(share), "a long, b long"), "near")
    left = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("sb"))
    return near.join(right, "b").join(left, "a").select("a", "b", "sa", "sb").mapInArrow(_verify(share), "a long, b long")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies: that of the smallest doc_id; rows without doc_id stay, and so do
    rows without text and those that repeat the smallest doc_id itself."""
    found = near_duplicates(docs)
    gone = keep(found.where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    return docs.join(_small(gone), "doc_id", "left_anti").select(*docs.columns)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its shingle set and the component its links make."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
