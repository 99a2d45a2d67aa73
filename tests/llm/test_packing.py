import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leafgrid.llm import packing
from leafgrid.llm.bpe_ids import Encoder
from leafgrid.llm.store import keep

PATH = public_tokenizers.path("byte_bpe_50k.json")


def best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(bins) if r >= n]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit_decreasing(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 64, 100])
    lengths = [r.randint(1, capacity) for _ in range(r.randint(0, 200))]
    filled, ranks, at = Counter(), set(), {}
    for length, rank, n, first, each, base in packing.plan(dict(Counter(lengths)), capacity):
        for k in range(n):
            ranks.add((length, rank + k))
            at.setdefault(first + k // each, []).append((base + k % each * length, length))
    assert ranks == {(n, k) for n, c in Counter(lengths).items() for k in range(c)}
    for b, items in at.items():
        for offset, length in sorted(items):
            assert offset == filled[b]
            filled[b] += length
    assert sorted(capacity - v for v in filled.values()) == best_fit(lengths, capacity)


def test_segment_tree():
    t = packing.SegmentTree(10)
    assert t.tightest(0) is None
    for x in (3, 7, 10):
        t.add(x, 1)
    assert [t.tightest(x) for x in (0, 3, 4, 8, 10)] == [3, 3, 7, 10, 10]
    t.add(7, -1)
    assert t.tightest(4) == 10


def test_ids_are_those_of_the_library():
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    own = Encoder(PATH)
    r = random.Random(2)
    odd = ["", " ", "  ", " a", "a  b", "a \n b", "it's 's", "<|endoftext|> a<|endoftext|>", "123 4567", "é ñ  ü", "日本 語", "a  b"]
    odd += ["".join(r.choice([" ", " ", "a", "b", "\n", "\t", "é", "1", "'s", ".", "　", "ß"]) for _ in range(r.randint(1, 14))) for _ in range(1500)]
    for text in odd:
        assert own.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_packed_rows(odd_docs, no_docs, spark):
    own = Encoder(PATH)
    rows = packing.pack(odd_docs, PATH).collect()
    want = Counter()
    for x in odd_docs.collect():
        ids = np.append(own.ids(x.text), np.uint32(2)).astype("<u4")
        start = 0
        for k, n in enumerate(packing.cut_lengths(len(ids), 1024)):
            want[x.doc_id, k, start, n, zlib.crc32(ids[start : start + n].tobytes())] += 1
            start += n
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert len({r.sequence_id for r in rows}) == len(best_fit([r.length for r in rows], 1024))
    assert packing.pack(no_docs, PATH).count() == 0


def test_first_piece_is_the_short_one():
    assert packing.cut_lengths(2500, 1024) == [452, 1024, 1024]
    assert packing.cut_lengths(2048, 1024) == [1024, 1024]
    assert packing.cut_lengths(5, 1024) == [5]


def test_special_strings_are_text_unless_asked_for():
    text = "a<|endoftext|> b"
    assert Encoder(PATH).ids(text).tolist() == [64, 27, 91, 437, 1659, 5239, 91, 29, 275]
    assert Encoder(PATH, special=True).ids(text).tolist() == [64, 50256, 275] == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_groups_of_a_length_are_one_ranking(spark, odd_docs):
    """Many rows of one length and text, without ids, ranked in many groups."""
    rows = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a b c d").otherwise("x" * 3000).alias("text"))
    items = keep(packing.pieces(rows, PATH, capacity=64), "items")
    placed = packing.place(items, 64, group_rows=50).collect()
    assert len(placed) == items.count()
    filled = Counter()
    for r in sorted(placed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled[r.sequence_id]
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 64 and len(filled) == len(best_fit([r.length for r in placed], 64))


def test_a_row_of_white_space_does_not_end_the_job(spark):
    docs = spark.createDataFrame([(1, " " * 1_500_000), (2, "a")], "doc_id long, text string")
    rows = packing.pack(docs, PATH).collect()
    assert sum(r.length for r in rows) == len(Tokenizer.from_file(PATH).encode(" " * 1_500_000, add_special_tokens=False).ids) + 3
