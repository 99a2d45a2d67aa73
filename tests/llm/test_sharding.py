import zlib
from collections import Counter

import pytest

from leafgrid.llm.sharding import BUCKETS, Feistel, numbered, shard


@pytest.mark.parametrize("n", [1, 2, 3, 5, 24, 97, 1000, 4097])
def test_permutation_and_inverse(n):
    f = Feistel(n)
    to = [f.forward(k) for k in range(n)]
    assert sorted(to) == list(range(n))
    assert [f.backward(y) for y in to] == list(range(n))


def test_column_equals_python(spark):
    for n in (1, 7, 1000):
        f = Feistel(n)
        from pyspark.sql import functions as F

        got = spark.range(n).select("id", f.column(F.col("id")).alias("y")).collect()
        assert all(r.y == f.forward(r.id) for r in got)


def test_rows_law(odd_docs, no_docs, spark):
    rows = shard(odd_docs, 5).collect()
    texts = {(r.doc_id, r.text) for r in odd_docs.collect()}
    facts = {(d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in texts}
    assert {(r.doc_id, r["size"], r.text_crc32) for r in rows} == facts and len(rows) == odd_docs.count()
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    assert all(r.law == "rows" and r.grown_shard is None for r in rows)
    assert all(Feistel(len(rows)).forward(r.row_number) == r.slot * 5 + r.shard for r in rows)
    again = shard(odd_docs.repartition(7), 5).collect()
    key = lambda r: (str(r.doc_id), r.text_crc32, r.shard, r.slot)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert shard(no_docs).count() == 0


def test_rows_without_ids_spread_over_the_buckets(spark):
    from pyspark.sql import functions as F

    docs = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    slim = docs.select("doc_id", F.crc32(F.col("text").cast("binary")).alias("c"))
    rows, n = numbered(slim, ["doc_id", "c"])
    assert n == 4000 and sorted(r.row_number for r in rows.collect()) == list(range(n))
    largest = slim.groupBy(F.pmod(F.xxhash64("doc_id", "c"), F.lit(BUCKETS))).count().agg(F.max("count")).first()[0]
    assert largest < 40
