import hashlib
import random

import pyarrow as pa
import pytest
from llm_words import words
from pyspark.sql import functions as F

from leafgrid.llm import fingerprints as f
from leafgrid.llm import textnum


def test_report_matches_brute_force(odd_docs, no_docs, spark):
    more = spark.createDataFrame([(k, words(k, 30)) for k in range(100, 140)], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(more).repartition(6)
    hashed = docs.withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.h, r.text or "") for r in hashed.collect()))
    want = []
    for k, (has, d, _, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][3]
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        x, y, z = f.simhashes([t, e, nxt])
        want.append((str(d if has else None), len(t), hashlib.sha256(e.encode()).hexdigest(), f"{x:016x}", f"{y:016x}", f.likeness(x, y), f.likeness(x, z)))
    got = [(str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in f.fingerprint_report(docs).collect()]
    assert sorted(got) == sorted(want)
    assert f.fingerprint_report(no_docs).count() == 0


def test_rows_without_ids_are_dealt_to_many_tasks(spark):
    docs = spark.createDataFrame([(None, words(k, 20)) for k in range(200)], "doc_id long, text string")
    hashed = sorted((r.h, r.text) for r in docs.withColumn("h", F.xxhash64("text")).collect())
    texts = [t for _, t in hashed]
    got = sorted(r.edited_sha256 for r in f.fingerprinted(docs).collect())
    assert got == sorted(hashlib.sha256(f.edited(t, texts[(k + 1) % 200]).encode()).hexdigest() for k, t in enumerate(texts))


def test_one_row_follows_itself(spark):
    r = f.fingerprint_report(spark.createDataFrame([(20, "a b c d")], "doc_id long, text string")).first()
    assert r.near_next == 1.0 and r.n_near == 0
    assert r.edited_sha256 == hashlib.sha256(b"a b " + b"a b").hexdigest()


@pytest.mark.parametrize("cell_rows", [200_000, 0.05])
def test_tables_find_all_within_radius(spark, monkeypatch, cell_rows):
    if cell_rows < 1:  # each cell in several shares
        monkeypatch.setattr(f, "near_classes", shared(f.near_classes, monkeypatch))
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = list(base)
    for x in base:
        for n in range(6):
            y = x
            for b in r.sample(range(64), n):
                y ^= 1 << b
            fps.append(y)
    signed = [f._signed(x) for x in fps]
    df = spark.createDataFrame([(x,) for x in [*signed, None]], "fp long")
    for radius, blocks in ((3, 6), (2, 4), (0, 2)):
        got = {(q.query % 2**64, q.fp % 2**64) for q in f.within_radius(df, df, radius, blocks).collect()}
        assert got == {(a, b) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= radius}


def shared(real, monkeypatch):
    def run(classes, queries, radius, blocks):
        class Few:
            """Counts as many classes, so that cells are dealt in five shares."""

            def __getattr__(self, name):
                return getattr(classes, name)

            def count(self):
                return 5 * (f.CELL_ROWS << 64 // blocks)

        return real(Few(), queries, radius, blocks)

    return run


def test_large_classes_by_broadcast(spark, monkeypatch, odd_docs):
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame([(k, words(5, 20)) for k in range(200, 260)], "doc_id long, text string"))
    key = lambda rows: sorted(((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.class_id, r.n_near, r.near) for r in rows), key=repr)
    whole = key(f.fingerprint_report(docs).collect())
    monkeypatch.setattr(f, "HOT_COPIES", 1)
    assert key(f.fingerprint_report(docs).collect()) == whole


def test_near_copies_are_near():
    a = words(1, 300).split()
    b = [w if k % 40 else "changed" for k, w in enumerate(a)]
    x, y, z = f.simhashes([" ".join(a), " ".join(b), words(2, 300)])
    assert f.likeness(x, y) > 0.8 > f.likeness(x, z)


def test_copies_are_neighbours_by_class(spark):
    long = words(5, 200).split()
    near = " ".join([*long[:-1], "changed"])
    rows = [(k, words(5, 200)) for k in range(19, 60)] + [(None, words(5, 200)), (70, near), (80, near), (100, words(8, 200)), (101, ""), (120, None)]
    fp = {k: f.simhashes([t])[0] for k, t in rows}
    distance = (fp[20] ^ fp[70]).bit_count()
    assert 0 < distance <= f.RADIUS < (fp[20] ^ fp[100]).bit_count()
    out = f.fingerprint_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows)
    assert {k: r.class_id for k, r in got.items()} == {k: {fp[20]: 19, fp[70]: 70, fp[100]: 100, 0: 101}[fp[k]] for k in got}
    assert {k: r.n_near for k, r in got.items() if r.n_near is not None} == {20: 43, 40: 43, 80: 43, 100: 0, 120: 1}
    lists = {k: [tuple(x) for x in r.near] for k, r in got.items() if r.near is not None}
    assert lists == {19: [(70, f"{fp[70]:016x}", distance, 2)], 70: [(19, f"{fp[20]:016x}", distance, 42)], 100: [], 101: []}


def test_near_copies_of_the_task_are_within_the_radius(spark):
    r = random.Random(11)
    rows, pairs = [], []
    while len(pairs) < 60:
        a = words(r.random(), r.randint(40, 400)).split()
        b = [x if r.random() > 0.02 else "changed" for x in a]
        x, y = (set(textnum.shingles(textnum.words(pa.array([" ".join(t)]))[0], 5).tolist()) for t in (a, b))
        if a != b and len(x & y) >= 0.8 * len(x | y):
            pairs.append((20 * len(pairs), 20 * len(pairs) + 1))
            rows += zip(pairs[-1], (" ".join(a), " ".join(b)), strict=True)
    fp = dict(zip([k for k, _ in rows], f.simhashes([t for _, t in rows]), strict=True))
    apart = [(fp[a] ^ fp[b]).bit_count() for a, b in pairs]
    assert max(apart) > 3
    out = {q.doc_id: q.n_near for q in f.fingerprint_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(out[a] == 1 for a, _ in pairs) == sum(d <= f.RADIUS for d in apart) >= 0.95 * len(pairs)
