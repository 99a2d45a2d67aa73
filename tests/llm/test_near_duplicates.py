import random
from collections import defaultdict

import pytest

from leafgrid.llm import near_duplicates as nd
from leafgrid.llm.store import keep
from llm_words import words


def brute(rows):
    low = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    sets = []
    for d, t in rows:
        w = (t or "").encode().translate(low).split()
        sets.append((d, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and 100 * len(x & y) >= 80 * len(x | y):
                p, q = top(a), top(b)
                up[max(p, q)] = min(p, q)
    return sorted((str(d), len(s), None if d is None else top(d)) for d, s in sets)


def got(df):
    return sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in nd.near_duplicates(df).collect())


def edits(text, n, r):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("per_entry, hot, copies", [(4, 1_000, 500), (0, 1_000, 500), (4, 3, 2), (0, 1, 1)])
def test_components_match_brute_force(spark, monkeypatch, per_entry, hot, copies):
    monkeypatch.setattr(nd, "PAIRS_PER_ENTRY", per_entry)
    monkeypatch.setattr(nd, "HOT_ENTRIES", hot)
    monkeypatch.setattr(nd, "HOT_COPIES", copies)
    r = random.Random(5)
    rows, k = [], 0
    for g in range(12):
        base = words(g, r.randint(20, 160))
        for _ in range(r.randint(1, 9)):
            rows.append((k, edits(base, r.randint(0, 6), r)))
            k += 3
        base = edits(base, 4, r)  # a chain: its end is far from its beginning
        for _ in range(4):
            base = edits(base, 2, r)
            rows.append((k, base))
            k += 1
    rows += [(20_000 + i, words(778 + i % 3, 40)) for i in range(20)]
    shared = words(777, 60)
    rows += [(10_000 + i, shared + " " + words(3000 + i, r.choice([5, 10, 200]))) for i in range(30)]
    r.shuffle(rows)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(x.doc_id, x.text) for x in odd_docs.collect()]
    assert got(odd_docs) == brute(rows)
    assert nd.near_duplicates(no_docs).count() == 0
    kept = nd.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {x.doc_id for x in kept.collect()} == {1, 4, 5, 6, None, 7, 9, 20, 40}


def test_large_group_of_near_copies_makes_few_pairs(spark, monkeypatch):
    r = random.Random(8)
    base = words(5, 150)
    rows = [(k, edits(base, 1, r)) for k in range(300)]
    seen = defaultdict(int)
    verified = nd._verified
    monkeypatch.setattr(nd, "_verified", lambda pairs, *a: (seen.__setitem__("n", seen["n"] + pairs.count()), verified(pairs, *a))[1])
    out = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x.component_id for x in out.collect()} == {0}
    assert seen["n"] < 10 * len(rows)


def test_prefix_length():
    assert [nd.prefix_length(n) for n in (1, 4, 5, 10, 100)] == [1, 1, 2, 3, 21]


def test_counters_are_added_in_levels(spark):
    docs = spark.createDataFrame([(k, words(k % 7, 30)) for k in range(40)], "doc_id long, text string").repartition(20)
    facts = keep(docs.mapInArrow(nd._facts(5), nd._FACTS), "facts")
    whole = nd._sketch(facts)
    assert (nd._sketch(facts, together=2) == whole).all() and whole.sum() == sum(len(nd.shingle_set(hashes)) for hashes in sets(docs))


def sets(docs):
    import pyarrow as pa

    from leafgrid.llm import textnum

    for r in docs.collect():
        yield textnum.words(pa.array([r.text]))[0]
