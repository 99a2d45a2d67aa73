from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F

from leafgrid.llm import token_counts as tc
from leafgrid.llm.bpe_ids import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_report_matches_brute_force(odd_docs, no_docs):
    own, n, k = Encoder(PATH), Counter(), Counter()
    for r in odd_docs.collect():
        size = len(own.ids(r.text)) + 1
        for key in {("v", r.source, r.lang, 0), ("v", r.source, None, 1), ("v", None, None, 2), (None, None, None, 3)}:
            n[key] += 1
            k[key] += size
    rows = tc.maintained(odd_docs, PATH, "v").collect()
    assert {(r.version, r.source, r.lang, r.level): (r.n_docs, r.n_tokens) for r in rows} == {x: (n[x], k[x]) for x in n}
    assert {r.level for r in tc.maintained(no_docs, PATH, "v").collect()} <= {3}


def test_ledger_is_additive_and_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(1, "s", "en", "v", 5), (2, "s", "de", "v", 7), (3, None, "en", "v", 2)], "doc_id long, source string, lang string, version string, n_tokens long")
    ledger = tc.Ledger(spark, str(tmp_path / "ledger"))
    totals = lambda: {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in ledger.totals().collect()}
    assert totals() == {} and ledger.version() == 0
    assert ledger.commit("a", tc.inserts(rows)) and not ledger.commit("a", tc.inserts(rows))
    assert totals() == {("s", "en"): (1, 5), ("s", "de"): (1, 7), (None, "en"): (1, 2)}
    assert ledger.commit("b", tc.revisions(rows.where("doc_id = 1"), F.lit(9)))
    assert totals()["s", "en"] == (1, 9)
    assert ledger.commit("c", tc.deletes(rows.where("doc_id = 2"))) and not ledger.commit("c", tc.deletes(rows))
    assert totals() == {("s", "en"): (1, 9), (None, "en"): (1, 2)}
    assert sorted(r.batch for r in ledger.batches().collect()) == ["a", "b", "c"]
    again = tc.Ledger(spark, str(tmp_path / "ledger"))
    assert again.version() == 3 and not again.commit("b", tc.inserts(rows))


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    """A writer that finds its version taken starts again from the one that is there."""
    rows = spark.createDataFrame([(1, "s", "en", "v", 5)], "doc_id long, source string, lang string, version string, n_tokens long")
    one, two = (tc.Ledger(spark, str(tmp_path / "ledger")) for _ in range(2))
    publish, other = one._publish, iter(["b", "a"])

    def late(version, record):
        name = next(other, None)
        if name == "b":
            assert two.commit(name, tc.inserts(rows))
        return publish(version, record)

    monkeypatch.setattr(one, "_publish", late)
    assert one.commit("a/..\\ü", tc.inserts(rows))
    assert two.version() == 2 and [(r.n_docs, r.n_tokens) for r in two.totals().collect()] == [(2, 10)]
    assert sorted(r.batch for r in two.batches().collect()) == ["a/..\\ü", "b"]
    assert not two._publish(1, {"batch": "c", "totals": "none"}) and two.version() == 2
    # the other writer may even have committed the same batch
    monkeypatch.setattr(one, "_publish", lambda v, r: two.commit("z", tc.inserts(rows)) and publish(v, r))
    assert not one.commit("z", tc.inserts(rows)) and two.totals().first().n_docs == 3


def test_very_long_runs_of_space_are_counted(spark):
    texts = [" " * 1_200_000, "\n" * 1_100_000, " \n\t" * 400_000 + "x", "a" * 1_000_000, "  x" * 300_000]
    docs = spark.createDataFrame([(k, t, "s", "en") for k, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    want = {k: len(library.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in tc.counted(docs, PATH, "v").collect()} == want
