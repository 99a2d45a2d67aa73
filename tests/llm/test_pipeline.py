import random

from llm_words import words

import corpus_pipeline as cp


def test_stages_on_a_small_corpus(spark, tmp_path):
    r = random.Random(1)
    good = lambda k: " ".join(w + r.choice(["", " the", " of", " and"]) for w in words(k, 90).split()) + "."
    rows = [(k, good(k)) for k in range(120)]
    rows += [(200, rows[3][1]), (201, rows[3][1] + " end"), (202, "short"), (203, " ".join(f"{w}###" for w in words(7, 90).split())), (204, None)]
    labels = [(d, 1, 0) for d in range(120)] + [(d, 0, 0) for d in (202, 203)] + [(1000 + k, 0, 0) for k in range(40)]
    rows += [(1000 + k, " ".join(f"{w}&&&" for w in words(900 + k, 90).split())) for k in range(40)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = docs
    for _, stage in cp.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
    assert {x.doc_id for x in now.collect()} == set(range(120))
    packed = cp.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in packed} == set(range(120))


def written(spark, folder, docs, labels):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_no_documents(spark, tmp_path, no_docs):
    folder = written(spark, str(tmp_path), no_docs, [])
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, no_docs, folder).count() == 0
    assert cp.run(spark, folder).count() == 0


def test_nulls_repeated_rows_and_clashing_columns(spark, tmp_path, odd_docs):
    """Rows that the rules keep come through whole: repeated ones, those without an id, further columns."""
    from pyspark.sql import functions as F

    r = random.Random(2)
    good = lambda k: " ".join(w + r.choice(["", " the", " of", " and"]) for w in words(k, 90).split()) + "."
    texts = [(k, good(k)) for k in range(30)] + [(None, good(40)), (None, good(41))]
    texts += [texts[3], texts[3], (300, texts[4][1]), (301, " " * 1_200_000 + good(42))]
    more = spark.createDataFrame([(d, t, None, "s", None, 1.0, "n", "c", "k") for d, t in texts], odd_docs.schema)
    docs = odd_docs.unionByName(more)
    folder = written(spark, str(tmp_path), docs, [(k, 1, 0) for k in range(30)] + [(6, 0, 0), (5, 0, 0)])
    now = docs
    for _, stage in cp.STAGES[:-1]:
        now = stage(spark, now, folder)
        assert now.columns == docs.columns
    kept = {(x.doc_id, x.text) for x in now.where(F.col("text").isNotNull()).collect()}
    assert kept >= {x for x in texts if x[0] != 300} and (300, texts[4][1]) not in kept
    packed = cp.run(spark, folder)
    assert {x.doc_id for x in packed.collect()} == {x.doc_id for x in now.collect()}
