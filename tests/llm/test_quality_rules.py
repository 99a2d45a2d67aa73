import re

from leafgrid.llm import quality_rules as q


def brute(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, covered = {}, set()
    for i in range(len(ws) - 2):
        seen.setdefault(tuple(ws[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered.update(i + k for i in at for k in range(3))
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_match_brute_force(odd_docs, spark):
    more = spark.createDataFrame([(100, "a b c a b c a b c"), (101, "a a a a a"), (102, "a b c d a b c"), (103, "x\nx\n\n \nx\ny # & |"), (104, "a b c\x1cd")], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(more)
    texts = sorted((str(r.doc_id), brute(r.text)) for r in docs.collect())
    got = sorted((str(r.doc_id), (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in q.judge(docs).collect())
    assert got == texts


def test_verdicts(spark, no_docs):
    good = " ".join(f"word{k} the of" for k in range(40)) + "."
    rows = [(1, good), (2, "short text"), (3, "the cat sat " * 40), (4, " ".join(f"###w{k} of" for k in range(60))), (5, " ".join(f"qqqq{k}" for k in range(60)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in q.judge(docs).collect()}
    assert got[1].kept and not got[1].base_failed
    assert got[2].base_failed and got[3].base_failed
    assert not got[4].kept and got[4].broken_rules == "symbols"
    assert not got[5].kept and got[5].broken_rules == "stop_words"
    assert [r.doc_id for r in q.keep_clean(docs).collect()] == [1]
    assert q.judge(no_docs).count() == 0 and q.keep_clean(no_docs).columns == no_docs.columns


def test_stage_keeps_columns_and_clashing_names(odd_docs):
    assert q.keep_clean(odd_docs.withColumnRenamed("kind", "n_words")).columns == odd_docs.withColumnRenamed("kind", "n_words").columns


def test_no_python_in_plan(odd_docs):
    plan = q.judge(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
