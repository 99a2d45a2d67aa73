"""Quality rules: a threshold table compiled into one projection of native expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Common words of the four languages of the corpus, lower case. Fixed values.
STOP_WORDS = (
    "a and are as at be but by for from have in is it not of on or that the this to was with "
    "als auf das dem den der des die ein eine für im ist mit nicht sich und von zu "
    "au avec dans de des du en est et la le les par pas pour qui que sur un une "
    "al con del el en es la las lo los para por que se su un una y"
).split()

SYMBOLS = "[#*$%&|<>]"
SPACE = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Rule:
    """``100 * part`` compared with ``percent * whole``; a count alone if whole is None."""

    name: str
    part: str
    whole: str | None
    low: float | None = None
    high: float | None = None

    def failed(self) -> Column:
        """True where a document breaks the rule; empty documents break none of the ratios."""
        value = F.col(self.part) * (100 if self.whole else 1)
        of = F.col(self.whole) if self.whole else F.lit(1)
        bad = F.lit(False)
        if self.low is not None:
            bad = bad | (value < F.lit(self.low) * of)
        if self.high is not None:
            bad = bad | (value > F.lit(self.high) * of)
        return bad


#: The rules that every document must pass, whatever else is asked.
BASE = (
    Rule("few_words", "n_words", None, low=50),
    Rule("repeated_words", "n_repeat_words", "n_words", high=50),
)
#: The rules of the method: percentages, word length in characters per 100 words.
RULES = (
    Rule("word_length", "word_chars", "n_words", low=250, high=1400),
    Rule("symbols", "n_symbols", "word_chars", high=4),
    Rule("stop_words", "n_stop_words", "n_words", low=4),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=60),
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is mentioned."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _covered(windows: Column) -> Column:
    """Positions of words that lie in a three-word window found twice; windows: their hashes."""

    def positions(ordered: Column) -> Column:
        def twice(x: Column, i: Column) -> Column:
            before, after = F.get(ordered, i - 1), F.get(ordered, i + 1)
            same = F.coalesce(before["h"] == x["h"], F.lit(False)) | F.coalesce(after["h"] == x["h"], F.lit(False))
            return F.when(same, x["i"]).otherwise(F.lit(-1))

        return F.sort_array(F.array_remove(F.transform(ordered, twice), -1))

    def spread(found: Column) -> Column:
        steps = F.transform(found, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(found, i + 1), x + 3) - x))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(let(ordered, positions), spread)


def _of_words(words: Column, stop_words: Sequence[str]) -> Column:
    n = F.size(words)
    hashes = F.transform(
        F.slice(words, F.lit(1), F.greatest(n - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)),
    )
    repeated = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h)))
    both = sorted({x for w in stop_words for x in (w, w.capitalize())})
    return F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        repeated.cast("long").alias("n_repeat_words"),
        F.size(F.filter(words, lambda x: x.isin(both))).cast("long").alias("n_stop_words"),
    )


def measures(docs: DataFrame, carried: Sequence[str] = ("doc_id",), stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """The carried columns of each row with the counts that rules use; a null text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = docs.select(
        *carried,
        let(words, lambda w: _of_words(w, stop_words)).alias("w"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(
            lines,
            lambda x: F.struct(
                F.size(x).cast("long").alias("n_lines"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            ),
        ).alias("l"),
    )
    return counted.select(*carried, "w.*", "n_symbols", "l.*")


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """Every document with its counts, ``base_failed``, ``kept`` and the names of the rules it breaks.

    One narrow projection: no shuffle, no user function. A null or empty text has no
    words and fails; repeated rows are judged one by one; further columns are ignored.
    """
    m = measures(docs, ("doc_id",), stop_words)
    failed = F.lit(False)
    for r in base:
        failed = failed | r.failed()
    broken = F.concat_ws(",", *(F.when(r.failed(), F.lit(r.name)) for r in (*base, *rules)))
    return (
        m.withColumn("base_failed", failed)
        .withColumn("broken_rules", broken)
        .withColumn("kept", F.col("broken_rules") == "")
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "base_failed", "kept", "n_stop_words", "n_lines", "broken_rules",
        )
    )


def keep_clean(docs: DataFrame, rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE) -> DataFrame:
    """The rows of ``docs`` that break no rule, with the columns they came with.

    A null or empty text has no words and goes; a null doc_id does not matter; repeated rows are
    judged one by one; no rows give no rows.
    """
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col("text"))
    bad = F.lit(False)
    for r in (*base, *rules):
        bad = bad | r.failed()
    return measures(rows, ("__row",)).where(~bad).select("__row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its counts and the verdict of the rules."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _rule_sql(r: Rule) -> str:
    value = f"{'100 * ' if r.whole else ''}{r.part}"
    of = f" * {r.whole}" if r.whole else ""
    tests = [f"{value} < {r.low}{of}"] * (r.low is not None) + [f"{value} > {r.high}{of}"] * (r.high is not None)
    return "(" + " OR ".join(tests) + ")"


def oracle() -> str:
    """The same rows in DuckDB's SQL."""
    both = ", ".join("'" + x.replace("'", "''") + "'" for x in sorted({x for w in STOP_WORDS for x in (w, w.capitalize())}))
    broken = ", ".join(f"CASE WHEN {_rule_sql(r)} THEN '{r.name}' END" for r in (*BASE, *RULES))
    base = " OR ".join(_rule_sql(r) for r in BASE)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
e AS (SELECT r, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT r, i, x || chr(1) || lead(x, 1) OVER o || chr(1) || lead(x, 2) OVER o AS t FROM e WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS c FROM g WHERE t IS NOT NULL),
hit AS (SELECT r, count(DISTINCT i + k.k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) AS k(k) WHERE c > 1 GROUP BY r),
s AS (SELECT r, count(*) FILTER (WHERE x IN ({both})) AS n_stop_words FROM e GROUP BY r),
l AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  coalesce(n_stop_words, 0)::BIGINT AS n_stop_words, len(ls)::BIGINT AS n_lines
  FROM d JOIN w USING (r) JOIN l USING (r) LEFT JOIN hit USING (r) LEFT JOIN s USING (r)),
j AS (SELECT *, ({base}) AS base_failed, concat_ws(',', {broken}) AS broken_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, broken_rules = '' AS kept,
  n_stop_words, n_lines, broken_rules FROM j"""
