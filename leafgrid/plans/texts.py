"""Queries of extraction and classification on phrases."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafgrid import sources
from leafgrid.catalogue import query
from leafgrid.functions import text as t
from leafgrid.operators import classify as k
from leafgrid.plans import common as c

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_K = ", ".join(KEYS)
_FX = f"ph AS ({sources.view('phrases')})"
def X():
    return F.col("text")


def _phrases(spark, sf_dir):
    return sources.entity(spark, sf_dir, "phrases")


def _hits(words, column: str = "lt") -> str:
    return "(" + " + ".join(f"contains({column}, '{w.lower()}')::INT" for w in words) + ")"


def _best(scores: dict[str, str], none: str | None = None) -> str:
    """The first name of the greatest score."""
    top = f"greatest({', '.join(scores.values())})"
    cases = " ".join(f"WHEN {v} = {top} THEN '{n}'" for n, v in scores.items())
    return f"CASE {f'WHEN {top} <= 0 THEN {chr(39)}{none}{chr(39)} ' if none else ''}{cases} END"


@query(f"WITH {_FX} SELECT {_K}, name, value, 'regex' AS source, 0.8::DOUBLE AS confidence FROM (" + " UNION ALL ".join(f"SELECT {_K}, '{n}' AS name, unnest(regexp_extract_all(text, '{p}', 1)) AS value FROM ph" for n, p in t.CONDITIONS.items()) + ")")
def conditions(spark, sf_dir):
    return _phrases(spark, sf_dir).select(*KEYS, F.explode(t.conditions(X())).alias("c")).select(*KEYS, "c.*")


@query(f"""WITH {_FX}, m AS (SELECT {_K}, text, list_filter(regexp_extract_all(text, '{t.MATERIAL}', 0), lambda x: length(x) > 1 AND x NOT IN ('The', 'In', 'On', 'At', 'To', 'For')) AS l FROM ph)
SELECT {_K}, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:10], ',') AS materials FROM m""")
def materials(spark, sf_dir):
    return _phrases(spark, sf_dir).select(*KEYS, F.concat_ws(",", t.materials(X())).alias("materials"))


_MEASURE = t.MEASUREMENT
_UNITS = f"regexp_extract_all(text, '{_MEASURE}', 3)"


@query(f"""WITH {_FX}, m AS (SELECT *, regexp_extract_all(text, '{_MEASURE}', 1)[1:20] AS v, {_UNITS}[1:20] AS u, {_UNITS} AS a FROM ph)
SELECT {_K}, array_to_string(list_transform(v, lambda x, i: x || ' ' || u[i]), ',') AS measurements, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i)[1:10], ',') AS units FROM m""")
def measurements(spark, sf_dir):
    both = F.transform(t.measurements(X()), lambda s: F.concat(s["value"], F.lit(" "), s["unit"]))
    return _phrases(spark, sf_dir).select(*KEYS, F.concat_ws(",", both).alias("measurements"), F.concat_ws(",", t.units(X())).alias("units"))


_LOOK = f"lo AS (SELECT *, lower(text) AS lt, (l_partkey * 7 + l_suppkey) % 10 / 10 AS white, l_linenumber % 3 / 20 AS edges FROM ph)"


def _looks(spark, sf_dir):
    rows = _phrases(spark, sf_dir)
    return rows.withColumn("white", (F.col("l_partkey") * 7 + F.col("l_suppkey")) % 10 / 10).withColumn("edges", F.col("l_linenumber") % 3 / 20)


def _subtypes(edges: str = "") -> dict[str, str]:
    s = {n: _hits(w) for n, w in k.SUBTYPES.items()}
    return {
        "microscopy": f"({s['microscopy']} + CASE WHEN white < 0.3 THEN 0.5::DOUBLE ELSE 0 END)",
        "spectrum": f"({s['spectrum']} + CASE WHEN white > 0.7 THEN 0.3::DOUBLE ELSE 0 END)",
        "line_plot": f"({s['line_plot']} + CASE WHEN white > 0.7 THEN 0.5::DOUBLE ELSE 0 END{edges})",
    }


_ONE, _TWO = _subtypes(), _subtypes(" + CASE WHEN edges > 0.05 THEN 0.3::DOUBLE ELSE 0 END")
_CONF = "least(1, greatest({0}) / 3)::DOUBLE"


@query(f"WITH {_FX}, {_LOOK} SELECT {_K}, {_best(_ONE, 'unknown')} AS subtype, round({_CONF.format(', '.join(_ONE.values()))}, 6) AS confidence FROM lo")
def subtype_baseline(spark, sf_dir):
    rows, s = k.with_subtype_scores(_looks(spark, sf_dir), X(), F.col("white"))
    return rows.select(*KEYS, k.best(s, "unknown").alias("subtype"), F.round(k.confidence(s), 6).alias("confidence"))


@query(f"""WITH {_FX}, {_LOOK}, s AS (SELECT {_K}, {_best(_TWO, 'unknown')} AS subtype, round({_CONF.format(', '.join(_TWO.values()))}, 6) AS confidence FROM lo)
SELECT {_K}, subtype || CASE WHEN confidence < 0.6 THEN '_low_confidence' ELSE '' END AS subtype, confidence FROM s""")
def subtype_robust(spark, sf_dir):
    rows, s = k.with_subtype_scores(_looks(spark, sf_dir), X(), F.col("white"), F.col("edges"))
    conf = F.round(k.confidence(s), 6)
    name = F.concat(k.best(s, "unknown"), F.when(conf < 0.6, "_low_confidence").otherwise(""))
    return rows.select(*KEYS, name.alias("subtype"), conf.alias("confidence"))


_FLAT = {n: f"(0.4::DOUBLE * ({_hits(w)} / 7) + 0.6::DOUBLE * {'edges' if n == 'line_plot' else '0'})" for n, w in k.CHARTS.items()}


@query(f"WITH {_FX}, {_LOOK} SELECT {_K}, {_best(_FLAT, 'unknown')} AS chart_type, round(least(1, greatest({', '.join(_FLAT.values())})), 6)::DOUBLE AS confidence FROM lo")
def chart_kw_v13(spark, sf_dir):
    rows, s = k.with_flat_scores(_looks(spark, sf_dir), X(), {"line_plot": F.col("edges")})
    conf = F.round(F.least(F.lit(1.0), F.greatest(*s.values())), 6)
    return rows.select(*KEYS, k.best(s, "unknown").alias("chart_type"), conf.alias("confidence"))


_MAIN = {n: _hits(w) for n, w in k.MAIN.items()}
_POINTS = {n: f"(2 * {v})" if n == "diagram" else f"(CASE WHEN {_MAIN['diagram']} = 0 THEN {v} ELSE 0 END)" if n == "chart" else v for n, v in _MAIN.items()}
_W = f"w AS (SELECT *, {', '.join(f'{v} AS p_{n}' for n, v in _POINTS.items())} FROM lo)"
_SUMP = "(" + " + ".join(f"p_{n}" for n in _POINTS) + ")"
_RAW = {n: f"(0.4::DOUBLE * CASE WHEN {_SUMP} > 0 THEN p_{n} / {_SUMP} ELSE 0 END + 0.6::DOUBLE * {'white' if n == 'chart' else 'edges' if n == 'photo' else '0'})" for n in _POINTS}
_V = f"v AS (SELECT *, {', '.join(f'{v} AS r_{n}' for n, v in _RAW.items())} FROM w)"
_SUMR = "(" + " + ".join(f"r_{n}" for n in _RAW) + ")"
_SHARE = {n: f"round(CASE WHEN {_SUMR} > 0 THEN r_{n} / {_SUMR} ELSE 0 END, 9)" for n in _RAW}


@query(f"WITH {_FX}, {_LOOK}, {_W}, {_V} SELECT {_K}, {_best(_SHARE)} AS main, round(1 / (1 + exp(-greatest({', '.join(_SHARE.values())}))), 6) AS confidence FROM v")
def chart_main_v17(spark, sf_dir):
    rows, s = k.with_main_scores(_looks(spark, sf_dir), X(), {"chart": F.col("white"), "photo": F.col("edges")}, {})
    return rows.select(*KEYS, k.best(s).alias("main"), F.round(k.calibrated(F.greatest(*s.values())), 6).alias("confidence"))


def _sub_sql() -> str:
    out = []
    for main, kinds in k.HIERARCHY.items():
        h = {n: _hits(k.SUB[n]) for n in kinds}
        whole = " + ".join(h.values())
        scores = {n: f"(CASE WHEN {whole} > 0 THEN {v} / ({whole}) ELSE 1::DOUBLE / {len(kinds)} END)" for n, v in h.items()}
        top = f"greatest({', '.join(scores.values())})" if len(scores) > 1 else next(iter(scores.values()))
        name = _best(scores) if len(scores) > 1 else f"'{kinds[0]}'"
        out.append(f"SELECT {_K}, '{main}' AS main, {name} AS sub, round(1 / (1 + exp(-{top})), 6) AS confidence FROM lo")
    return " UNION ALL ".join(out)


@query(f"WITH {_FX}, {_LOOK} {_sub_sql()}")
def chart_sub_v17(spark, sf_dir):
    """The kind under each main category that a phrase speaks for."""
    rows, each = _looks(spark, sf_dir), []
    for main in k.HIERARCHY:
        rows, s = k.with_sub_scores(rows, X(), main)
        top = F.greatest(*s.values()) if len(s) > 1 else next(iter(s.values()))
        each.append(F.struct(F.lit(main).alias("main"), k.best(s).alias("sub"), F.round(k.calibrated(top), 6).alias("confidence")))
    return rows.select(*KEYS, F.explode(F.array(*each)).alias("s")).select(*KEYS, "s.*")


_WORDS = "CASE {0} " + " ".join(f"WHEN '{n}' THEN [" + ", ".join(f"'{w}'" for w in words) + "]" for n, words in k.SUB.items()) + " END"


def _matched(kind: str) -> str:
    return f"coalesce(array_to_string(list_filter({_WORDS.format(kind)}, lambda w: contains(lt, w)), ','), '')"


_SUB_LOOK = {"line_plot": "edges", "heatmap": "white / 2", "microscopy_tem": "white", "photo": "edges", "diagram_schematic": "edges * 3"}


def _sub_look():
    return {"line_plot": F.col("edges"), "heatmap": F.col("white") / 2, "microscopy_tem": F.col("white"), "photo": F.col("edges"), "diagram_schematic": F.col("edges") * 3}


_FLATS = {n: f"({_hits(k.SUB[n]) if n in k.SUB else '0'} + 2 * {_SUB_LOOK.get(n, '0')})::DOUBLE" for n in k.KINDS}
_FLAT_ALL = f"""fa AS (SELECT *, {', '.join(f'{v} AS f_{n}' for n, v in _FLATS.items())} FROM lo), fb AS (SELECT *, greatest({', '.join('f_' + n for n in k.KINDS)}) AS f_top, {' + '.join('f_' + n for n in k.KINDS)} AS f_sum FROM fa),
fc AS (SELECT *, CASE {' '.join(f"WHEN f_{n} = f_top THEN '{n}'" for n in k.KINDS)} END AS kind, round(1 / (1 + exp(-round(CASE WHEN f_sum > 0 THEN f_top / f_sum ELSE 0 END, 9))), 6) AS confidence FROM fb)"""


@query(f"WITH {_FX}, {_LOOK}, {_FLAT_ALL} SELECT {_K}, kind, confidence, {_matched('kind')} AS matched FROM fc")
def chart_flat_v17(spark, sf_dir):
    """The kind of all sixteen that words and look speak for."""
    rows = k.flat_kinds(_looks(spark, sf_dir), X(), _sub_look())
    return rows.select(*KEYS, "kind.kind", "kind.confidence", F.concat_ws(",", "kind.matched").alias("matched"))


@query(f"WITH {_FX}, {_LOOK}, {_FLAT_ALL} SELECT {_K}, {_matched('kind')} AS matched FROM fc")
def matched_keywords(spark, sf_dir):
    """The words of the winning kind that each phrase has."""
    rows = k.flat_kinds(_looks(spark, sf_dir), X(), _sub_look())
    return rows.select(*KEYS, F.concat_ws(",", k.matched(X(), F.col("kind.kind"))).alias("matched"))


_AROUND = {"chart": "(CASE WHEN l_linenumber % 2 = 0 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN l_linenumber % 3 = 0 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN l_partkey % 4 = 0 THEN 0.3::DOUBLE ELSE 0 END)",
           "photo": "(CASE WHEN l_partkey % 5 = 0 THEN 0.3::DOUBLE ELSE 0 END)"}


def _around():
    detector = F.when(F.col("l_linenumber") % 2 == 0, "table_transformer").otherwise("doclayout")
    place = F.when(F.col("l_linenumber") % 3 == 0, "top").otherwise("middle")
    near = F.concat(F.when(F.col("l_partkey") % 4 == 0, "see Figure 1 ").otherwise(""), F.when(F.col("l_partkey") % 5 == 0, "an image").otherwise(""))
    return k.context(detector, place, near)


_HRAW = {n: f"(0.4::DOUBLE * CASE WHEN {_SUMP} > 0 THEN p_{n} / {_SUMP} ELSE 0 END + 0.6::DOUBLE * {'white' if n == 'chart' else 'edges' if n == 'photo' else '0'} + 0.1::DOUBLE * {_AROUND.get(n, '0')})" for n in _POINTS}
_HV = f"v AS (SELECT *, {', '.join(f'{v} AS r_{n}' for n, v in _HRAW.items())} FROM w)"


def _sub_columns() -> str:
    """For each main category its best kind and that kind's share."""
    out = []
    for main, kinds in k.HIERARCHY.items():
        h = {n: f"({_hits(k.SUB[n])} + 2 * {_SUB_LOOK.get(n, '0')})::DOUBLE" for n in kinds}
        whole = "(" + " + ".join(h.values()) + ")"
        scores = {n: f"round(CASE WHEN {whole} > 0 THEN {v} / {whole} ELSE 1::DOUBLE / {len(kinds)} END, 9)" for n, v in h.items()}
        top = f"greatest({', '.join(scores.values())})" if len(scores) > 1 else next(iter(scores.values()))
        out.append(f"{_best(scores) if len(scores) > 1 else chr(39) + kinds[0] + chr(39)} AS s_{main}, {top} AS t_{main}")
    return ", ".join(out)


_PICK = lambda p: "CASE main " + " ".join(f"WHEN '{n}' THEN {p}_{n}" for n in k.HIERARCHY) + " END"


@query(f"""WITH {_FX}, {_LOOK}, {_W}, {_HV}, h0 AS (SELECT *, {_best(_SHARE)} AS main, greatest({', '.join(_SHARE.values())}) AS main_score FROM v), h1 AS (SELECT *, {_sub_columns()} FROM h0),
h2 AS (SELECT *, {_PICK('s')} AS sub, {_PICK('t')} AS sub_score FROM h1)
SELECT {_K}, main, sub, round(1 / (1 + exp(-main_score)), 6) AS main_confidence, round(1 / (1 + exp(-sub_score)), 6) AS confidence, {_matched('sub')} AS matched FROM h2""")
def chart_hierarchical(spark, sf_dir):
    """Main category and kind under it, by words, look and context, with calibrated confidences."""
    rows = k.hierarchical(_looks(spark, sf_dir), X(), {"chart": F.col("white"), "photo": F.col("edges")}, _sub_look(), _around())
    return rows.select(*KEYS, "kind.main", "kind.sub", "kind.main_confidence", "kind.confidence", F.concat_ws(",", "kind.matched").alias("matched"))


@query(f"""WITH {_FX}, {_LOOK}, s AS (SELECT {_K}, {_best(_FLAT, 'unknown')} AS a, round(least(1, greatest({', '.join(_FLAT.values())})), 6)::DOUBLE AS ca, {_best(_ONE, 'unknown')} AS z, round({_CONF.format(', '.join(_ONE.values()))}, 6) AS cz FROM lo)
SELECT {_K}, CASE WHEN ca < 0.3 THEN z ELSE a END AS kind, CASE WHEN ca < 0.3 THEN cz ELSE ca END AS confidence FROM s""")
def chart_fallback(spark, sf_dir):
    """The first classifier's kind, or the baseline's where it is unsure."""
    rows, flat = k.with_flat_scores(_looks(spark, sf_dir), X(), {"line_plot": F.col("edges")})
    rows, one = k.with_subtype_scores(rows, X(), F.col("white"))
    own = F.round(F.least(F.lit(1.0), F.greatest(*flat.values())), 6)
    rows = rows.select(*KEYS, k.best(flat, "unknown").alias("a"), own.alias("ca"), k.best(one, "unknown").alias("z"), F.round(k.confidence(one), 6).alias("cz"))
    kind, conf = k.with_fallback(*(F.col(x) for x in ("a", "ca", "z", "cz")))
    return rows.select(*KEYS, kind.alias("kind"), conf.alias("confidence"))


@query(c.sql("b", """SELECT doc_no, page_index, ord, CASE WHEN contains(detector, 'table') THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN y0 < 100 OR y1 > 800 THEN 0.2::DOUBLE ELSE 0 END
 + CASE WHEN ord % 2 = 0 THEN 0.3::DOUBLE ELSE 0 END AS chart, CASE WHEN ord % 3 = 0 THEN 0.3::DOUBLE ELSE 0 END AS photo FROM b"""))
def context_scores(spark, sf_dir):
    place = F.when(F.col("y0") < 100, "top").when(F.col("y1") > 800, "bottom").otherwise("middle")
    around = F.concat(F.when(F.col("ord") % 2 == 0, "see Figure 1 ").otherwise(""), F.when(F.col("ord") % 3 == 0, "an image").otherwise(""))
    s = k.context(F.col("detector"), place, around)
    return c.boxes(spark, sf_dir).select("doc_no", "page_index", "ord", s["chart"].alias("chart"), s["photo"].alias("photo"))


@query(c.sql("bc", r"""WITH n AS (SELECT doc_no, page_index, sum(len(regexp_extract_all(text, '(?i)\b(fig\.?|figure)\s*\d+')))::BIGINT AS figures,
 sum(len(regexp_extract_all(text, '(?i)\b(table|tab\.)\s*\d+')))::BIGINT AS tables FROM c GROUP BY ALL)
SELECT b.doc_no, b.page_index, b.ord, type AS was, CASE WHEN type = 'table' AND figures > 2 * tables AND figures >= 2 THEN 'figure' WHEN type = 'figure' AND tables > 2 * figures AND tables >= 2 THEN 'table' ELSE type END AS type
FROM b LEFT JOIN n USING (doc_no, page_index)"""))
def caption_reclassify(spark, sf_dir):
    count = lambda p: F.sum(F.regexp_count(X(), F.lit(p)))
    n = c.captions(spark, sf_dir).groupBy(*c.PAGE).agg(count(r"(?i)\b(fig\.?|figure)\s*\d+").alias("figures"), count(r"(?i)\b(table|tab\.)\s*\d+").alias("tables"))
    rows = c.boxes(spark, sf_dir).join(n, c.PAGE, "left")
    return rows.select(*c.PAGE, "ord", F.col("type").alias("was"), k.reclassified(F.col("type"), F.col("figures"), F.col("tables")).alias("type"))


_FOUND = "list_concat(" + ", ".join(f"list_transform(regexp_extract_all(text, '{p}', 1), lambda v: '{n}=' || v)" for n, p in t.CONDITIONS.items()) + ")"
_SAID = lambda words: "list_filter([" + ", ".join(f"'{w}'" for w in words) + "], lambda w: contains(lt, lower(w)))"
_FIRST_WORDS, _SECOND_WORDS = [w for ws in k.SUBTYPES.values() for w in ws], [w for ws in k.CHARTS.values() for w in ws]


def _said(low, words):
    pairs = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(w.lower()).alias("l")) for w in words))
    return F.transform(F.filter(pairs, lambda p: low.contains(p["l"])), lambda p: p["w"])


@query(f"""WITH {_FX}, {_LOOK}, s AS (SELECT *, {_best(_ONE, 'unknown')} AS a, round({_CONF.format(', '.join(_ONE.values()))}, 6) AS ca, {_best(_FLAT, 'unknown')} AS z, round(least(1, greatest({', '.join(_FLAT.values())})), 6)::DOUBLE AS cz FROM lo)
SELECT {_K}, CASE WHEN a = 'unknown' OR ca < 0.4 THEN z ELSE a END AS subtype, CASE WHEN a = 'unknown' OR ca < 0.4 THEN cz ELSE ca END AS confidence,
 array_to_string(list_concat({_FOUND}, {_FOUND}), ',') AS conditions, array_to_string(list_sort(list_distinct(list_concat({_SAID(_FIRST_WORDS)}, {_SAID(_SECOND_WORDS)}))), ',') AS keywords FROM s""")
def merge_annotations(spark, sf_dir):
    """Two classifiers' annotations as one: subtype, conditions of both, keywords of both."""
    rows, one = k.with_subtype_scores(_looks(spark, sf_dir), X(), F.col("white"))
    rows, two = k.with_flat_scores(rows, X(), {"line_plot": F.col("edges")})
    sure = F.round(F.least(F.lit(1.0), F.greatest(*two.values())), 6)
    rows = rows.select(
        *KEYS, k.best(one, "unknown").alias("a"), F.round(k.confidence(one), 6).alias("ca"), k.best(two, "unknown").alias("z"), sure.alias("cz"),
        t.conditions(X()).alias("cond"), _said(F.col("__low"), _FIRST_WORDS).alias("ka"), _said(F.col("__low"), _SECOND_WORDS).alias("kz"),
    )
    of = F.col
    made = k.merged_annotations(of("a"), of("ca"), of("cond"), of("ka"), of("z"), of("cz"), of("cond"), of("kz"))
    shown = F.transform(made["conditions"], lambda s: F.concat_ws("=", s["name"], s["value"]))
    return rows.select(*KEYS, made["subtype"].alias("subtype"), made["confidence"].alias("confidence"), F.concat_ws(",", shown).alias("conditions"), F.concat_ws(",", made["keywords"]).alias("keywords"))


@query(f"""WITH {_FX}, {_LOOK}, s AS (SELECT *, l_partkey % 11 <> 0 AS ok, {_best(_TWO, 'unknown')} AS a, round({_CONF.format(', '.join(_TWO.values()))}, 6) AS ca,
 list_filter(regexp_extract_all(text, '{t.MATERIAL}', 0), lambda x: length(x) > 1 AND x NOT IN ('The', 'In', 'On', 'At', 'To', 'For')) AS ml FROM lo)
SELECT {_K}, CASE WHEN ok THEN a || CASE WHEN ca < 0.6 THEN '_low_confidence' ELSE '' END ELSE 'unknown' END AS subtype, CASE WHEN ok THEN ca ELSE 0 END AS confidence,
 CASE WHEN ok THEN array_to_string({_FOUND}, ',') ELSE '' END AS conditions, CASE WHEN ok THEN array_to_string(list_filter(ml, lambda x, i: list_position(ml, x) = i)[1:10], ',') ELSE '' END AS materials,
 CASE WHEN ok THEN 'analysed' ELSE 'validation_failed' END AS method FROM s""")
def robust_analysis(spark, sf_dir):
    """Subtype, conditions and materials of figures whose image is valid."""
    rows, scores = k.with_subtype_scores(_looks(spark, sf_dir), X(), F.col("white"), F.col("edges"))
    made = k.analysed(F.col("l_partkey") % 11 != 0, X(), scores)
    shown = F.transform(made["conditions"], lambda c: F.concat_ws("=", c["name"], c["value"]))
    return rows.select(
        *KEYS, made["subtype"].alias("subtype"), made["confidence"].alias("confidence"), F.concat_ws(",", shown).alias("conditions"), F.concat_ws(",", made["materials"]).alias("materials"), made["method"].alias("method")
    )
