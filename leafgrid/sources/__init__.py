"""Sources: detections, captions, lines and other entities derived from the driver tables.

Each select list runs unchanged in Spark and in DuckDB, so that queries and their SQL
start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_X0 = "(l_partkey*37 + l_linenumber*11) % 600"
_Y0 = "(l_suppkey*91 + l_orderkey) % 700"
_TYPE = "CASE WHEN l_returnflag = 'R' THEN 'table' ELSE 'figure' END AS type"
_KEYS = "l_orderkey % 2000 AS doc_no, l_linenumber AS page_index, l_orderkey, l_partkey, l_suppkey"

#: table and select list of each entity; ``distinct`` where rows may repeat
VIEWS: dict[str, tuple[str, str, str]] = {
    "boxes": ("lineitem", f"""{_KEYS}, {_X0} AS x0, {_Y0} AS y0, {_X0} + 60 + (l_partkey*13) % 200 AS x1, {_Y0} + 40 + (l_orderkey*7) % 150 AS y1,
 {_TYPE}, CASE l_linenumber % 3 WHEN 0 THEN 'doclayout' WHEN 1 THEN 'table_transformer' ELSE 'publaynet' END AS detector, l_discount * 10e0 AS score""", ""),
    "truth": ("lineitem", f"""{_KEYS}, {_X0} + l_suppkey % 70 AS x0, {_Y0} + l_partkey % 45 AS y0, {_X0} + 60 + (l_partkey*13) % 200 + l_suppkey % 70 AS x1,
 {_Y0} + 40 + (l_orderkey*7) % 150 + l_partkey % 45 AS y1, {_TYPE}""", "l_partkey % 3 <> 0"),
    "captions": ("orders", """o_orderkey % 2000 AS doc_no, CAST(o_custkey % 7 + 1 AS INT) AS page_index, o_orderkey AS line_no,
 concat(CASE o_orderkey % 7 WHEN 0 THEN 'Figure ' WHEN 1 THEN 'Fig. ' WHEN 2 THEN 'Table ' WHEN 3 THEN 'Tab. ' WHEN 4 THEN '图 ' WHEN 5 THEN '表' ELSE 'Results for ' END,
 CAST(o_custkey % 9 + 1 AS STRING), CASE WHEN o_custkey % 4 = 0 THEN '(a)' WHEN o_custkey % 4 = 1 THEN 'b' ELSE '' END, '. ', o_orderpriority) AS text,
 (o_custkey*29) % 500 AS x0, (o_orderkey*53) % 900 AS y0, (o_custkey*29) % 500 + 300 AS x1, (o_orderkey*53) % 900 + 18 AS y1""", ""),
    "phrases": ("lineitem", """l_orderkey, l_linenumber, l_partkey, l_suppkey,
 concat(CASE l_partkey % 5 WHEN 0 THEN 'SEM image' WHEN 1 THEN 'Bar chart' WHEN 2 THEN 'XRD spectrum' WHEN 3 THEN 'Flowchart' ELSE 'Line plot' END,
 ' of TiO2 and NaCl annealed at ', CAST(CAST(l_quantity AS INT)*20 AS STRING), ' °C for ', CAST(l_linenumber AS STRING), ' h under ',
 CAST(l_suppkey AS STRING), ' kPa, pH = ', CAST(l_linenumber AS STRING), '.5, ', CAST(300 + l_partkey % 500 AS STRING), ' nm') AS text""", ""),
    "segments": ("orders", """o_orderkey % 200 AS page_no, (o_orderkey*61) % 1200 AS y, (o_custkey*7) % 300 AS x0, (o_custkey*7) % 300 + 200 + o_orderkey % 300 AS x1, o_orderkey AS seg_id""", ""),
    "strokes": ("orders", """o_orderkey % 200 AS chart_no, (o_custkey*7) % 300 + 40 AS x0, (o_orderkey*61) % 800 + 60 AS y0,
 (o_custkey*7) % 300 + 40 + CASE WHEN o_custkey % 5 < o_orderkey % 200 % 6 THEN 0 ELSE 200 END AS x1, (o_orderkey*61) % 800 + 60 + CASE WHEN o_custkey % 5 < o_orderkey % 200 % 6 THEN 250 ELSE 0 END AS y1""", ""),
    "pixels": ("lineitem", """DISTINCT l_orderkey % 50 AS img_id, (l_partkey*17) % 64 AS x, (l_suppkey*31 + l_partkey) % 64 AS y,
 (l_partkey*29 + (l_suppkey*31 + l_partkey) % 64) % 256 AS v""", ""),
}

_LINE_COLUMNS = """doc_id, CAST(floor(line_no/40) AS INT) AS page_index, line_no, text, 60 + (doc_id*17 + line_no*5) % 40 AS x0, 40 + (line_no % 40)*28 AS y0,
 least(1130, 60 + (doc_id*17 + line_no*5) % 40 + 6*length(text)) AS x1, 60 + (line_no % 40)*28 AS y1"""


def view(name: str) -> str:
    """The rows of an entity as a SELECT for DuckDB."""
    if name == "lines":
        return f"""SELECT {_LINE_COLUMNS} FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text,
 generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"""
    table, columns, where = VIEWS[name]
    return f"SELECT {columns} FROM {table}" + f" WHERE {where}" * bool(where)


def entity(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The rows of an entity; only the columns it needs are read."""
    if name == "lines":
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        from pyspark.sql import functions as F

        rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
        return rows.selectExpr(*_split(_LINE_COLUMNS))
    table, columns, where = VIEWS[name]
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    rows = rows.where(where) if where else rows
    if columns.startswith("DISTINCT "):
        return rows.selectExpr(*_split(columns.removeprefix("DISTINCT "))).distinct()
    return rows.selectExpr(*_split(columns))


def _split(columns: str) -> list[str]:
    """The expressions of a select list: commas outside brackets and quotes part them."""
    out, depth, quoted, own = [], 0, False, ""
    for c in columns:
        quoted ^= c == "'"
        depth += (c == "(") - (c == ")") if not quoted else 0
        if c == "," and not depth and not quoted:
            out.append(own)
            own = ""
        else:
            own += c
    return [*out, own]
