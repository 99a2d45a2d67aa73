"""Queries on few pages with many boxes and captions, held to their SQL."""

from pathlib import Path

import duckdb
import numpy as np
import pytest

from leafgrid import catalogue, session
from leafgrid.operators import evaluation as e
from leafgrid.operators import merging as m
from leafgrid.operators import pages as p
from test_catalogue import plain

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


def _tables(folder, boxes: int, lines: int, pages: int = 2, docs: int = 1, spread: int = 1):
    """lineitem and orders whose boxes and captions all lie on few pages."""
    con = duckdb.connect()
    con.sql(f"""COPY (SELECT (i % {docs} + 2000 * i)::BIGINT AS l_orderkey, (i % {pages} + 1)::INT AS l_linenumber, (i * 7919 * {spread})::BIGINT AS l_partkey, (i * 104729 * {spread})::BIGINT AS l_suppkey,
 CASE i % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'A' ELSE 'N' END AS l_returnflag, (i % 11 / 100)::DOUBLE AS l_discount, (i % 50)::DOUBLE AS l_quantity FROM range({boxes}) r(i)) TO '{folder}/lineitem.parquet'""")
    con.sql(f"""COPY (SELECT (i % {docs} + 2000 * i)::BIGINT AS o_orderkey, (i * 7 + i % {pages})::BIGINT AS o_custkey, '1-URGENT' AS o_orderpriority FROM range({lines}) r(i)) TO '{folder}/orders.parquet'""")
    return str(folder)


def _sql(name, folder):
    con = duckdb.connect()
    for table in ("lineitem", "orders"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con.sql(SQL[name])


def _same(spark, name, folder):
    df, other = QUERIES[name](spark, folder), _sql(name, folder)
    assert sorted(df.columns) == sorted(other.columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(other.fetchall(), other.columns)


def test_items_beyond_four_digits_keep_the_order_of_their_ids(spark, tmp_path):
    _same(spark, "manifest_json", _tables(tmp_path, 30_300, 10))


@pytest.fixture(scope="module")
def crowded(tmp_path_factory):
    """Three documents of two pages, some 330 boxes and 60 captions on each page."""
    return _tables(tmp_path_factory.mktemp("crowded"), 2_000, 2_500, docs=3)


NEAREST = ["bar_labels", "caption_align", "caption_conflicts", "caption_counts", "caption_fallbacks", "caption_groups", "caption_merge", "caption_signature", "figure_items", "low_quality", "nearest_caption_kind",
           "nearest_caption_kind_table", "quality_stats", "quality_v1", "quality_v2", "recommendations", "subfigure_groups"]


def _most_joined(spark, df) -> int:
    """The most rows that a join of the query gives out."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
        if "Join" in node.nodeName():
            most = max(most, node.metrics().apply("numOutputRows").value())
    return most


@pytest.mark.parametrize("name", NEAREST)
def test_the_nearest_line_of_a_crowded_page(spark, crowded, name):
    _same(spark, name, crowded)
    assert _most_joined(spark, QUERIES[name](spark, crowded)) <= 4_000


@pytest.mark.parametrize("name", ["likely_text_region", "lines_in_box", "nearby_text", "section_text", "text_coverage"])
def test_the_lines_in_and_near_boxes_of_a_crowded_page(spark, crowded, name):
    _same(spark, name, crowded)
    assert _most_joined(spark, QUERIES[name](spark, crowded)) <= 4_000


@pytest.fixture(scope="module")
def packed(tmp_path_factory):
    """One document of two pages with some 150 boxes each; DuckDB's own folds are slow on more."""
    return _tables(tmp_path_factory.mktemp("packed"), 300, 40)


@pytest.mark.parametrize("name", ["bars_union", "eval_loaded", "greedy_dedup", "greedy_match_eval", "overlap_merge", "proximity_merge", "unmatched", "weighted_nms"])
def test_folds_over_a_crowded_page(spark, packed, name):
    _same(spark, name, packed)
    df = QUERIES[name](spark, packed)
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()  # no list that is copied at each step
    assert _most_joined(spark, df) <= 1_000


def _random_boxes(n: int, seed: int):
    r = np.random.default_rng(seed)
    x, y = r.uniform(0, 600, n), r.uniform(0, 700, n)
    return x, y, x + r.uniform(0, 200, n), y + r.uniform(0, 150, n)


def test_merging_takes_a_step_for_each_box_that_is_left():
    b, score, calls = _random_boxes(400, 1), np.random.default_rng(2).integers(0, 9, 400) / 10, []

    def joins(own, others):
        calls.append(1)
        return p.overlap(own, others) >= 0.7

    rows = [{"box": tuple(x[k] for x in b), "score": score[k], "type": k, "n": 1} for k in range(400)]
    want = m.merge_rounds(rows, lambda u, v: m.overlap_value(u["box"], v["box"]) >= 0.7, 11)
    corners, scores, kinds, n = m.merged_arrays(b, score, joins, 11)
    assert [(w["box"], w["score"], w["type"], w["n"]) for w in want] == list(zip(zip(*corners, strict=True), scores, kinds, n, strict=True))
    assert 0 < len(want) < 400 and len(calls) <= 400 + 10 * 399


def test_matching_meets_only_boxes_that_lie_near():
    n = 1_500
    b = tuple(np.concatenate(x) for x in zip(_random_boxes(n, 3), _random_boxes(n, 4), strict=True))
    gt, pred, iou = e.overlapping(b, np.arange(n), np.arange(n, 2 * n), 0.4)
    whole = p.iou(tuple(x[:n, None] for x in b), tuple(x[None, n:] for x in b))
    assert {(i, k - n) for i, k in zip(gt, pred, strict=True)} == set(zip(*np.nonzero(whole >= 0.4), strict=True)) and len(gt) > n
    used, want = (set(), set()), set()
    for _, i, k in sorted(zip(-iou, gt, pred, strict=True)):
        if i not in used[0] and k not in used[1]:
            used[0].add(i), used[1].add(k), want.add((i, k))
    at = m.greedy_match(gt, pred, iou)
    assert set(zip(gt[at], pred[at], strict=True)) == want


def test_growing_by_signature_is_growing():
    r, x = np.random.default_rng(5), _random_boxes(220, 6)
    box = [tuple(c[k] / 2 for c in x) for k in range(220)]
    lines = [tuple(c[k] / 2 for c in _random_boxes(40, 7)) for k in range(40)]
    lines = [(a, b, c + 80, b + 6) for a, b, c, _ in lines]
    rows = [{"box": box[k], "score": int(r.integers(0, 9)) / 10, "type": k, "n": 1, "sig": ("", "a", "b", "c")[int(r.integers(0, 4))]} for k in range(220)]
    bars, calls = np.array(lines), []

    def joins(u, v):
        return not (u["sig"] and v["sig"] and u["sig"] != v["sig"]) and m.beside_value(u["box"], v["box"]) and not m.barrier_value(u["box"], v["box"], lines)

    def boxes_join(a, b):
        calls.append(1)
        assert m.barred(a, b, bars) == m.barrier_value(a, b, lines)
        return m.beside_value(a, b) and not m.barred(a, b, bars)

    want = m.absorb(rows, joins)
    assert m.absorb_signed(rows, boxes_join) == want and 1 < len(want) < 220


def test_packages_are_compressed(spark, packed):
    before = set(session._made)
    _same(spark, "package_export", packed)
    own = [f for f in set(session._made) - before if "package" in f]
    files = [f for f in Path(own[0].removeprefix("file:")).rglob("part-*") if not f.name.endswith(".crc")]
    assert files and all(f.name.endswith(".json.gz") for f in files)


def test_items_are_dealt_by_document_once(spark, packed):
    plan = QUERIES["item_ids"](spark, packed)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
