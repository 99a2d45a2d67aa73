"""Named queries over the driver tables, each with the same query as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafgrid import sources

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, **views: str) -> Callable[[Query], Query]:
    """Register a function under its name; ``views``: entities that its SQL names."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            with_ = ", ".join(f"{k} AS ({sources.view(v)})" for k, v in views.items())
            body = sql.strip()
            if with_:
                body = f"WITH {'RECURSIVE ' * ('RECURSIVE' in body)}{with_}" + (", " + body[5:].lstrip().removeprefix("RECURSIVE ") if body.startswith("WITH ") else " " + body)
            ORACLES[f.__name__] = body
        return f

    return register


def _load() -> None:
    from leafgrid.plans import captioning, detections, evaluation, exports, figures, grouping, overlaps, pictures, reports, scoring, tables, texts  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
