"""Registration of checkable queries: a Spark callable and, where plain SQL can say it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.plans.views import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql, *views)
        return fn

    return add


def r6(c, name: str | None = None) -> Column:
    """Six decimals, so that the order of a sum cannot show in a comparison.

    The small shift keeps exact halves on one side of the rounding in both engines.
    """
    column = F.col(c) if isinstance(c, str) else c
    out = F.round(column.cast("double") + 1e-9, 6) + F.lit(0.0)
    label = name or (c if isinstance(c, str) else None)
    return out.alias(label) if label else out
