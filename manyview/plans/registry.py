"""Named queries over the harness tables, each with its SQL statement when there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r6(c: Column | str, name: str, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits).alias(name)


def load_all() -> None:
    from . import aggregating, checking, comparing, discovering, estimating, framing, geometric, graphs, lensing, matching, moving, overlapping, pairing, posing, registering, selecting, searching, surfacing, surveying  # noqa: F401
