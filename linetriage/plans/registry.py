"""Named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None
    covers: tuple[str, ...]


REGISTRY: dict[str, Entry] = {}


def query(covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name with the operator ids it covers."""

    def keep(run: Query) -> Query:
        REGISTRY[run.__name__] = Entry(run, sql, tuple(covers.split()))
        return run

    return keep


def load_all() -> dict[str, Entry]:
    from linetriage.plans import (  # noqa: F401
        drift_queries, join_queries, metric_queries, model_queries, queue_queries, resample_queries, rule_queries,
        source_queries, split_queries,
    )

    return REGISTRY
