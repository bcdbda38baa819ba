"""Registered queries, each beside the SQL that must give the same rows."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def in_utc(fn: Query) -> Query:
    """Run in UTC: the tables hold zone-less times, the oracles read them as UTC."""

    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)

    return run


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name`` with its oracle text, if it has one."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = in_utc(fn)
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def load_all() -> None:
    from studylake.catalog import cohort, corpus, dialog, exam, mastery, ops, progress, reports, retrieval, streams, surface, text  # noqa: F401
