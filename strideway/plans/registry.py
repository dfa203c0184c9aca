"""All registered queries of the street-network engine, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strideway.plans import queries_builds, queries_edges, queries_routes, queries_tables
from strideway.plans.net_sql import with_ctes
from strideway.sources.network import Network

MODULES = (queries_tables, queries_edges, queries_routes, queries_builds)


def _runner(function: Callable[[Network], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: function(Network(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _runner(f) for m in MODULES for name, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_ctes(sql) for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
