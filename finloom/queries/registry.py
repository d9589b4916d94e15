"""Collects the registered queries with their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from finloom.queries.model_sql import model_sql
from finloom.sources.planning_tables import PlanningTables, planning_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, inline: bool = False):
    """Register a function of the planning tables under ``name``."""

    def register(build: Callable[[PlanningTables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(planning_tables(spark, folder))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = model_sql(sql, inline)
        return build

    return register


def load_all() -> None:
    from finloom.queries import allocation, budgets, closing, forecasting, importing, intercompany, organisation  # noqa: F401
