"""All queries of the core, by name, with the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evistrata.plans import evaluate, hybrid, knowledge, lake, risks, service, snapshots, texts, trade

MODULES = (lake, knowledge, risks, texts, evaluate, service, trade, hybrid, snapshots)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}


def flagship(spark: SparkSession, base: str) -> DataFrame:
    return hybrid.hybrid_retrieve(spark, base)
