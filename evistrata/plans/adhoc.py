"""Queries as text over the tables of a folder, for reading only."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from evistrata.session import table


def register(spark: SparkSession, base: str, names: Iterable[str]) -> None:
    for name in names:
        table(spark, base, name).createOrReplaceTempView(name)


def is_reading(text: str) -> bool:
    """One statement that begins with SELECT or WITH and holds no statement that writes."""
    bare = re.sub(r"--[^\n]*|/\*.*?\*/", " ", text, flags=re.S)
    bare = re.sub(r"'(?:[^'\\]|\\.|'')*'", "''", bare).strip().rstrip(";")
    if ";" in bare or not re.match(r"(?i)(select|with)\b", bare):
        return False
    return not re.search(r"(?i)\b(insert|update|delete|merge|drop|create|alter|truncate|set|add|cache|refresh|load|call|use)\s", bare)


def run(spark: SparkSession, text: str, **args) -> DataFrame:
    """The result of a reading query with named parameters (``:name``)."""
    if not is_reading(text):
        raise ValueError("only one reading query is accepted")
    return spark.sql(text, args=args)
