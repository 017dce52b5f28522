"""Dates in the notations that occur in filings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def any_date(value: Column) -> Column:
    """The date of 2024-01-31 (with or without a time), 20240131, 01/31/2024 or Jan 31, 2024; else null."""
    text = F.trim(value)
    parse = lambda column, form: F.try_to_timestamp(column, F.lit(form)).cast("date")
    return (
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), parse(F.substring(text, 1, 10), "yyyy-MM-dd"))
        .when(text.rlike(r"^\d{8}$"), parse(text, "yyyyMMdd"))
        .when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), parse(text, "M/d/yyyy"))
        .when(text.rlike(r"^[A-Za-z]{3} \d{1,2}, \d{4}$"), parse(text, "MMM d, yyyy"))
    )


def active_on(day: Column, start: Column, end: Column) -> Column:
    """Whether the half-open interval [start, end) holds the day; without an end it is open."""
    return (start <= day) & (end.isNull() | (end > day))
