"""Keyed upserts as DataFrame functions: new tables from old ones and changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def last_per_key(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key by ``order``. Spark keeps one row per key in each task before the shuffle."""
    back = Window.partitionBy(*key).orderBy(*[c.desc_nulls_last() for c in order])
    return rows.withColumn("__r", F.row_number().over(back)).where("__r = 1").drop("__r")


def upsert_last(old: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """Last write wins: rows of ``new`` replace those of ``old``; among new ones the last by ``order``."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return last_per_key(both, key, [F.col("__new"), *order]).drop("__new")


def insert_new(old: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """First write wins: keys of ``old`` stay as they are, of new keys the first row by ``order`` is added."""
    fresh = new.join(old.select(*key), list(key), "left_anti")
    forth = Window.partitionBy(*key).orderBy(*[c.asc_nulls_last() for c in order] or [F.lit(1)])
    fresh = fresh.withColumn("__r", F.row_number().over(forth)).where("__r = 1").drop("__r")
    return old.unionByName(fresh.select(*old.columns))


def fill_missing(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """First value wins, field by field: nulls of ``old`` are filled from ``new``."""
    rest = [c for c in old.columns if c not in key]
    right = new.select(*key, *[F.col(c).alias(f"__{c}") for c in rest])
    return old.join(right, list(key), "full").select(*key, *[F.coalesce(c, f"__{c}").alias(c) for c in rest])


def accumulate_edges(mentions: DataFrame, key: Sequence[str] = ("src", "rel", "dst"), *, at: str = "date", evidence: str = "chunk_id", quote: str = "quote") -> DataFrame:
    """One edge per key: earliest date, evidence ids in order of appearance without repeats, and the
    quote of the first mention. Order is by date, evidence id and quote, so it is the same on every run.

    An id repeated on an edge is reduced to its first appearance before ids are gathered.
    """
    first = mentions.groupBy(*key, evidence).agg(F.min(F.struct(at, evidence, quote)).alias("m"))
    return first.groupBy(*key).agg(
        F.min(f"m.{at}").alias("start_date"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col(f"m.{evidence}").isNotNull(), F.struct(f"m.{at}", f"m.{evidence}")))), lambda x: x[evidence]).alias("evidence_chunk_ids"),
        F.min("m")[quote].alias("evidence_quote"),
        F.lit("Active").alias("status"),
    )


def merge_accumulated(old: DataFrame, new: DataFrame, key: Sequence[str] = ("src", "rel", "dst")) -> DataFrame:
    """Accumulated edges of two runs as one: old evidence first, the lesser date, the older quote."""
    both = old.withColumn("__o", F.lit(0)).unionByName(new.withColumn("__o", F.lit(1)))
    lists = F.array_sort(F.collect_list(F.struct("__o", "evidence_chunk_ids")))
    return both.groupBy(*key).agg(
        F.min("start_date").alias("start_date"),
        F.array_distinct(F.flatten(F.transform(lists, lambda x: x["evidence_chunk_ids"]))).alias("evidence_chunk_ids"),
        F.min_by("evidence_quote", "__o").alias("evidence_quote"),
        F.min_by("status", "__o").alias("status"),
    )


def rewrite_values(rows: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Values of ``column`` replaced by a mapping (old, new); others stay."""
    return rows.join(mapping.select(F.col("old").alias("__old"), F.col("new").alias("__new")), F.col(column) == F.col("__old"), "left").withColumn(
        column, F.coalesce("__new", column)
    ).drop("__old", "__new")
