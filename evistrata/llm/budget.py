"""Exact token counts, unreliable stored counts, and totals per slice (problem 7)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from evistrata.functions.text import tidy_code, tidy_form, tidy_ticker  # noqa: F401
from evistrata.llm import bpe


def token_count(text: Column, vocabulary: str = bpe.VOCABULARY) -> Column:
    """Tokens of a whole text; 0 for a null or empty one.

    Longest match by a trie with failure links gives the segmentation of each distinct word in linear
    time. It is the byte-pair encoding wherever all its neighbours fit; elsewhere, because byte-pair
    encoding is not longest match, the word's prefix table is filled instead.
    """

    @F.pandas_udf(T.LongType())
    def count(values: pd.Series) -> pd.Series:
        counted = bpe.counter(vocabulary).count
        return pd.Series([counted(v) for v in values], dtype="int64")

    return count(text)


def tidy_lang(value: Column) -> Column:
    """The bare language of a tag such as ``EN`` or ``de-DE``."""
    return F.split(tidy_code(value), "_")[0]


def suspect_counts(rows: DataFrame, key: str = "chunk_id", text: str = "text", stored: str = "n_tokens") -> DataFrame:
    """Distinct keys whose stored count is null, not positive, or off by more than a factor of two.

    Defined cases: of a null or empty text, with 0 tokens, every positive count is too high; rows
    without a key are left out; a key is named once however often it is repeated.
    """
    counted = rows.where(F.col(key).isNotNull()).select(
        F.col(key).alias("key"), F.col(stored).alias("stored"), token_count(F.col(text)).alias("tokens")
    )
    off = F.col("stored").isNull() | (F.col("stored") <= 0) | (F.col("stored") > 2 * F.col("tokens")) | (2 * F.col("stored") < F.col("tokens"))
    return counted.where(off).select(F.col("key").alias(key)).distinct()


def totals(rows: DataFrame, *, key: str, groups: dict[str, Column], text: str = "text", stored: Column | None = None, latest: Column | None = None) -> DataFrame:
    """Tokens per slice: one row per combination of ``groups`` with items, tokens and, where a stored
    count is given, how many tokens it claims and how many items have an unusable one.

    Texts are counted where they are read; only key, slice and numbers are shuffled. A repeated key
    counts once, by its ``latest`` row. Defined cases: a null group value is a slice of its own; rows
    without a key are left out; an empty table gives no rows.
    """
    has_stored = stored is not None
    stored = stored if has_stored else F.lit(None)
    tokens = token_count(F.col(text))
    picked = rows.where(F.col(key).isNotNull()).select(
        F.col(key).alias("__key"), (F.lit(0) if latest is None else latest).alias("__at"), *[e.alias(g) for g, e in groups.items()],
        tokens.alias("__n"), stored.cast("long").alias("__stored"),
    )
    value = F.struct("__at", "__n", "__stored", *groups)
    one = picked.groupBy("__key").agg(F.max(value).alias("v")).select("v.*")
    if not has_stored:
        return one.groupBy(*groups).agg(F.count("*").alias("items"), F.sum("__n").alias("tokens"))
    off = F.col("__stored").isNull() | (F.col("__stored") <= 0) | (F.col("__stored") > 2 * F.col("__n")) | (2 * F.col("__stored") < F.col("__n"))
    return one.groupBy(*groups).agg(
        F.count("*").alias("items"),
        F.sum("__n").alias("tokens"),
        F.sum("__stored").alias("stored_tokens"),
        F.count_if(off).alias("unusable_counts"),
    )
