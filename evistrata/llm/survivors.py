"""The surviving value of each field of each group of records (problem 6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

FIELDS = ("concept", "period_start", "val", "accn", "frame")
#: Texts that stand for a missing value.
STAND_INS = ("", "n/a", "na", "none", "null", "nil", "unknown", "unk", "tbd", "-", "--", "?", "nan", "missing", "not available", "not applicable", "not reported")


def filled(value: Column) -> Column:
    """The trimmed text of a value, or null where it is missing: null, blank, a stand-in, not a number."""
    text = F.trim(F.regexp_replace(value.cast("string"), r"(?U)[\s​﻿]+", " "))
    return F.when(~F.lower(text).isin(*STAND_INS), text)


def as_date(value: Column) -> Column:
    """The date of 2024-01-31, 2024/1/31, 2024-01-31T00:00:00Z, 20240131, 01/31/2024, Jan 31, 2024 or 31 January 2024."""
    text = filled(value)
    iso = F.regexp_extract(text, r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", 0)
    month = F.initcap(F.regexp_extract(text, r"(?i)(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?", 1))
    year = F.regexp_extract(text, r"(\d{4})\b", 1)
    day = F.regexp_extract(text, r"(?<!\d)(\d{1,2})(?!\d)", 1)
    parse = lambda column, form: F.try_to_timestamp(column, F.lit(form)).cast("date")
    return (
        F.when(iso != "", parse(F.regexp_replace(iso, "[/.]", "-"), "yyyy-M-d"))
        .when(text.rlike(r"^\d{8}$"), parse(text, "yyyyMMdd"))
        .when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}"), parse(F.regexp_extract(text, r"^\d{1,2}/\d{1,2}/\d{4}", 0), "M/d/yyyy"))
        .when(month != "", parse(F.concat_ws(" ", month, day, year), "MMM d yyyy"))
    )


def plain_concept(value: Column) -> Column:
    """A concept without taxonomy prefix, separators and letter case."""
    bare = F.regexp_replace(F.lower(filled(value)), r"^(us-gaap|ifrs-full|ifrs|gaap|dei|srt)\s*[:_]\s*", "")
    return F.regexp_replace(bare, r"[^a-z0-9]+", "")


def plain_unit(value: Column) -> Column:
    """``iso4217:USD``, `` usd`` and ``USD`` are one unit."""
    return F.regexp_replace(F.upper(filled(value)), r"^.*:", "")


def digits(value: Column) -> Column:
    """The digits of a code, padded so that they compare as numbers do."""
    only = F.regexp_replace(F.regexp_replace(filled(value), r"[^0-9]", ""), r"^0+(?=.)", "")
    return F.when(only != "", F.concat(F.repeat(F.lit("0"), F.greatest(40 - F.length(only), F.lit(0))), only))


def field_survivors(facts: DataFrame, concept_map: DataFrame) -> DataFrame:
    """Per group of records of one reported figure, the record from which each field survives.

    Records of one cik, metric (by ``concept_map``, else the concept), unit, period end and fp, in
    whatever notation, are a group. For each field the records that have it are ranked by filing date
    (latest first, missing last), accn (digits, greatest first, missing last) and fact_id (least first),
    by a window that keeps the top record. Spark keeps only the first row of each group in every task
    before the shuffle, so a group may hold any share of the rows.

    Columns: ``group_id`` (the group's least fact_id), ``field_name``, ``fact_id``, ``value`` (as text).

    Defined cases: groups of one record are left out; a field missing throughout gives no row; a missing
    key part is a value of its own, and records agree in it; rows without fact_id are left out; records
    repeated with the same fact_id count once; empty tables give no rows.
    """
    names = concept_map.groupBy(plain_concept(F.col("concept")).alias("__c")).agg(F.min("metric").alias("__metric"))
    keyed = facts.where(F.col("fact_id").isNotNull()).select(
        "fact_id",
        F.col("cik").alias("k_cik"),
        plain_concept(F.col("concept")).alias("__c"),
        plain_unit(F.col("unit")).alias("k_unit"),
        F.coalesce(as_date(F.col("period_end")).cast("string"), filled(F.col("period_end"))).alias("k_end"),
        F.upper(filled(F.col("fp"))).alias("k_fp"),
        F.coalesce(as_date(F.col("filed")), F.lit("0001-01-01").cast("date")).alias("filed"),
        F.coalesce(digits(F.col("accn")), F.lit("")).alias("accn_digits"),
        *[filled(F.col(f)).alias(f"v_{f}") for f in FIELDS],
    )
    # The map is a short, hand-written list; its size is known before it is broadcast (threshold of the session).
    keyed = keyed.join(names, "__c", "left").withColumn("k_metric", F.coalesce(F.concat(F.lit("metric "), "__metric"), F.concat(F.lit("concept "), "__c")))
    keys = ["k_cik", "k_metric", "k_unit", "k_end", "k_fp"]
    code = F.struct(*keys)
    keyed = keyed.withColumn("group", F.sha2(F.to_json(code, {"ignoreNullFields": "false"}), 256))
    groups = keyed.groupBy("group").agg(F.min("fact_id").alias("group_id"), F.max("fact_id").alias("__most")).where("group_id < __most").drop("__most")
    cells = keyed.select(
        "group", "fact_id", "filed", "accn_digits",
        F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"v_{f}").alias("value")) for f in FIELDS])).alias("c"),
    ).select("group", "fact_id", "filed", "accn_digits", "c.*").where("value IS NOT NULL")
    best = Window.partitionBy("group", "field_name").orderBy(F.desc("filed"), F.desc(F.length("accn_digits") > 0), F.desc("accn_digits"), F.asc("fact_id"), F.asc("value"))
    top = cells.withColumn("rank", F.row_number().over(best)).where("rank = 1").drop("rank")
    return top.join(groups, "group").select("group_id", "field_name", "fact_id", "value")


def survivors(facts: DataFrame, concept_map: DataFrame) -> DataFrame:
    """One surviving record per group: its fields side by side, of the types they had."""
    fields, kinds = field_survivors(facts, concept_map), dict(facts.dtypes)
    return fields.groupBy("group_id").agg(*[F.max(F.when(F.col("field_name") == f, F.col("value"))).cast(kinds[f]).alias(f) for f in FIELDS])
