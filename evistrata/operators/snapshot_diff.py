"""Differences between consecutive full snapshots of a table.

Every snapshot is unpivoted into signed cells ``(transition, key, field, value)``: a row counts +1 in
the transition that its own snapshot date ends and -1 in the transition to the next date present. Cells
that occur on both sides cancel out, whatever remains is a difference. One presence cell per key tells
added (+1) from removed (-1). Only partial sums are shuffled, and no snapshot is joined with another.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

PRESENCE = "\u0001present"


@F.pandas_udf(T.StringType())
def _composed(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None else unicodedata.normalize("NFC", v))


def composed(value: Column) -> Column:
    """NFC of a string; pure ASCII strings, already composed, are not sent to Python."""
    other = value.rlike(r"[^\x00-\x7F]")
    return F.when(other, _composed(F.when(other, value))).otherwise(value)


def comparable_text(value: Column) -> Column:
    """Same text in other blanks, letter case or Unicode composition compares as equal."""
    blanks = r"(?U)[\s ​﻿]+"
    return F.trim(F.regexp_replace(F.lower(composed(value)), blanks, " "))


def comparable_code(value: Column) -> Column:
    """As ``comparable_text``, and hyphens do not count."""
    return F.regexp_replace(comparable_text(value), r"[-‐-―− ]", "")


def snapshot_changes(
    snapshots: DataFrame,
    *,
    date: str = "snap_date",
    delivery: str | None = "delivery",
    late: str | None = "delivered_at",
    key: str = "risk_id",
    fields: Mapping[str, Column] | Sequence[str] = (),
) -> DataFrame:
    """Added, removed and changed keys between neighbouring snapshot dates present.

    ``fields`` maps a field name to the expression in which its values compare. Returns ``snap_date``
    (the later date, yyyy-mm-dd), ``key``, ``change_kind`` and the sorted ``changed_fields``.

    Defined cases: of a date only the highest delivery counts; a repeated row counts once, and where
    rows of one key differ inside a delivery the latest ``late`` value wins per field (ties: the
    greatest value); a null value is a value of its own, unlike the empty text; rows with a null key
    or a null date are left out; the first date gives no cases, an empty table none at all.
    """
    fields = fields if isinstance(fields, Mapping) else {f: F.col(f) for f in fields}
    last = [F.col(delivery)] if delivery else [F.lit(1)]
    dates = (
        snapshots.where(F.col(date).isNotNull())
        .groupBy(F.col(date).alias("__at"))
        .agg(F.max(last[0]).alias("__last"))
    )
    # One row per snapshot date: the calendar has as many rows as there are dates, so it may be broadcast.
    order = Window.orderBy("__at")
    calendar = dates.select("*", F.lead("__at").over(order).alias("__next"), (F.row_number().over(order) == 1).alias("__first"))

    rows = snapshots.where(F.col(key).isNotNull()).select(
        F.col(date).alias("__at"),
        last[0].alias("__delivery"),
        (F.col(late).cast("string") if late else F.lit("")).alias("__late"),
        F.col(key).cast("string").alias("__key"),
        *[e.cast("string").alias(f"__f_{n}") for n, e in fields.items()],
    )
    rows = rows.join(F.broadcast(calendar), "__at").where("__delivery = __last")
    # Repeated rows of a key collapse before anything is unpivoted; the partial aggregate runs map-side.
    # xxhash of the comparable value stands for it: cells need equality only, and eight bytes are cheap to move.
    value = lambda n: F.struct(
        F.coalesce("__late", F.lit("")).alias("late"),
        F.xxhash64(F.coalesce(F.concat(F.lit("="), F.col(f"__f_{n}")), F.lit("null"))).alias("v"),
    )
    one = rows.groupBy("__key", "__at", "__next", "__first").agg(*[F.max(value(n)).alias(n) for n in fields])
    # A key has at most one row per date by now; with a key's rows together no later step needs a shuffle.
    one = one.select("__key", "__at", "__next", "__first", *[F.col(f"`{n}`.v").alias(n) for n in fields]).repartition("__key")
    cells = F.array(
        F.struct(F.lit(PRESENCE).alias("field"), F.lit(0).cast("long").alias("value")),
        *[F.struct(F.lit(n).alias("field"), F.col(f"`{n}`").alias("value")) for n in fields],
    )
    sides = F.array(
        F.struct(F.when(~F.col("__first"), F.col("__at")).alias("to"), F.lit(1).alias("sign")),
        F.struct(F.col("__next").alias("to"), F.lit(-1).alias("sign")),
    )
    signed = (
        one.select("__key", F.explode(sides).alias("s"), cells.alias("cells"))
        .where("s.to IS NOT NULL")
        .select("__key", F.col("s.to").alias("to"), F.col("s.sign").alias("sign"), F.explode("cells").alias("c"))
        .select("__key", "to", "sign", "c.field", "c.value")
    )
    left = signed.groupBy("__key", "to", "field", "value").agg(F.sum("sign").alias("n")).where("n <> 0")
    return (
        left.groupBy("__key", "to")
        .agg(
            F.sum(F.when(F.col("field") == PRESENCE, F.col("n")).otherwise(0)).alias("present"),
            F.array_sort(F.collect_set(F.when(F.col("field") != PRESENCE, F.col("field")))).alias("fields"),
        )
        .select(
            F.date_format("to", "yyyy-MM-dd").alias("snap_date"),
            F.col("__key").alias(key),
            F.when(F.col("present") > 0, "added").when(F.col("present") < 0, "removed").otherwise("changed").alias("change_kind"),
            F.when(F.col("present") == 0, F.col("fields")).otherwise(F.array().cast("array<string>")).alias("changed_fields"),
        )
    )


def risk_register_changes(snapshots: DataFrame) -> DataFrame:
    """``snapshot_changes`` with the comparison rules of the risk register."""
    return snapshot_changes(
        snapshots,
        fields={
            "summary": comparable_text(F.col("summary")),
            "category": comparable_text(F.col("category")),
            "accession_no": comparable_code(F.col("accession_no")),
            "filing_date": comparable_code(F.col("filing_date")),
        },
    )
