import datetime
import unicodedata

import pytest
from pyspark.sql import functions as F

from evistrata.operators.snapshot_diff import risk_register_changes, snapshot_changes

D = [datetime.date(2021, 1, 1), datetime.date(2021, 7, 1), datetime.date(2022, 1, 1)]
SCHEMA = "snap_date date, delivery int, delivered_at timestamp_ntz, risk_id string, category string, summary string, accession_no string, filing_date string, extra string"


def row(date, key, summary="s", category="c", acc="0001-20-000001", filed="2020-01-02", delivery=1, at=None):
    return (D[date], delivery, at, key, category, summary, acc, filed, "x")


def changes(spark, rows):
    found = risk_register_changes(spark.createDataFrame(rows, SCHEMA)).collect()
    return {(r.snap_date, r.risk_id): (r.change_kind, list(r.changed_fields)) for r in found}


def test_kinds(spark):
    rows = [row(0, "a"), row(0, "b"), row(0, "c"), row(1, "a", summary="t"), row(1, "c"), row(1, "d"), row(2, "a", summary="t", category=None), row(2, "c"), row(2, "d")]
    assert changes(spark, rows) == {
        ("2021-07-01", "a"): ("changed", ["summary"]), ("2021-07-01", "b"): ("removed", []), ("2021-07-01", "d"): ("added", []),
        ("2022-01-01", "a"): ("changed", ["category"]),
    }


def test_same_value_written_otherwise(spark):
    composed = "Brystáth  Ünit"
    rows = [row(0, "a", summary=composed, category="Supply Chain"), row(1, "a", summary=" " + unicodedata.normalize("NFD", composed).upper() + " ", category="supply  chain ", acc="000120000001", filed="20200102")]
    assert changes(spark, rows) == {}


def test_only_the_highest_delivery_counts_and_repeats_are_one(spark):
    rows = [row(0, "a"), row(0, "a"), row(1, "a", summary="old"), row(1, "z"), row(1, "a", delivery=2), row(1, "a", delivery=2)]
    assert changes(spark, rows) == {}


def test_null_and_empty_are_values_and_keys_matter(spark):
    rows = [row(0, "a", category=None), row(1, "a", category=""), row(1, None), row(0, "b", summary=None), row(1, "b", summary=None)]
    assert changes(spark, rows) == {("2021-07-01", "a"): ("changed", ["category"])}


def test_late_row_of_a_delivery_wins(spark):
    early, late = datetime.datetime(2021, 7, 1, 3), datetime.datetime(2021, 7, 2, 3)
    rows = [row(0, "a"), row(1, "a", summary="wrong", at=early), row(1, "a", at=late)]
    assert changes(spark, rows) == {}


def test_empty_and_single_snapshot(spark):
    assert changes(spark, []) == {}
    assert changes(spark, [row(0, "a"), row(0, "b")]) == {}


def test_long_text_and_hot_key(spark):
    rows = [row(0, "a", summary="x" * 200_000)] * 50 + [row(1, "a", summary="x" * 200_000 + "y")] * 50
    assert changes(spark, rows) == {("2021-07-01", "a"): ("changed", ["summary"])}


def test_plain_fields(spark):
    df = spark.createDataFrame([(1, "k", 5), (2, "k", 6)], "snap_date int, id string, n int").withColumn("snap_date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("snap_date")))
    found = snapshot_changes(df, delivery=None, late=None, key="id", fields=["n"]).collect()
    assert [(r.id, r.change_kind) for r in found] == [("k", "changed")]


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    import random

    r = random.Random(seed)
    rows = [row(d, k, summary=r.choice(["s", "t", None]), category=r.choice("cd")) for d in range(3) for k in "abcdefgh" if r.random() < 0.7]
    states = [{x[3]: x[4:8] for x in rows if x[0] == d} for d in D if any(x[0] == d for x in rows)]
    want = {}
    for before, after, day in zip(states, states[1:], [d for d in D if any(x[0] == d for x in rows)][1:]):
        for k in before.keys() | after.keys():
            if k not in before or k not in after or before[k] != after[k]:
                want[(str(day), k)] = "added" if k not in before else "removed" if k not in after else "changed"
    assert {k: v[0] for k, v in changes(spark, rows).items()} == want
