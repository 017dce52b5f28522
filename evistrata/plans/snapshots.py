"""Queries over full snapshots (problem 3) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evistrata.operators.snapshot_diff import risk_register_changes
from evistrata.session import table


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return risk_register_changes(table(spark, base, "risk_snapshots")).select("snap_date", "risk_id", "change_kind")


def p3_changes(spark: SparkSession, base: str) -> DataFrame:
    return risk_register_changes(table(spark, base, "risk_snapshots")).withColumn("changed_fields", F.array_join("changed_fields", ","))


def p3_summary(spark: SparkSession, base: str) -> DataFrame:
    return (
        risk_register_changes(table(spark, base, "risk_snapshots"))
        .groupBy("snap_date")
        .agg(
            F.count_if(F.col("change_kind") == "added").alias("n_added"),
            F.count_if(F.col("change_kind") == "removed").alias("n_removed"),
            F.count_if(F.col("change_kind") == "changed").alias("n_changed"),
        )
    )


_TEXT = r"trim(regexp_replace(lower(nfc_normalize({0})), '[\s\x{{00A0}}\x{{2000}}-\x{{200B}}\x{{202F}}\x{{3000}}\x{{FEFF}}]+', ' ', 'g'))"
_CODE = r"regexp_replace(" + _TEXT + r", '[-\x{{2010}}-\x{{2015}}\x{{2212}} ]', '', 'g')"
_STATES = f"""
WITH last AS (SELECT snap_date, max(delivery) AS delivery FROM risk_snapshots GROUP BY 1),
dates AS (SELECT snap_date, lag(snap_date) OVER (ORDER BY snap_date) AS before, lead(snap_date) OVER (ORDER BY snap_date) AS after FROM last),
states AS (
  SELECT DISTINCT r.snap_date, r.risk_id, {_TEXT.format('summary')} AS summary, {_TEXT.format('category')} AS category,
    {_CODE.format('accession_no')} AS accession_no, {_CODE.format('filing_date')} AS filing_date
  FROM risk_snapshots r JOIN last l ON r.snap_date = l.snap_date AND r.delivery = l.delivery WHERE risk_id IS NOT NULL),
pairs AS (
  SELECT d.snap_date, n.risk_id, o.risk_id IS NULL AS added, n.summary IS DISTINCT FROM o.summary AS s, n.category IS DISTINCT FROM o.category AS c,
    n.accession_no IS DISTINCT FROM o.accession_no AS a, n.filing_date IS DISTINCT FROM o.filing_date AS f
  FROM states n JOIN dates d ON d.snap_date = n.snap_date AND d.before IS NOT NULL
  LEFT JOIN states o ON o.risk_id = n.risk_id AND o.snap_date = d.before),
changes AS (
  SELECT strftime(snap_date, '%Y-%m-%d') AS snap_date, risk_id, CASE WHEN added THEN 'added' ELSE 'changed' END AS change_kind,
    CASE WHEN added THEN '' ELSE concat_ws(',', CASE WHEN a THEN 'accession_no' END, CASE WHEN c THEN 'category' END,
      CASE WHEN f THEN 'filing_date' END, CASE WHEN s THEN 'summary' END) END AS changed_fields
  FROM pairs WHERE added OR s OR c OR a OR f
  UNION ALL
  SELECT strftime(d.after, '%Y-%m-%d'), o.risk_id, 'removed', ''
  FROM states o JOIN dates d ON d.snap_date = o.snap_date AND d.after IS NOT NULL
  WHERE NOT EXISTS (SELECT 1 FROM states n WHERE n.risk_id = o.risk_id AND n.snap_date = d.after))
"""

QUERIES = {"p3_found": p3_found, "p3_changes": p3_changes, "p3_summary": p3_summary}
SQL = {
    "p3_found": _STATES + "SELECT snap_date, risk_id, change_kind FROM changes",
    "p3_changes": _STATES + "SELECT snap_date, risk_id, change_kind, changed_fields FROM changes",
    "p3_summary": _STATES
    + """SELECT snap_date, count(*) FILTER (change_kind = 'added') AS n_added, count(*) FILTER (change_kind = 'removed') AS n_removed,
      count(*) FILTER (change_kind = 'changed') AS n_changed FROM changes GROUP BY 1""",
}
