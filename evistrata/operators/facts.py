"""Curated metrics from reported facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evistrata.functions.dates import any_date

#: Forms that report full years.
ANNUAL_FORMS = ("10-K", "20-F")
FULL_YEAR_DAYS = 300


def curated_metrics(facts: DataFrame, concept_map: DataFrame) -> DataFrame:
    """One row per company, metric, period end and unit: the first disclosure of a full-year figure.

    Facts of annual forms with a start, of more than 300 days, whose concept the map knows, in the order
    of (filed, accn, concept); missing filing dates come last. A ticker or accn that the first one lacks is
    the first there is. The map is a short list and is joined first, so only its concepts are shuffled, and
    the facts of a key are reduced in each task before.
    """
    start, end = any_date(F.col("period_start")), any_date(F.col("period_end"))
    known = facts.where(F.col("form").isin(*ANNUAL_FORMS)).join(concept_map, "concept")
    rows = known.select(
        "cik", "ticker", "metric", "concept", start.alias("period_start"), end.alias("period_end"), "val",
        F.upper(F.trim("unit")).alias("unit"), "accn", any_date(F.col("filed")).alias("filed"),
    ).where(F.col("val").isNotNull() & (F.datediff("period_end", "period_start") > FULL_YEAR_DAYS))
    order = [F.col("filed").isNull().alias("a"), F.col("filed"), F.col("accn").isNull().alias("b"), *map(F.col, ("accn", "concept", "val", "ticker", "period_start"))]
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(*order)))[c].alias(c)
    found = rows.groupBy("cik", "metric", "period_end", "unit").agg(F.min(F.struct(*order)).alias("r"), first("ticker"), first("accn"))
    return found.select("cik", "ticker", "metric", "r.concept", "r.period_start", "period_end", "r.val", "unit", "accn", "r.filed")


def metric_lookup(metrics: DataFrame, anchors: list[int], limit: int = 20) -> DataFrame:
    """The latest metrics of the anchors, newest period first over all of them; ties by company and metric."""
    return metrics.where(F.col("cik").isin(*anchors)).orderBy(F.desc_nulls_first("period_end"), "cik", "metric", "unit").limit(limit)
