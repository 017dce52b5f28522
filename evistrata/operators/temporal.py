"""Valid-time states of disclosed risks: lineages, closure, as-of, dropped and new ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from evistrata.functions.dates import active_on

SAME_RISK = 0.75


class Lineages:
    """Greedy clustering of vectors that come one by one; only the centres are kept.

    A vector joins the most similar lineage so far if it is similar enough (and more than 0), else it
    starts one. A centre is the mean of its members at length one; of equally similar lineages the first
    is taken. Vectors count at length one. Inner products are in double precision.
    """

    def __init__(self, threshold: float = SAME_RISK):
        self.threshold, self.n = threshold, 0
        self.sums = self.centres = np.zeros((0, 0))

    def add(self, vector) -> int:
        v = np.asarray(vector, np.float64)
        v = v / (np.linalg.norm(v) or 1)
        best = -1
        if self.n:
            similar = self.centres[: self.n] @ v
            best = int(similar.argmax())
            if similar[best] <= 0 or similar[best] < self.threshold - 1e-12:
                best = -1
        if best < 0:
            best, self.n = self.n, self.n + 1
            if best >= len(self.sums):
                grown = np.zeros((max(16, 2 * self.n), len(v)))
                for old in ("sums", "centres"):
                    wider = grown.copy()
                    if best:
                        wider[:best] = getattr(self, old)[:best]
                    setattr(self, old, wider)
        self.sums[best] += v
        length = np.linalg.norm(self.sums[best])
        self.centres[best] = self.sums[best] / length if length else self.sums[best]
        return best


def greedy_lineages(vectors: np.ndarray, threshold: float = SAME_RISK) -> np.ndarray:
    """The lineage number of each vector, in order."""
    found = Lineages(threshold)
    return np.array([found.add(v) for v in vectors], np.int64)


def lineages(risks: DataFrame, *, key: str = "cik", order: tuple[str, ...] = ("filing_date", "risk_id"), threshold: float = SAME_RISK, vector: str = "embedding") -> DataFrame:
    """``risk_id``, the order columns, ``key`` and ``lineage_id`` (key:number).

    Lineages form in the order of filing, so a company is one sequence. Its rows are sorted in their
    partition and pass by in batches; no company is held in memory, only its centres are. Rows without
    a vector are left out.
    """
    names = ["risk_id", *[o for o in order if o != "risk_id"], key]
    kinds = dict(risks.dtypes)

    def cluster(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        company, found = object(), Lineages(threshold)
        for batch in batches:
            numbers = []
            for k, v in zip(batch[key], batch[vector]):
                if k != company:
                    company, found = k, Lineages(threshold)
                numbers.append(found.add(v))
            yield batch[names].assign(lineage_no=numbers)

    rows = risks.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(*names, vector).repartition(key).sortWithinPartitions(key, *order)
    numbered = rows.mapInPandas(cluster, ", ".join(f"{n} {kinds[n]}" for n in names) + ", lineage_no long")
    return numbered.withColumn("lineage_id", F.concat_ws(":", F.col(key).cast("string"), F.col("lineage_no").cast("string"))).drop("lineage_no")


def states(members: DataFrame, *, key: str = "cik", lineage: str = "lineage_id", day: str = "filing_date", filing: str = "accession_no") -> DataFrame:
    """Per member: first and last day of its lineage, and whether that is closed.

    A lineage is Deleted if it was last seen before the latest filing among the company's disclosures and
    there is more than one filing; it then ends on that latest day.
    """
    per_lineage = members.groupBy(key, lineage).agg(F.min(day).alias("first_seen"), F.max(day).alias("last_seen"))
    per_company = members.groupBy(key).agg(F.max(day).alias("latest"), F.countDistinct(filing).alias("filings"))
    closed = (F.col("last_seen") < F.col("latest")) & (F.col("filings") > 1)
    known = per_lineage.join(per_company, key).select(
        key, lineage, "first_seen", "last_seen", F.when(closed, "Deleted").otherwise("Active").alias("status"), F.when(closed, F.col("latest")).alias("end_date")
    )
    return members.join(known, [key, lineage])


def company_statistics(states: DataFrame, *, key: str = "cik", lineage: str = "lineage_id", filing: str = "accession_no") -> DataFrame:
    return states.groupBy(key).agg(
        F.countDistinct(filing).alias("annuals"), F.count("*").alias("risk_nodes"), F.countDistinct(lineage).alias("lineages"),
        F.countDistinct(F.when(F.col("status") == "Deleted", F.col(lineage))).alias("closed_lineages"),
    )


def active_lineages(states: DataFrame, day: Column, *, by: str = "cik", only: Column | None = None) -> DataFrame:
    """Lineages active on a day, per company, most first; a condition is applied only if given."""
    rows = states.where(active_on(day, F.col("first_seen"), F.col("end_date")))
    rows = rows.where(only) if only is not None else rows
    return rows.groupBy(by).agg(F.countDistinct("lineage_id").alias("active_lineages")).orderBy(F.desc("active_lineages"), by)


def dropped(states: DataFrame, *, by: str = "cik", example: str = "summary", limit: int | None = 10) -> DataFrame:
    """Deleted lineages with their days and the example of the least risk id, latest first."""
    rows = states.where("status = 'Deleted' AND lineage_id IS NOT NULL").groupBy(by, "lineage_id").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.min(F.struct(F.col("risk_id").alias("r"), F.col(example).alias("e")))["e"].alias("example")
    )
    return rows.orderBy(F.desc("last_seen"), by, "lineage_id").limit(limit) if limit else rows


def newest(states: DataFrame, *, by: str = "cik", day: str = "filing_date") -> DataFrame:
    """Lineages that were first seen in the company's latest filing."""
    latest = Window.partitionBy(by)
    return states.withColumn("__latest", F.max(day).over(latest)).where("first_seen = __latest").drop("__latest")


def violations(states: DataFrame) -> DataFrame:
    """Risks without exactly one state, Deleted ones without an end, ends before starts: ``problem, n``."""
    repeated = states.groupBy("risk_id").agg(F.count("*").alias("n")).where("n <> 1").agg(F.count("*").alias("n")).select(F.lit("not one state").alias("problem"), "n")
    rules = {"deleted without end": "status = 'Deleted' AND end_date IS NULL", "active with end": "status = 'Active' AND end_date IS NOT NULL", "ends before it starts": "end_date < first_seen"}
    for problem, rule in rules.items():
        repeated = repeated.union(states.where(rule).agg(F.count("*").alias("n")).select(F.lit(problem).alias("problem"), "n"))
    return repeated

