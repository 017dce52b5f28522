"""Scoring of answers, summaries, and the labels of failures; mechanical checks first."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from evistrata.functions.text import is_refusal, numbers

#: The accepted relative error of a number, and the bounds of a faithful and of a recalled answer.
TOLERANCE, FAITHFUL, RECALLED = 0.005, 0.8, 0.5
#: The labels of failures.
LABELS = (
    "RETRIEVAL_MISS", "UNGROUNDED_CLAIM", "WRONG_ENTITY", "STALE_RISK_LEAK", "NUMERIC_MISMATCH",
    "REFUSAL_OVERTRIGGER", "REFUSAL_MISSED", "FORMAT_OR_CITATION", "OTHER",
)
#: The metrics of a summary and the scores they are means of.
METRICS = {
    "correct": "correct", "faithfulness": "faithfulness", "context_precision": "context_precision", "context_recall": "context_recall",
    "citation_validity": "citation_ok", "avg_citations": "n_citations", "avg_cost_usd": "cost_usd", "avg_latency_s": "latency_s",
}


def correctness(kind: Column, answer: Column, value: Column, any_of: Column, judged: Column) -> Column:
    """By kind and expectation: a refusal where one is due; else a number within 0.5 % of the expected
    value (of zero only zero is); else one of the expected strings; else a judge's verdict, which may be missing."""
    near = F.exists(numbers(answer), lambda v: (v == value) | (F.abs(v - value) < TOLERANCE * F.abs(value)))
    said = F.exists(any_of, lambda s: F.contains(F.lower(answer), F.lower(s)))
    return F.when(kind == "refusal", is_refusal(answer)).when(value.isNotNull(), near).when(any_of.isNotNull(), said).otherwise(judged)


def faithfulness(kind: Column, supported: Column, total: Column) -> Column:
    """Supported share of the claims, 1 without claims; null for refusals and where the judge failed."""
    return F.when((kind != "refusal") & supported.isNotNull() & total.isNotNull(), F.when(total == 0, 1.0).otherwise(supported / total))


def context_recall(present: Column, needed: Column) -> Column:
    return F.when(present.isNotNull() & needed.isNotNull(), F.when(needed == 0, 1.0).otherwise(F.least(present, needed) / needed))


def context_precision(verdicts: Column, n_excerpts: Column) -> Column:
    """Mean of the verdicts, if there is one per excerpt."""
    good = F.size(F.filter(verdicts, lambda v: v))
    return F.when((F.size(verdicts) == n_excerpts) & (n_excerpts > 0), good / n_excerpts)


def scored(runs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row of scores per run. ``runs``: id, system, answer, cited, hallucinated, judged, supported,
    total, present, needed, verdicts, n_excerpts, latency_s, cost_usd (missing columns are null);
    ``benchmark``: id, type, value, any_of."""
    for name, kind in {"judged": "boolean", "supported": "int", "total": "int", "present": "int", "needed": "int", "verdicts": "array<boolean>", "n_excerpts": "int", "latency_s": "double", "cost_usd": "double"}.items():
        if name not in runs.columns:
            runs = runs.withColumn(name, F.lit(None).cast(kind))
    rows = runs.join(benchmark.select("id", "type", "value", "any_of"), "id")
    c = F.col
    return rows.select(
        "id", "system", "type",
        (F.size("hallucinated") == 0).alias("citation_ok"), F.size("cited").alias("n_citations"),
        correctness(c("type"), c("answer"), c("value"), c("any_of"), c("judged")).alias("correct"),
        faithfulness(c("type"), c("supported"), c("total")).alias("faithfulness"),
        context_recall(c("present"), c("needed")).alias("context_recall"),
        context_precision(c("verdicts"), c("n_excerpts")).alias("context_precision"),
        "latency_s", "cost_usd",
    )


def summary(scores: DataFrame) -> DataFrame:
    """Means per system to four digits, half to even; nulls are skipped, absent metrics left out."""
    means = [F.bround(F.avg(F.col(c).cast("double")), 4).alias(n) for n, c in METRICS.items() if c in scores.columns]
    return scores.groupBy("system").agg(*means)


def by_type(scores: DataFrame, systems: list[str]) -> DataFrame:
    """Mean correctness by type, a column per system. The systems are named, so no pass looks for them."""
    rows = scores.withColumn("correct", F.col("correct").cast("double"))
    return rows.groupBy("type").pivot("system", systems).agg(F.bround(F.avg("correct"), 2))


def is_failure() -> Column:
    """Wrong, under 0.8 faithful, or a bad citation; what is missing counts as passed."""
    passed = F.coalesce("correct", F.lit(True)) & (F.coalesce("faithfulness", F.lit(1.0)) >= FAITHFUL) & F.coalesce("citation_ok", F.lit(True))
    return ~passed


def mechanical_label(kind: Column, answer: Column) -> Column:
    correct, cites = F.coalesce("correct", F.lit(True)), F.coalesce("citation_ok", F.lit(True))
    return (
        F.when((kind == "refusal") & ~correct, "REFUSAL_MISSED")
        .when((kind != "refusal") & F.coalesce(is_refusal(answer), F.lit(False)) & ~correct, "REFUSAL_OVERTRIGGER")
        .when(correct & ~cites, "FORMAT_OR_CITATION")
        .when(F.col("context_recall") < RECALLED, "RETRIEVAL_MISS")
        .when((kind == "numeric") & ~correct, "NUMERIC_MISMATCH")
    )


def failures(scores: DataFrame, runs: DataFrame, judge: Callable[[pd.DataFrame], pd.Series] | None = None) -> DataFrame:
    """Failed runs with a label. What no rule decides goes to ``judge`` (a batch of rows to labels), whose
    unknown labels are OTHER; without a judge it is OTHER."""
    answers = runs.select("id", "system", "answer")
    rows = scores.where(is_failure()).join(answers, ["id", "system"], "left")
    rows = rows.withColumn("label", mechanical_label(F.col("type"), F.col("answer"))).withColumn("mechanical", F.col("label").isNotNull())
    columns = ["id", "system", "type", "label", "mechanical", "correct", "faithfulness", "citation_ok", "context_recall"]
    if judge is None:
        return rows.withColumn("label", F.coalesce("label", F.lit("OTHER"))).select(*columns)

    def ask(batches):
        for batch in batches:
            open_ = batch["label"].isna()
            if open_.any():
                said = judge(batch[open_])
                batch.loc[open_, "label"] = said.where(said.isin(LABELS), "OTHER")
            yield batch[columns]

    kinds = ", ".join(f"{n} {dict(rows.dtypes)[n]}" for n in columns)
    return rows.select(*columns, "answer").mapInPandas(ask, kinds)


def failure_counts(failed: DataFrame) -> DataFrame:
    return failed.groupBy("system", "label").agg(F.count("*").alias("n"), F.avg(F.col("mechanical").cast("double")).alias("mechanical_share"))


def open_runs(benchmark: DataFrame, systems: list[str], done: DataFrame) -> DataFrame:
    """Questions by system that have no run yet. The systems are a handful of literals."""
    every = benchmark.withColumn("system", F.explode(F.array(*map(F.lit, systems))))
    return every.join(done.select("id", "system").distinct(), ["id", "system"], "left_anti")
