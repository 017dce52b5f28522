"""Queries that score answers. The supplied texts stand for runs: a risk's summary is an answer of one
system, its evidence quote that of another, and its figures are what was expected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evistrata.functions.text import numbers
from evistrata.operators import evaluation
from evistrata.session import table

KINDS = ("numeric", "dependency", "refusal", "risk")


def _risks(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "risk_factors").where("risk_id IS NOT NULL AND summary IS NOT NULL AND evidence_quote IS NOT NULL AND chunk_id IS NOT NULL")
    return rows.groupBy("risk_id").agg(F.min(F.struct("summary", "evidence_quote", "chunk_id")).alias("r")).select("risk_id", "r.*")


def benchmark(spark: SparkSession, base: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.conv(F.substring("risk_id", 1, 1), 16, 10).cast("int") % 4 + 1)
    rows = _risks(spark, base).withColumn("type", kind).withColumn("v", F.get(numbers(F.col("summary")), 0))
    return rows.select(
        F.col("risk_id").alias("id"), "type", F.when((F.col("type") == "numeric") & (F.col("v") > 0), F.col("v")).alias("value"),
        F.when(F.col("type") == "dependency", F.array(F.upper(F.substring("summary", 1, 12)))).alias("any_of"),
    )


def runs(spark: SparkSession, base: str) -> DataFrame:
    digit = lambda i: F.conv(F.substring("risk_id", i, 1), 16, 10).cast("int")
    system = F.explode(F.array(F.struct(F.lit("hybrid").alias("system"), F.concat("summary", F.lit(" The filing does not contain more.")).alias("answer")), F.struct(F.lit("vector").alias("system"), F.col("evidence_quote").alias("answer"))))
    rows = _risks(spark, base).select("risk_id", "chunk_id", digit(2).alias("a"), digit(3).alias("b"), system.alias("s"))
    bad = (F.col("a") == 3) & (F.col("s.system") == "vector")
    return rows.select(
        F.col("risk_id").alias("id"), "s.system", "s.answer", F.array("chunk_id").alias("cited"),
        F.when(bad, F.array("chunk_id")).otherwise(F.array().cast("array<string>")).alias("hallucinated"),
        F.when(F.col("b") != 7, F.col("a") > 4).alias("judged"), F.when(F.col("b") != 9, F.least("a", "b")).alias("supported"), F.when(F.col("b") != 9, F.col("b")).alias("total"),
        F.col("a").alias("present"), F.col("b").alias("needed"), F.transform(F.array("a", "b"), lambda x: x % 2 == 0).alias("verdicts"), F.lit(2).alias("n_excerpts"),
        (F.col("a") / 10).alias("latency_s"), F.when(F.col("b") > 2, F.col("b") / 1000).alias("cost_usd"),
    )


def eval_score(spark: SparkSession, base: str) -> DataFrame:
    return evaluation.scored(runs(spark, base), benchmark(spark, base))


def eval_summary(spark: SparkSession, base: str) -> DataFrame:
    return evaluation.summary(eval_score(spark, base))


def eval_by_type(spark: SparkSession, base: str) -> DataFrame:
    return evaluation.by_type(eval_score(spark, base), ["hybrid", "vector"])


def failure_labels(spark: SparkSession, base: str) -> DataFrame:
    found = evaluation.failures(eval_score(spark, base), runs(spark, base))
    return found.select("id", "system", "type", "label", "mechanical")


def failure_counts(spark: SparkSession, base: str) -> DataFrame:
    found = evaluation.failures(eval_score(spark, base), runs(spark, base))
    return evaluation.failure_counts(found).select("system", "label", "n", F.round("mechanical_share", 4).alias("mechanical_share"))


def open_runs(spark: SparkSession, base: str) -> DataFrame:
    done = runs(spark, base).where("system = 'hybrid' AND id < '8'")
    return evaluation.open_runs(benchmark(spark, base).select("id"), ["hybrid", "vector"], done)


_NUM = """list_filter(list_transform(list_zip(regexp_extract_all(replace({0}, ',', ''), '(?i)\\$?([0-9][0-9.]*)\\s*(billion|bn|b\\b|million|mn|m\\b|trillion)?', 1),
  regexp_extract_all(replace({0}, ',', ''), '(?i)\\$?([0-9][0-9.]*)\\s*(billion|bn|b\\b|million|mn|m\\b|trillion)?', 2)),
  lambda p: try_cast(p[1] AS DOUBLE) * CASE WHEN lower(p[2]) IN ('billion', 'bn', 'b') THEN 1e9 WHEN lower(p[2]) IN ('million', 'mn', 'm') THEN 1e6 WHEN lower(p[2]) = 'trillion' THEN 1e12 ELSE 1 END), lambda v: v IS NOT NULL)"""
_REFUSES = "regexp_matches(answer, '(?i)does not (contain|include|provide)|not available|no (information|data|filings)|cannot (be )?(determin|answer|find)|isn''t|is not in the (context|filings|corpus)|not an SEC filer')"
_SCORES = f"""WITH rr AS (SELECT risk_id, summary, evidence_quote, chunk_id, (instr('0123456789abcdef', risk_id[1]) - 1) % 4 AS k, instr('0123456789abcdef', risk_id[2]) - 1 AS a, instr('0123456789abcdef', risk_id[3]) - 1 AS b
  FROM risk_factors WHERE risk_id IS NOT NULL AND summary IS NOT NULL AND evidence_quote IS NOT NULL AND chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY risk_id ORDER BY summary, evidence_quote, chunk_id) = 1),
bench AS (SELECT risk_id, ['numeric', 'dependency', 'refusal', 'risk'][k + 1] AS type, CASE WHEN k = 0 AND {_NUM.format('summary')}[1] > 0 THEN {_NUM.format('summary')}[1] END AS value,
  CASE WHEN k = 1 THEN upper(left(summary, 12)) END AS said FROM rr),
runs AS (SELECT risk_id, 'hybrid' AS system, summary || ' The filing does not contain more.' AS answer, a, b FROM rr UNION ALL SELECT risk_id, 'vector', evidence_quote, a, b FROM rr),
scores AS (SELECT risk_id AS id, system, type, answer, NOT (a = 3 AND system = 'vector') AS citation_ok, 1 AS n_citations,
  CASE WHEN type = 'refusal' THEN {_REFUSES} WHEN value IS NOT NULL THEN len(list_filter({_NUM.format('answer')}, lambda v: v = value OR abs(v - value) < 0.005 * abs(value))) > 0
    WHEN said IS NOT NULL THEN contains(lower(answer), lower(said)) WHEN b <> 7 THEN a > 4 END AS correct,
  CASE WHEN type <> 'refusal' AND b <> 9 THEN CASE WHEN b = 0 THEN 1.0 ELSE least(a, b) / b END END AS faithfulness,
  CASE WHEN b = 0 THEN 1.0 ELSE least(a, b) / b END AS context_recall, ((a % 2 = 0)::INT + (b % 2 = 0)::INT) / 2 AS context_precision, a / 10 AS latency_s, CASE WHEN b > 2 THEN b / 1000 END AS cost_usd
  FROM runs JOIN bench USING (risk_id)),
failed AS (SELECT *, CASE WHEN type = 'refusal' AND NOT coalesce(correct, true) THEN 'REFUSAL_MISSED' WHEN type <> 'refusal' AND {_REFUSES} AND NOT coalesce(correct, true) THEN 'REFUSAL_OVERTRIGGER'
    WHEN coalesce(correct, true) AND NOT citation_ok THEN 'FORMAT_OR_CITATION' WHEN context_recall < 0.5 THEN 'RETRIEVAL_MISS' WHEN type = 'numeric' AND NOT coalesce(correct, true) THEN 'NUMERIC_MISMATCH' END AS rule
  FROM scores WHERE NOT coalesce(correct, true) OR coalesce(faithfulness, 1) < 0.8 OR NOT citation_ok)"""
_MEANS = ", ".join(f"round_even(avg({c}::DOUBLE), 4) AS {n}" for n, c in evaluation.METRICS.items())
QUERIES = {f.__name__: f for f in (eval_score, eval_summary, eval_by_type, failure_labels, failure_counts, open_runs)}
SQL = {
    "eval_score": f"{_SCORES} SELECT id, system, type, citation_ok, n_citations, correct, faithfulness, context_recall, context_precision, latency_s, cost_usd FROM scores",
    "eval_summary": f"{_SCORES} SELECT system, {_MEANS} FROM scores GROUP BY 1",
    "eval_by_type": f"{_SCORES} SELECT type, round_even(avg(correct::DOUBLE) FILTER (system = 'hybrid'), 2) AS hybrid, round_even(avg(correct::DOUBLE) FILTER (system = 'vector'), 2) AS vector FROM scores GROUP BY 1",
    "failure_labels": f"{_SCORES} SELECT id, system, type, coalesce(rule, 'OTHER') AS label, rule IS NOT NULL AS mechanical FROM failed",
    "failure_counts": f"{_SCORES} SELECT system, coalesce(rule, 'OTHER') AS label, count(*) AS n, round(avg((rule IS NOT NULL)::INT), 4) AS mechanical_share FROM failed GROUP BY 1, 2",
    "open_runs": f"{_SCORES} SELECT risk_id AS id, system FROM bench, (VALUES ('hybrid'), ('vector')) s(system) WHERE NOT (system = 'hybrid' AND risk_id < '8')",
}
