"""Explicit schemas of the lake, the graph and the service tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T


def _struct(text: str) -> str:
    """Schemas are kept as DDL, which needs no session; ``fields`` parses it."""
    return text


def fields(schema: str) -> T.StructType:
    return T.StructType.fromDDL(schema)


LAKE = {
    "manifest": _struct("ticker string, cik long, form string, filing_date string, accession_no string, source_url string, local_path string, size_bytes long"),
    "elements": _struct("accession_no string, element_index int, element_type string, text string"),
    "sections": _struct("accession_no string, form string, filing_date string, element_index int, section_id string, section_title string, element_type string, text string"),
    "section_texts": _struct("accession_no string, section_id string, form string, filing_date string, section_title string, text string, n_chars int"),
    "chunks": _struct(
        "chunk_id string, ticker string, cik long, form string, filing_date string, accession_no string, section_id string, section_title string, "
        "sub_heading string, kind string, text string, char_start int, char_end int, n_tokens int, source_url string"
    ),
    "facts": _struct(
        "taxonomy string, concept string, label string, unit string, period_start string, period_end string, val double, accn string, fy int, fp string, form string, filed string, frame string"
    ),
    "metrics": _struct("metric string, concept string, period_start date, period_end date, val double, unit string, accn string, ticker string, cik long"),
    "extractions": _struct(
        "chunk_id string, ticker string, accession_no string, section_id string, "
        "relations array<struct<source_entity:string,relation:string,target_entity:string,evidence_quote:string>>, "
        "risk_factors array<struct<summary:string,category:string,evidence_quote:string>>, products array<struct<name:string,type:string>>"
    ),
    "resolution_report": _struct(
        "ticker string, chunk_id string, source_entity string, relation string, target_entity string, evidence_quote string, src_resolved string, tgt_resolved string"
    ),
    "embeddings": _struct("chunk_id string, embedding array<float>"),
    "rules": _struct("document_number string, title string, publication_date string, html_url string, abstract string"),
}
NODES = {
    "Company": ("cik", _struct("cik long, ticker string, name string, tier string, sec_filer boolean")),
    "Filing": ("accession_no", _struct("accession_no string, form string, filing_date date, url string")),
    "FilingSection": ("section_key", _struct("section_key string, section_id string, title string, n_chars int")),
    "Metric": ("metric_id", _struct("metric_id string, metric string, concept string, value double, unit string, period_start date, period_end date")),
    "RiskFactor": ("risk_id", _struct("risk_id string, summary string, category string, embedding array<float>, lineage_id string, first_seen date, last_seen date")),
    "EvidenceSpan": ("chunk_id", _struct("chunk_id string, text string, kind string, sub_heading string, char_start int, char_end int, n_tokens int, source_url string, embedding array<float>")),
    "Product": ("name", _struct("name string, type string")),
    "ExportControl": ("rule_id", _struct("rule_id string, title string, date date, url string, abstract string")),
}
EDGES = {
    "FILED": _struct("src long, dst string, date date"),
    "HAS_SECTION": _struct("src string, dst string"),
    "REPORTS_METRIC": _struct("src long, dst string, accession_no string"),
    "FROM_SECTION": _struct("src string, dst string"),
    "MENTIONS": _struct("src string, dst long"),
    **dict.fromkeys(
        ("SUPPLIES_TO", "DEPENDS_ON", "CUSTOMER_OF", "COMPETES_WITH"),
        _struct("src long, dst long, start_date date, status string, evidence_chunk_ids array<string>, evidence_quote string"),
    ),
    "HAS_EVIDENCE": _struct("src string, dst string, quote string"),
    "DISCLOSES_RISK": _struct("src long, dst string, start_date date, end_date date, status string"),
    "MENTIONED_IN": _struct("src string, dst string"),
    "AFFECTED_BY": _struct("src long, dst string, start_date date, status string, evidence_chunk_ids array<string>"),
}
SERVICE = {
    "ledger": _struct("id string, day string, ip_hash string, strategy string, cached boolean, prompt_tokens int, completion_tokens int, cost_usd double, created_at timestamp"),
    "answers": _struct("key string, question string, strategy string, answer string, citations array<string>, hallucinated array<string>, source string, created_at timestamp"),
    "policy": _struct("key string, value string, updated_at timestamp"),
}


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """No rows, all columns: what every operator gives for an empty input."""
    return spark.createDataFrame([], schema)


def conform(df: DataFrame, schema: str) -> DataFrame:
    """The columns of ``schema`` in its order and types; missing ones are null, others are dropped."""
    from pyspark.sql import functions as F

    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields(schema)])


def key_violations(df: DataFrame, *key: str) -> DataFrame:
    """Keys that are null or occur more than once, with their counts: the uniqueness assertion."""
    from pyspark.sql import functions as F

    null = F.lit(False)
    for k in key:
        null = null | F.col(k).isNull()
    return df.groupBy(*key).agg(F.count("*").alias("n")).where(null | (F.col("n") > 1))
