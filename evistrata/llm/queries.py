"""Queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evistrata.llm import budget, encoding, mixing, names, near_duplicates, neighbours, splitting, survivors, truncation
from evistrata.llm.sql import SQL  # noqa: F401
from evistrata.session import table


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    linked = names.linked_mentions(table(spark, base, "extractions"), table(spark, base, "canonical_entities"))
    return linked.where("entity_id IS NOT NULL AND NOT is_exact").select("record_no", "rel_pos", "side", "entity_id")


def p1_mentions(spark: SparkSession, base: str) -> DataFrame:
    return names.linked_mentions(table(spark, base, "extractions"), table(spark, base, "canonical_entities"))


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return splitting.split_oversized(table(spark, base, "chunks")).select("chunk_id").where("chunk_id IS NOT NULL").distinct()


def p2_pieces(spark: SparkSession, base: str) -> DataFrame:
    return splitting.distinct_pieces(splitting.split_oversized(table(spark, base, "chunks")))


def _vectors(spark: SparkSession, base: str) -> DataFrame:
    return neighbours.evidence_vectors(table(spark, base, "evidence_spans"), table(spark, base, "risk_factors"))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return neighbours.close_pairs(neighbours.nearest(_vectors(spark, base), least=0.75))


def p4_neighbours(spark: SparkSession, base: str) -> DataFrame:
    return neighbours.similar_keys(neighbours.nearest(_vectors(spark, base), recall=0.9))


def _near_texts(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    texts = near_duplicates.evidence_texts(table(spark, base, "chunks"), table(spark, base, "risk_factors"))
    return near_duplicates.near_duplicates(texts, words=3, threshold=0.6)


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return near_duplicates.close_pairs(*_near_texts(spark, base))


def p5_groups(spark: SparkSession, base: str) -> DataFrame:
    return near_duplicates.duplicate_groups(*_near_texts(spark, base))


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    return survivors.field_survivors(table(spark, base, "xbrl_facts"), table(spark, base, "concept_map")).select("group_id", "field_name", "fact_id")


def p6_survivors(spark: SparkSession, base: str) -> DataFrame:
    return survivors.survivors(table(spark, base, "xbrl_facts"), table(spark, base, "concept_map"))


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    return budget.suspect_counts(table(spark, base, "chunks"))


def p7_chunk_totals(spark: SparkSession, base: str) -> DataFrame:
    groups = {"ticker": budget.tidy_ticker(F.col("ticker")), "form": budget.tidy_form(F.col("form")), "section_id": F.col("section_id")}
    return budget.totals(table(spark, base, "chunks"), key="chunk_id", groups=groups, stored=F.col("n_tokens"), latest=F.col("ingested_at"))


def p7_document_totals(spark: SparkSession, base: str) -> DataFrame:
    groups = {"source": budget.tidy_code(F.col("source")), "lang": budget.tidy_lang(F.col("lang")), "topic": F.col("topic")}
    return budget.totals(table(spark, base, "documents"), key="doc_id", groups=groups, latest=F.col("fetched_at"))


def p8_ids(spark: SparkSession, base: str) -> DataFrame:
    return encoding.encode(table(spark, base, "documents"))


def _mix(spark: SparkSession, base: str) -> mixing.Mix:
    return mixing.mix(table(spark, base, "documents"), table(spark, base, "mix_targets"))


def p9_mix(spark: SparkSession, base: str) -> DataFrame:
    return _mix(spark, base).documents


def p9_shares(spark: SparkSession, base: str) -> DataFrame:
    return _mix(spark, base).plan


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    return truncation.truncations(table(spark, base, "documents")).where("is_cut").select("doc_id")


def p10_sources(spark: SparkSession, base: str) -> DataFrame:
    return truncation.truncation_report(table(spark, base, "documents"))


QUERIES = {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()}
