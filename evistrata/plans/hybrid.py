"""The flagship: hybrid retrieval for a question, as one table of context lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evistrata.operators import mentions, retrieval
from evistrata.plans import knowledge, lake, risks
from evistrata.session import materialize, table

ANCHORS = [-132, 5_000_001]


def _spans(spark: SparkSession, base: str) -> DataFrame:
    spans = table(spark, base, "evidence_spans").where("size(embedding) = 128").groupBy("chunk_id").agg(F.max(F.struct("encoded_at", "embedding")).alias("v"))
    texts = lake.chunks_once(spark, base).select("chunk_id", "text", "source_url")
    return spans.select("chunk_id", F.col("v.embedding").alias("embedding")).join(texts, "chunk_id")


def graph_tables(spark: SparkSession, base: str, anchors: list[int]) -> retrieval.Graph:
    """The tables of retrieval; texts are searched for the anchors' names only."""
    entities, texts = table(spark, base, "canonical_entities").where(F.col("entity_id").isin(*anchors)), lake.chunks_once(spark, base)
    annual = risks.annual_risks(spark, base)
    return retrieval.Graph(
        companies=knowledge.companies(spark, base),
        # Read by several layers: computed once.
        edges=materialize(knowledge.resolved_graph(spark, base)),
        metrics=lake._metrics(spark, base),
        risks=annual.select("risk_id", "cik", "summary", "category", "chunk_id", "embedding"),
        states=materialize(risks._states(spark, base)),
        spans=_spans(spark, base),
        mentions=mentions.mentioned(texts, entities),
    )


def _query(spark: SparkSession, base: str) -> list[float]:
    rows = table(spark, base, "evidence_spans").where("size(embedding) = 128").orderBy("chunk_id", "encoded_at")
    return list(rows.select("embedding").head()[0])


def _layers(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    return retrieval.hybrid(graph_tables(spark, base, ANCHORS), ANCHORS, _query(spark, base))


def hybrid_retrieve(spark: SparkSession, base: str) -> DataFrame:
    return retrieval.lines(_layers(spark, base)).select("block", "position", "line", F.size("ids").alias("n_ids"))


def retrieval_counts(spark: SparkSession, base: str) -> DataFrame:
    """Side by side: lines per layer of hybrid retrieval, and of vectors alone."""
    layers = _layers(spark, base)
    lines = retrieval.lines(layers).groupBy("block").agg(F.count("*").alias("n"))
    alone = retrieval.vector_only(_spans(spark, base), _query(spark, base)).agg(F.count("*").alias("n"))
    return lines.union(alone.select(F.lit("VECTOR ONLY").alias("block"), "n"))


def vector_excerpts(spark: SparkSession, base: str) -> DataFrame:
    found = retrieval.vector_only(_spans(spark, base), _query(spark, base))
    return found.select("chunk_id", F.round("score", 6).alias("score"))


_DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
_LEN = "sqrt(list_sum(list_transform({0}.embedding, lambda x: x::DOUBLE * x::DOUBLE)))"
QUERIES = {f.__name__: f for f in (hybrid_retrieve, retrieval_counts, vector_excerpts)}
SQL = {
    "vector_excerpts": f"""WITH u AS (SELECT * FROM evidence_spans WHERE len(embedding) = 128), a AS (SELECT chunk_id, embedding FROM u QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY encoded_at DESC NULLS LAST) = 1),
      b AS (SELECT embedding FROM u ORDER BY chunk_id, encoded_at LIMIT 1)
      SELECT a.chunk_id, round({_DOT} / ({_LEN.format('a')} * {_LEN.format('b')}), 6) AS score FROM a, b WHERE a.chunk_id IN (SELECT chunk_id FROM chunks) AND {_LEN.format('a')} > 0
      ORDER BY {_DOT} / ({_LEN.format('a')} * {_LEN.format('b')}) DESC, a.chunk_id LIMIT 8""",
}
