"""Hybrid retrieval over the graph tables, context assembly, and citation checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from evistrata.functions.text import citations, grouped_usd
from evistrata.operators import facts, graph, temporal
from evistrata.operators.vector_search import scoped_top_k, top_k

EXCERPTS, NEAR_EXCERPTS, NEAR_RISKS, RISKS, METRICS, DROPPED = 8, 60, 40, 6, 20, 10
#: The headers of a context, in order; ``lines`` has the fixed form of their lines.
BLOCKS = ("RELATIONSHIPS", "METRICS", "ACTIVE RISKS", "DROPPED RISK LINEAGES", "EXCERPTS")


@dataclass
class Graph:
    """The tables that retrieval reads.

    companies (cik, name), edges (src, rel, dst, status, evidence_quote, evidence_chunk_ids), metrics
    (cik, metric, unit, val, period_start, period_end), risks (risk_id, cik, summary, category, chunk_id,
    embedding), states (risk_id, cik, lineage_id, first_seen, last_seen, status, summary), spans
    (chunk_id, text, source_url, embedding), mentions (chunk_id, entity_id).
    """

    companies: DataFrame
    edges: DataFrame
    metrics: DataFrame
    risks: DataFrame
    states: DataFrame
    spans: DataFrame
    mentions: DataFrame


def hybrid(graph_: Graph, anchors: Sequence[int], query: Sequence[float], *, hops: int = 2, k: int = EXCERPTS) -> dict[str, DataFrame]:
    """Five lazy layers around the anchors: relations, metrics, active risks, dropped lineages, excerpts."""
    spark = graph_.edges.sparkSession
    names = graph_.companies.select("cik", F.col("name").alias("company"))
    start = spark.createDataFrame([(a,) for a in anchors], "node long")
    edges = graph.labelled(graph.k_hop_edges(graph_.edges, start, hops), graph_.companies, key="cik", name="name").select(
        F.col("src_name").alias("source"), F.col("rel").alias("relation"), F.col("dst_name").alias("target"), "status", F.col("evidence_quote").alias("quote"), F.col("evidence_chunk_ids").alias("chunk_ids")
    ).distinct()
    metrics = facts.metric_lookup(graph_.metrics, list(anchors), METRICS).join(names, "cik").select("company", "metric", "val", "unit", "period_start", "period_end")
    mine = graph_.states.where((F.col("status") == "Active") & F.col("cik").isin(*anchors)).select("risk_id").distinct()
    risks = scoped_top_k(graph_.risks, query, key="risk_id", first=NEAR_RISKS, scope=mine, k=RISKS).join(names, "cik").select("company", "category", "summary", "chunk_id", "score")
    dropped = temporal.dropped(graph_.states.where(F.col("cik").isin(*anchors)), limit=DROPPED).join(names, "cik").select("company", F.col("lineage_id").alias("lineage"), "first_seen", "last_seen", "example")
    named = graph_.mentions.where(F.col("entity_id").isin(*anchors)).select("chunk_id").distinct()
    excerpts = scoped_top_k(graph_.spans, query, key="chunk_id", first=NEAR_EXCERPTS, scope=named, k=k).select("chunk_id", "score", "text", "source_url")
    return {"edges": edges, "metrics": metrics, "risks": risks, "temporal": dropped, "chunks": excerpts}


def vector_only(spans: DataFrame, query: Sequence[float], k: int = EXCERPTS) -> DataFrame:
    return top_k(spans, query, k, key="chunk_id").select("chunk_id", "score", "text", "source_url")


def lines(layers: dict[str, DataFrame]) -> DataFrame:
    """Every line of the context with its block, order and citable ids: ``block, position, line, ids``.

    Fixed values: the wording of the lines.
    """
    empty = F.array().cast("array<string>")
    cite = lambda ids: F.array_join(F.transform(ids, lambda i: F.concat(F.lit("["), i, F.lit("]"))), " ")

    def block(name: str, df: DataFrame, line: Column, ids: Column, *order: Column) -> DataFrame:
        rank = F.struct(*order)
        return df.select(F.lit(name).alias("block"), F.to_json(rank).alias("position"), line.alias("line"), ids.alias("ids"))

    e, m, r, t, c = (layers[n] for n in ("edges", "metrics", "risks", "temporal", "chunks"))
    found = F.coalesce("chunk_ids", empty)
    text = lambda *parts: F.concat(*[F.lit(p) if i % 2 == 0 else F.coalesce(F.col(p).cast("string"), F.lit("None")) for i, p in enumerate(parts)])
    out = block("RELATIONSHIPS", e, F.concat(text("- ", "source", " ", "relation", " ", "target", " (status=", "status", ") "), cite(F.slice(found, 1, 3))), found, F.col("source"), F.col("relation"), F.col("target"))
    amount = grouped_usd(F.col("val"))
    out = out.unionByName(block("METRICS", m, F.concat(text("- ", "company", " ", "metric", " for period ", "period_start", "..", "period_end", ": "), amount), empty, (-F.datediff("period_end", F.lit("1970-01-01"))).alias("d"), F.col("company"), F.col("metric")))
    out = out.unionByName(block("ACTIVE RISKS", r, text("- ", "company", " (", "category", "): ", "summary", " [", "chunk_id", "]"), F.array("chunk_id"), (1 - F.col("score")).alias("s"), F.col("chunk_id")))
    example = F.substring("example", 1, 120)
    out = out.unionByName(block("DROPPED RISK LINEAGES", t, F.concat(text("- ", "company", ": disclosed ", "first_seen", " through ", "last_seen", ", then dropped — e.g. "), example), empty, (-F.datediff("last_seen", F.lit("1970-01-01"))).alias("d"), F.col("company"), F.col("lineage")))
    return out.unionByName(block("EXCERPTS", c, text("[", "chunk_id", "]\n", "text", "\n"), F.array("chunk_id"), (1 - F.col("score")).alias("s"), F.col("chunk_id")))


def context(layers: dict[str, DataFrame]) -> tuple[str, set[str]]:
    """The context of an answer, five blocks with "(none)" where a block is empty, and the citable ids.

    The layers are top-k results and one neighbourhood: what a prompt can hold, so it is collected.
    """
    rows = lines(layers).orderBy("block", "position", "line").collect()
    parts, ids = {name: [] for name in BLOCKS}, set()
    for row in rows:
        parts[row["block"]].append(row["line"])
        ids.update(row["ids"])
    return "\n\n".join(f"{name}:\n" + ("\n".join(parts[name]) or "(none)") for name in BLOCKS), ids


def cited(answers: DataFrame, *, text: str = "answer", valid: str = "valid_ids") -> DataFrame:
    """Answers with the ids they cite and those among them that they were not given."""
    ids = citations(F.col(text))
    return answers.withColumn("cited", ids).withColumn("hallucinated", F.array_except(ids, F.coalesce(F.col(valid), F.array().cast("array<string>"))))


@dataclass
class Answer:
    text: str
    cited: list[str]
    hallucinated: list[str]
    context: str


def answer(question: str, layers: dict[str, DataFrame], model: Callable[[str], str], prompt: str = "{context}\n\nQuestion: {question}") -> Answer:
    """Ask a model over the retrieved context and check its citations."""
    import re

    from evistrata.functions.text import CITATION

    text_, valid = context(layers)
    said = model(prompt.format(context=text_, question=question))
    ids = list(dict.fromkeys(re.findall(CITATION, said)))
    return Answer(said, ids, [i for i in ids if i not in valid], text_)


def answer_events(question: str, layers: dict[str, DataFrame], stream: Callable[[str], Iterator[str]], prompt: str = "{context}\n\nQuestion: {question}") -> Iterator[dict]:
    """The same as a stream of events: retrieval, any number of deltas, then done, or error."""
    import re

    from evistrata.functions.text import CITATION

    try:
        text_, valid = context(layers)
        yield {"event": "retrieval", "citable": len(valid)}
        said = ""
        for part in stream(prompt.format(context=text_, question=question)):
            said += part
            yield {"event": "delta", "text": part}
        ids = list(dict.fromkeys(re.findall(CITATION, said)))
        yield {"event": "done", "answer": said, "cited": ids, "hallucinated": [i for i in ids if i not in valid]}
    except Exception as problem:  # noqa: BLE001
        yield {"event": "error", "message": str(problem)}
