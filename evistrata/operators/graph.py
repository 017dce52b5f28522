"""Traversal of edge tables (src, rel, dst). Nodes of a frontier are deduplicated on every level, so the
work is bounded by nodes and edges, never by the number of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evistrata.session import materialize


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def stored(edges: DataFrame) -> DataFrame:
    """Edges that are read more than once: as they are if they are a table, else written as one."""
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    return edges if plan.startswith("Relation") else materialize(edges)


def nodes_within(edges: DataFrame, anchors: DataFrame, hops: int, *, directed: bool = False) -> DataFrame:
    """``node, distance`` of all nodes at most ``hops`` away from an anchor (column ``node``)."""
    steps = stored(edges).select("src", "dst")
    reached = materialize(anchors.select("node").distinct().withColumn("distance", F.lit(0)))
    for distance in range(1, hops + 1):
        # The frontier meets the edges from either end; the whole graph is neither doubled nor made distinct.
        frontier = reached.where(F.col("distance") == distance - 1).select("node")
        met = steps.join(frontier, steps["src"] == frontier["node"], "left_semi").select(F.col("dst").alias("node"))
        if not directed:
            met = met.union(steps.join(frontier, steps["dst"] == frontier["node"], "left_semi").select(F.col("src").alias("node")))
        met = met.distinct()
        fresh = met.join(reached, "node", "left_anti").withColumn("distance", F.lit(distance))
        reached = materialize(reached.unionByName(fresh))
    return reached


def k_hop_edges(edges: DataFrame, anchors: DataFrame, hops: int) -> DataFrame:
    """The distinct edges on undirected paths of at most ``hops`` edges from an anchor, each edge used at
    most once per path: exactly those with an end within ``hops`` - 1 of an anchor."""
    edges = stored(edges)
    near = nodes_within(edges, anchors, hops - 1).select("node") if hops > 1 else anchors.select("node").distinct()
    out = edges.join(near, edges["src"] == near["node"], "left_semi")
    into = edges.join(near, edges["dst"] == near["node"], "left_semi")
    return out.unionByName(into).distinct()


def reaching(edges: DataFrame, targets: DataFrame, hops: int) -> DataFrame:
    """``target, sources``: how many other nodes reach each target over directed paths of up to ``hops`` edges."""
    steps = materialize(stored(edges).select("src", "dst").distinct())
    pairs = targets.select(F.col("node").alias("target"), F.col("node").alias("at")).distinct()
    found = None
    frontier = pairs
    for _ in range(hops):
        met = frontier.join(steps, frontier["at"] == steps["dst"]).select("target", F.col("src").alias("at")).distinct()
        frontier = materialize(met if found is None else met.join(found, ["target", "at"], "left_anti"))
        found = frontier if found is None else found.unionByName(frontier)
    return pairs.select("target").join(
        found.where("at <> target").groupBy("target").agg(F.count("*").alias("sources")), "target", "left"
    ).na.fill(0, ["sources"])


def shortest_path(edges: DataFrame, start: Column | str, goals: DataFrame, hops: int = 6) -> DataFrame:
    """``path, length``: the shortest undirected path from a node to any goal; of equal ones the first in
    the order of its nodes. No row if there is none within ``hops`` edges.

    Breadth first: each newly met node keeps one path, the least of those that meet it first.
    """
    spark = edges.sparkSession
    steps = materialize(_both_ways(edges.where("src <> dst")))
    begin = start if isinstance(start, Column) else F.lit(start)
    level = materialize(spark.range(1).select(begin.alias("node"), F.array(begin).alias("path")))
    seen = level.select("node")
    for distance in range(hops + 1):
        hit = level.join(goals.select("node").distinct(), "node", "left_semi").orderBy("path").limit(1)
        hit = materialize(hit.select("path", F.lit(distance).alias("length")))
        if hit.head(1):
            return hit
        met = level.join(steps, level["node"] == steps["src"]).select("dst", F.concat("path", F.array("dst")).alias("path"))
        fresh = met.join(seen.withColumnRenamed("node", "dst"), "dst", "left_anti").groupBy("dst").agg(F.min("path").alias("path"))
        level = materialize(fresh.select(F.col("dst").alias("node"), "path"))
        seen = seen.union(level.select("node"))
    return level.select("path", F.lit(0).alias("length")).limit(0)


def neighbourhood(edges: DataFrame, node, evidence: DataFrame, *, ids: str = "evidence_chunk_ids") -> DataFrame:
    """The edges at a node, one row per evidence id found in ``evidence`` (chunk_id, text)."""
    around = edges.where((F.col("src") == F.lit(node)) | (F.col("dst") == F.lit(node)))
    return around.select("src", "rel", "dst", F.explode(ids).alias("chunk_id")).join(evidence.select("chunk_id", "text"), "chunk_id")


def labelled(edges: DataFrame, nodes: DataFrame, *, key: str, name: Column | str) -> DataFrame:
    """Edges with the names of both ends, in their stored direction; an end without a name keeps its edge."""
    label = name if isinstance(name, Column) else F.col(name)
    of = lambda side: nodes.select(F.col(key).alias(side), label.alias(f"{side}_name"))
    return edges.join(of("src"), "src", "left").join(of("dst"), "dst", "left")
