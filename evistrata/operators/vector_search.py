"""Exact top-k by cosine, and the search layers of retrieval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from evistrata.functions.vectors import cosine


def top_k(items: DataFrame, query: Sequence[float], k: int, *, key: str, vector: str = "embedding") -> DataFrame:
    """The ``k`` items most similar to a query vector, with ``score``; ties by key.

    The query is a literal, so scoring is part of the scan, and only k rows of each task are ranked. Items
    without a vector of the query's length, or of length zero, are left out.
    """
    wanted = F.array(*[F.lit(float(x)) for x in query])
    scored = items.withColumn("score", cosine(F.col(vector), wanted)).where(F.col("score").isNotNull() & ~F.isnan("score"))
    return scored.orderBy(F.desc("score"), key).limit(k)


def top_k_each(items: DataFrame, queries: DataFrame, k: int, *, key: str, query_key: str, vector: str = "embedding", block_bytes: int = 64 << 20) -> DataFrame:
    """Top-k of every query of a stated set against all items.

    The queries are shipped in blocks of at most about ``block_bytes``, each of which meets every item once;
    every task keeps its k best per query before anything is shuffled.
    """
    size = queries.agg(F.coalesce(F.sum(F.size(vector).cast("long") * 8 + 64), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // block_bytes))
    block = F.pmod(F.xxhash64(query_key), F.lit(blocks))
    out = None
    for i in range(blocks):
        asked = F.broadcast(queries.where(block == i).select(query_key, F.col(vector).alias("__q")))
        scored = items.join(asked, F.size(vector) == F.size("__q")).withColumn("score", cosine(F.col(vector), F.col("__q"))).drop("__q", vector)
        best = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
        found = scored.where("score IS NOT NULL").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        out = found if out is None else out.unionByName(found)
    return out


def scoped_top_k(items: DataFrame, query: Sequence[float], *, key: str, first: int, scope: DataFrame, k: int, vector: str = "embedding") -> DataFrame:
    """The ``first`` nearest items, of which those in ``scope`` remain, the best ``k`` of them.

    The scope applies after the nearest are taken, so fewer than k rows may come out.
    """
    near = top_k(items, query, first, key=key, vector=vector)
    return near.join(scope, key).orderBy(F.desc("score"), key).limit(k)
