"""The same graph operators on the larger trade tables: suppliers, customers and their orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evistrata.operators import graph, upserts
from evistrata.session import table


def _shipments(spark: SparkSession, base: str) -> DataFrame:
    """A supplier (negative key) supplies a customer by each line of an order."""
    lines = table(spark, base, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    orders = table(spark, base, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.to_date("o_orderdate").alias("date"))
    return lines.join(orders, "l_orderkey").select(
        (-F.col("l_suppkey") - 1).alias("src"), F.lit("SUPPLIES_TO").alias("rel"), F.col("o_custkey").alias("dst"), "date",
        F.col("l_orderkey").cast("string").alias("chunk_id"), F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("quote"),
    )


def trade_edges(spark: SparkSession, base: str) -> DataFrame:
    edges = upserts.accumulate_edges(_shipments(spark, base))
    return edges.select("src", "dst", "start_date", F.array_join("evidence_chunk_ids", ",").alias("ids"), F.col("evidence_quote").alias("quote"))


def _edges(spark: SparkSession, base: str) -> DataFrame:
    return _shipments(spark, base).select("src", "rel", "dst").distinct()


def trade_k_hop(spark: SparkSession, base: str) -> DataFrame:
    """How many edges lie within two hops of a customer, by supplier."""
    start = spark.createDataFrame([(1,)], "node long")
    return graph.k_hop_edges(_edges(spark, base), start, 2).groupBy("src").agg(F.count("*").alias("edges"))


def trade_distances(spark: SparkSession, base: str) -> DataFrame:
    start = spark.createDataFrame([(1,)], "node long")
    return graph.nodes_within(_edges(spark, base), start, 3).groupBy("distance").agg(F.count("*").alias("nodes"))


def trade_chain(spark: SparkSession, base: str) -> DataFrame:
    """Line to order to customer to nation to region, then revenue by region and year."""
    t = lambda n: table(spark, base, n)
    rows = (
        t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rows.groupBy(F.col("r_name").alias("region"), F.year("o_orderdate").alias("year")).agg(F.round(F.sum(revenue), 2).alias("revenue"), F.countDistinct("o_orderkey").alias("orders"))


def part_types(spark: SparkSession, base: str) -> DataFrame:
    """Parts that were shipped, with their price bounds by type and flag."""
    rows = table(spark, base, "part").join(table(spark, base, "lineitem").select("l_partkey", "l_returnflag").distinct(), F.col("p_partkey") == F.col("l_partkey"))
    return rows.groupBy("p_type", "l_returnflag").agg(F.count("*").alias("parts"), F.min("p_retailprice").alias("least"), F.max("p_retailprice").alias("most"))


_E = "e AS (SELECT DISTINCT -l_suppkey - 1 AS src, o_custkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
QUERIES = {f.__name__: f for f in (trade_edges, trade_k_hop, trade_distances, trade_chain, part_types)}
SQL = {
    "trade_edges": """WITH m AS (SELECT -l_suppkey - 1 AS src, o_custkey AS dst, o_orderdate::DATE AS date, l_orderkey::VARCHAR AS id, min(l_orderkey || ':' || l_linenumber) AS quote
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4)
      SELECT src, dst, min(date) AS start_date, string_agg(id, ',' ORDER BY date, id) AS ids, first(quote ORDER BY date, id, quote) AS quote FROM m GROUP BY 1, 2""",
    "trade_k_hop": f"WITH {_E}, near AS (SELECT 1::BIGINT AS n UNION SELECT src FROM e WHERE dst = 1) SELECT src, count(*) AS edges FROM e WHERE src IN (SELECT n FROM near) OR dst IN (SELECT n FROM near) GROUP BY 1",
    "trade_distances": f"""WITH {_E}, one AS (SELECT DISTINCT src AS n FROM e WHERE dst = 1), two AS (SELECT DISTINCT dst AS n FROM e WHERE src IN (SELECT n FROM one) AND dst <> 1),
      three AS (SELECT DISTINCT src AS n FROM e WHERE dst IN (SELECT n FROM two) AND src NOT IN (SELECT n FROM one))
      SELECT 0::INT AS distance, 1::BIGINT AS nodes UNION ALL SELECT 1, count(*) FROM one HAVING count(*) > 0 UNION ALL SELECT 2, count(*) FROM two HAVING count(*) > 0 UNION ALL SELECT 3, count(*) FROM three HAVING count(*) > 0""",
    "trade_chain": """SELECT r_name AS region, year(o_orderdate)::INT AS year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
    "part_types": """SELECT p_type, l_returnflag, count(*) AS parts, min(p_retailprice) AS least, max(p_retailprice) AS most FROM part
      JOIN (SELECT DISTINCT l_partkey, l_returnflag FROM lineitem) ON p_partkey = l_partkey GROUP BY 1, 2""",
}
