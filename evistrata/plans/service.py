"""Queries over the ledger, the answer cache and limits; the supplied event log stands for the service's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evistrata.functions.text import question_key
from evistrata.operators import ledger, limits
from evistrata.session import table
from evistrata.streaming.limits import windowed_values

TODAY, NOW, TTL_HOURS = "2024-01-15", "2024-01-15 12:00:00", 72


def _ledger(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "events").select(
        F.col("event_id").cast("string").alias("id"), F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts", "user_id",
        (F.col("event_type") == "view").alias("cached"), F.when(F.col("event_type") != "view", F.round(F.col("value") / 1000, 4)).alias("cost_usd"),
    )


def ledger_summary(spark: SparkSession, base: str) -> DataFrame:
    return ledger.ledger_summary(_ledger(spark, base), F.lit(TODAY)).select("scope", "paid", "cached", F.round("cost_usd", 2).alias("cost_usd"))


def paid_today(spark: SparkSession, base: str) -> DataFrame:
    return ledger.paid_on(_ledger(spark, base), F.lit(TODAY))


def daily_ceiling(spark: SparkSession, base: str) -> DataFrame:
    rows = limits.daily_ceiling(table(spark, base, "events"), at="ts", counts=F.col("event_type") != "view", most=200, order="event_id")
    return rows.groupBy("day").agg(F.max("used").alias("used"), F.count_if(~F.col("within")).alias("over"))


def _answers(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "events").where("event_type IN ('click', 'signup')")
    return rows.select(
        question_key(F.concat(F.lit("question "), F.col("user_id").cast("string")), F.lit("hybrid")).alias("key"), F.col("props").alias("answer"), F.col("ts").alias("created_at"), "event_id",
        F.when(F.col("event_type") == "signup", "benchmark").otherwise("live").alias("source"),
    )


def cache_lookup_ttl(spark: SparkSession, base: str) -> DataFrame:
    """Which users' questions have a valid answer."""
    from evistrata.operators.upserts import last_per_key

    answers = last_per_key(_answers(spark, base), ["key"], [F.col("created_at"), F.col("event_id")])
    users = table(spark, base, "events").select("user_id").distinct()
    asked = users.select("user_id", question_key(F.concat(F.lit("  Question "), F.col("user_id").cast("string"), F.lit("?! ")), F.lit("hybrid")).alias("key"))
    return ledger.answer_lookup(asked, answers, F.lit(NOW).cast("timestamp_ntz"), TTL_HOURS).select("user_id", "answer", "hit")


def rate_limit(spark: SparkSession, base: str) -> DataFrame:
    rows = limits.rate_limited(table(spark, base, "events").select("event_id", "ts", "user_id"), key="user_id", at="ts", most=5, window_seconds=86_400, order="event_id")
    return rows.select("event_id", "user_id", "allowed")


def rate_limit_named(spark: SparkSession, base: str) -> DataFrame:
    """The limits by name, each over the events of a type: what each accepts and rejects."""
    rows = None
    for name, (most, seconds) in limits.LIMITS.items():
        found = limits.rate_limited(table(spark, base, "events").select("event_id", "ts", "event_type"), key="event_type", at="ts", most=most, window_seconds=seconds, order="event_id")
        found = found.groupBy("event_type").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("rejected")).withColumn("name", F.lit(name))
        rows = found if rows is None else rows.unionByName(found)
    return rows


def hourly_values(spark: SparkSession, base: str) -> DataFrame:
    found = windowed_values(table(spark, base, "events"), at="ts", by="event_type", value="value", size="6 hours")
    return found.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def event_props(spark: SparkSession, base: str) -> DataFrame:
    """A JSON field as columns."""
    rows = table(spark, base, "events").select("event_type", F.from_json("props", "k int").alias("p"))
    return rows.groupBy("event_type").agg(F.sum("p.k").alias("k"), F.count("p.k").alias("n"))


_LEDGER = "ledger AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, event_type = 'view' AS cached, CASE WHEN event_type <> 'view' THEN round(value / 1000, 4) END AS cost FROM events)"


def _limited_sql(key: str, most: int, seconds: int) -> str:
    """Decisions event by event: with each key goes the list of the times accepted within the window."""
    return f"""e AS (SELECT event_id, {key} AS k, epoch_us(ts) AS s, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS rn FROM events WHERE {key} IS NOT NULL AND ts IS NOT NULL),
  w AS (SELECT event_id, k, rn, true AS allowed, [s] AS held FROM e WHERE rn = 1 UNION ALL
    SELECT event_id, k, rn, len(near) < {most} AS allowed, CASE WHEN len(near) < {most} THEN list_append(near, s) ELSE near END AS held
    FROM (SELECT e.event_id, e.k, e.rn, e.s, list_filter(w.held, lambda x: e.s - x <= {seconds * 1_000_000}) AS near FROM w JOIN e ON e.k = w.k AND e.rn = w.rn + 1))"""


_KEY = "left(sha256('hybrid|question ' || user_id), 32)"
QUERIES = {f.__name__: f for f in (ledger_summary, paid_today, daily_ceiling, cache_lookup_ttl, rate_limit, rate_limit_named, hourly_values, event_props)}
SQL = {
    "ledger_summary": f"""WITH {_LEDGER} SELECT 'all_time' AS scope, count(*) FILTER (NOT cached) AS paid, count(*) FILTER (cached) AS cached, round(sum(coalesce(cost, 0)), 2) AS cost_usd FROM ledger
      UNION ALL SELECT 'today', count(*) FILTER (NOT cached), count(*) FILTER (cached), round(sum(coalesce(cost, 0)), 2) FROM ledger WHERE day = '{TODAY}'""",
    "paid_today": f"WITH {_LEDGER} SELECT count(*) AS n FROM ledger WHERE day = '{TODAY}' AND NOT cached",
    "daily_ceiling": """WITH u AS (SELECT ts::DATE AS day, event_type <> 'view' AS c, count(*) FILTER (event_type <> 'view') OVER (PARTITION BY ts::DATE ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS used FROM events)
      SELECT day, max(used) AS used, count(*) FILTER (c AND used > 200) AS over FROM u GROUP BY 1""",
    "cache_lookup_ttl": f"""WITH a AS (SELECT {_KEY} AS key, props AS answer, ts, event_type = 'signup' AS curated FROM events WHERE event_type IN ('click', 'signup')
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
      v AS (SELECT * FROM a WHERE curated OR ts > TIMESTAMP '{NOW}' - INTERVAL {TTL_HOURS} HOURS)
      SELECT user_id, v.answer, v.key IS NOT NULL AS hit FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN v ON {_KEY} = v.key""",
    "rate_limit": f"WITH RECURSIVE {_limited_sql('user_id', 5, 86_400)} SELECT event_id, k AS user_id, allowed FROM w",
    "rate_limit_named": " UNION ALL ".join(
        f"SELECT * FROM (WITH RECURSIVE {_limited_sql('event_type', most, seconds)} SELECT k AS event_type, count(*) FILTER (allowed) AS allowed, count(*) FILTER (NOT allowed) AS rejected, '{name}' AS name FROM w GROUP BY 1)"
        for name, (most, seconds) in limits.LIMITS.items()
    ),
    "hourly_values": "SELECT strftime(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "event_props": "SELECT event_type, sum((props->>'k')::INT)::BIGINT AS k, count((props->>'k')::INT) AS n FROM events GROUP BY 1",
}
