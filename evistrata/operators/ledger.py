"""The service ledger and answer cache as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def ledger_summary(ledger: DataFrame, today: Column) -> DataFrame:
    """Paid and cached queries and their cost, of today and of all time, in one pass: ``scope, paid, cached, cost_usd``."""
    cached = F.coalesce("cached", F.lit(False))
    cost = F.coalesce("cost_usd", F.lit(0.0))
    scopes = F.explode(F.when(F.col("day") == today, F.array(F.lit("all_time"), F.lit("today"))).otherwise(F.array(F.lit("all_time"))))
    rows = ledger.select(scopes.alias("scope"), cached.alias("c"), cost.alias("cost"))
    sums = rows.groupBy("scope").agg(F.count_if(~F.col("c")).alias("paid"), F.count_if("c").alias("cached"), F.bround(F.sum("cost"), 4).alias("cost_usd"))
    frame = ledger.sparkSession.createDataFrame([("today",), ("all_time",)], "scope string")
    return frame.join(sums, "scope", "left").na.fill(0)


def paid_on(ledger: DataFrame, day: Column) -> DataFrame:
    return ledger.where((F.col("day") == day) & ~F.col("cached")).agg(F.count("*").alias("n"))


def cached_answers(answers: DataFrame, now: Column, ttl_hours: int) -> DataFrame:
    """Answers still valid: curated ones for ever, others for ``ttl_hours``."""
    return answers.where((F.col("source") == "benchmark") | (F.col("created_at") > now - F.expr(f"INTERVAL {int(ttl_hours)} HOURS")))


def answer_lookup(questions: DataFrame, answers: DataFrame, now: Column, ttl_hours: int, *, key: str = "key") -> DataFrame:
    """Questions with their cached answer, if there is a valid one."""
    valid = cached_answers(answers, now, ttl_hours)
    return questions.join(valid.select(key, "answer", F.lit(True).alias("hit")), key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def policy_value(policies: DataFrame, key: str) -> DataFrame:
    return policies.where(F.col("key") == key).select("value")


def with_policy(policies: DataFrame, key: str, value: str, now: Column) -> DataFrame:
    """The policy table with one value set, last write wins."""
    from evistrata.operators.upserts import upsert_last

    change = policies.sparkSession.createDataFrame([(key, value)], "key string, value string").withColumn("updated_at", now)
    return upsert_last(policies, change, ["key"])


def acceptable_question(question: Column, least: int = 8, most: int = 400) -> Column:
    """The question with single blanks, or null if it is too short or too long."""
    from evistrata.functions.text import squeezed

    plain = squeezed(F.coalesce(question, F.lit("")))
    return F.when(F.length(plain).between(least, most), plain)


class Remembered:
    """A value computed at most once per ``seconds``, such as the counts behind a status page."""

    def __init__(self, compute, seconds: float = 30.0, clock=None):
        import time

        self.compute, self.seconds, self.clock = compute, seconds, clock or time.monotonic
        self.at, self.value = None, None

    def get(self):
        now = self.clock()
        if self.at is None or now - self.at > self.seconds:
            self.at, self.value = now, self.compute()
        return self.value
