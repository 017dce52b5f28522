"""Mixing sources to target shares of the tokens (problem 9).

Each document has a fixed 60-bit hash. Of a source that is to be used 1.4 times, every document is taken
once and those under a hash threshold once more. The threshold is found by histograms: tokens are summed
by source and the hash's first 12 bits, the bucket in which the budget runs out is looked up, and only
that bucket is split by the next 12 bits, and so on. Documents are then filtered by their hash; nothing
is sorted, and all copies of smaller budgets are among those of larger ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from evistrata.llm import bpe
from evistrata.llm.budget import tidy_code, token_count
from evistrata.session import materialize

BITS, LEVELS = 12, 5


def spot(key: Column) -> Column:
    """A document's place in its source: 60 bits of hash."""
    return F.xxhash64(key.cast("string"), F.lit("mix")).bitwiseAND(F.lit((1 << BITS * LEVELS) - 1))


class Mix:
    """Which documents are used how often, and the shares reached."""

    def __init__(self, documents: DataFrame, plan: DataFrame):
        self.documents, self.plan = documents, plan


def mix(
    documents: DataFrame,
    targets: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    total_tokens: int | None = None,
    vocabulary: str = bpe.VOCABULARY,
) -> Mix:
    """Mix ``documents`` to the ``target_share`` of each source in ``targets``, using none of them more
    than ``max_repeats`` times.

    ``total_tokens`` is the size of the wished mixture; by default all tokens that the sources of
    ``targets`` have. Shares are taken relative to their sum. A source too small for its share even when
    repeated is used ``max_repeats`` times whole, and its actual share stays below its target.

    ``Mix.documents``: doc_id, source, n_tokens, copies (1 or more). ``Mix.plan``: source, target_share,
    max_repeats, documents, available_tokens, wanted_tokens, used_documents, used_tokens, actual_share.
    ``used_tokens`` falls short of ``wanted_tokens`` by less than one document, if repeats allow.

    Defined cases: sources compare without case, blanks and separators; documents of other or no source
    are not used; a null or empty text has 0 tokens and rides along with its hash; a repeated key is one
    document, with its longest text; a source without documents has 0 tokens; a null or negative share or
    repeat count is 0; of repeated target rows the greatest values hold.
    """
    wished = targets.groupBy(tidy_code(F.col("source")).alias("__s")).agg(
        F.max(F.col("source")).alias("name"),
        F.greatest(F.max(F.coalesce("target_share", F.lit(0.0))), F.lit(0.0)).alias("target_share"),
        F.greatest(F.max(F.coalesce("max_repeats", F.lit(0))), F.lit(0)).alias("max_repeats"),
    ).where("__s IS NOT NULL")
    # One row per wished source, by its nature a short list; it is what a person writes down.
    wishes = {r["__s"]: r for r in wished.collect()}
    all_shares = sum(r["target_share"] for r in wishes.values()) or 1.0

    counted = (
        documents.where(F.col(key).isNotNull())
        .select(F.col(key).alias("doc_id"), tidy_code(F.col(source)).alias("source"), F.col(text).alias("text"))
        .where(F.col("source").isin(*wishes) if wishes else F.lit(False))
        .select("doc_id", "source", token_count(F.col("text"), vocabulary).alias("n_tokens"))
        .groupBy("doc_id")
        .agg(F.max(F.struct("n_tokens", "source")).alias("v"))
        .select("doc_id", "v.source", "v.n_tokens", spot(F.col("doc_id")).alias("spot"))
    )
    counted = materialize(counted)

    shift = BITS * (LEVELS - 1)
    histogram = counted.groupBy("source", F.shiftright("spot", shift).alias("bucket")).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n"))
    histogram = materialize(histogram)  # at most 4,096 rows a source
    have = {r["source"]: r for r in histogram.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("n").alias("n")).collect()}
    size = total_tokens if total_tokens is not None else sum(r["tokens"] for r in have.values())

    plan, rest = {}, {}
    for s, wish in wishes.items():
        available = have[s]["tokens"] if s in have else 0
        wanted = wish["target_share"] / all_shares * size
        whole = min(wish["max_repeats"], int(wanted // available)) if available else 0
        plan[s] = {"whole": whole, "below": 0, "wanted": wanted, "available": available}
        if available and whole < wish["max_repeats"]:
            rest[s] = wanted - whole * available

    # Level by level: the bucket in which the rest of the budget runs out, then its own histogram.
    low = dict.fromkeys(rest, 0)
    for level in range(LEVELS):
        if not rest:
            break
        shift = BITS * (LEVELS - 1 - level)
        if level:
            inside = None
            for s in rest:
                part = (F.col("source") == s) & (F.col("spot") >= low[s]) & (F.col("spot") < low[s] + (1 << (shift + BITS)))
                inside = part if inside is None else inside | part
            histogram = counted.where(inside).groupBy("source", F.shiftright("spot", shift).alias("bucket")).agg(F.sum("n_tokens").alias("tokens"))
        budget = F.lit(None).cast("double")
        for s, value in rest.items():
            budget = F.when(F.col("source") == s, F.lit(float(value))).otherwise(budget)
        upto = Window.partitionBy("source").orderBy("bucket")
        over = (
            histogram.where(F.col("source").isin(*rest))
            .select("source", "bucket", "tokens", F.sum("tokens").over(upto).alias("upto"))
            .where(F.col("upto") > budget)
            .groupBy("source")
            .agg(F.min(F.struct("bucket", "upto", "tokens")).alias("v"))
            .select("source", "v.*")
            .collect()
        )
        found = {r["source"]: r for r in over}
        for s in list(rest):
            if s not in found:  # the budget takes all of it
                low[s] += 1 << (shift + BITS)
                rest.pop(s)
            else:
                rest[s] -= found[s]["upto"] - found[s]["tokens"]
                low[s] = found[s]["bucket"] << shift
    for s, value in low.items():
        plan[s]["below"] = value

    whole, below = F.lit(0), F.lit(0).cast("long")
    for s, p in plan.items():
        whole = F.when(F.col("source") == s, F.lit(p["whole"])).otherwise(whole)
        below = F.when(F.col("source") == s, F.lit(p["below"]).cast("long")).otherwise(below)
    used = (
        counted.withColumn("copies", (whole + F.when(F.col("spot") < below, 1).otherwise(0)).cast("int"))
        .where("copies > 0")
        .select("doc_id", "source", "n_tokens", "copies")
    )
    spark = documents.sparkSession
    frame = spark.createDataFrame(
        [(s, w["name"], float(w["target_share"]), int(w["max_repeats"]), int(have[s]["n"]) if s in have else 0, int(plan[s]["available"]), float(plan[s]["wanted"])) for s, w in wishes.items()],
        "s string, name string, target_share double, max_repeats int, documents long, available_tokens long, wanted_tokens double",
    )
    sums = used.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("used_documents"), F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"), F.max("copies").alias("most_copies"))
    report = frame.join(sums, "s", "left").na.fill(0)
    all_used = F.sum("used_tokens").over(Window.partitionBy())
    report = report.select(
        F.col("name").alias("source"), "target_share", "max_repeats", "documents", "available_tokens", "wanted_tokens",
        "used_documents", "used_tokens", "most_copies",
        F.when(all_used > 0, F.col("used_tokens") / all_used).otherwise(0.0).alias("actual_share"),
    )
    return Mix(used, report)
