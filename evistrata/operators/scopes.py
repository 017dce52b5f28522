"""Which filings and chunks a run works on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from evistrata.functions.dates import any_date
from evistrata.functions.text import tidy_form, tidy_ticker

#: The section that holds the risks, by form.
RISK_SECTIONS = {"10-K": "I.1A", "10-Q": "II.1A", "20-F": "I.3"}
ANNUAL, QUARTERLY = ("10-K", "20-F"), ("10-Q",)


def chunk_scope(chunks: DataFrame, *, history: int = 1, risk_sections: dict[str, str] = RISK_SECTIONS) -> DataFrame:
    """Per ticker and annual form all chunks of the latest annual filing and the risk chunks of ``history``
    ones before it, and per ticker all chunks of the latest quarterly filing (greatest accession).

    Annual filings are ordered by filing date, then accession; forms, tickers and dates may be written in
    any notation. Chunks are given once, by ``chunk_id``. Ranks are computed on distinct filings, so windows
    never sort chunks.
    """
    chunks = chunks.withColumns({"form": tidy_form(F.col("form")), "ticker": tidy_ticker(F.col("ticker"))})
    filings = chunks.where(F.col("form").isin(*ANNUAL, *QUARTERLY)).groupBy("ticker", "form", "accession_no").agg(F.min(any_date(F.col("filing_date"))).alias("filed"))
    back = Window.partitionBy("ticker", "form").orderBy(F.desc("filed"), F.desc("accession_no"))
    annual = filings.where(F.col("form").isin(*ANNUAL)).withColumn("rank", F.row_number().over(back)).where(F.col("rank") <= 1 + history)
    latest = filings.where(F.col("form").isin(*QUARTERLY)).groupBy("ticker").agg(F.max("accession_no").alias("accession_no"))
    risk = F.lit(None).cast("string")
    for form, section in risk_sections.items():
        risk = F.when(F.col("form") == form, section).otherwise(risk)
    wanted = annual.select("ticker", "form", "accession_no", F.when(F.col("rank") > 1, risk).alias("only")).unionByName(
        latest.select("ticker", F.lit(QUARTERLY[0]).alias("form"), "accession_no", F.lit(None).cast("string").alias("only"))
    )
    found = chunks.join(wanted, ["ticker", "form", "accession_no"]).where("only IS NULL OR section_id = only").drop("only")
    return found.dropDuplicates(["chunk_id"])


#: Tokens that the prompt adds to a text, and that an answer takes.
PROMPT_TOKENS, ANSWER_TOKENS = 900, 700


def work_estimate(todo: DataFrame, group: str = "ticker", *, prompt_tokens: int = PROMPT_TOKENS, answer_tokens: int = ANSWER_TOKENS) -> DataFrame:
    """Rows, tokens and calls a model run would take, by group: each row adds a prompt to its tokens."""
    return todo.groupBy(group).agg(
        F.count("*").alias("n_chunks"),
        F.sum("n_tokens").alias("chunk_tokens"),
        (F.sum("n_tokens") + F.count("*") * F.lit(prompt_tokens)).alias("input_tokens"),
        (F.count("*") * F.lit(answer_tokens)).alias("output_tokens"),
    )
