"""Queries over the lake: facts, filings, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from evistrata.functions.dates import any_date
from evistrata.functions.text import tidy_form, tidy_ticker
from evistrata.functions.vectors import norm
from evistrata.operators import facts, scopes, upserts
from evistrata.session import table
from evistrata.sources import files

ANCHORS = [5_000_001, 5_000_008, 6_000_003]


def any_date_sql(x: str) -> str:
    x = f"trim({x})"
    return (
        f"CASE WHEN regexp_matches({x}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast(substr({x}, 1, 10) AS DATE) "
        f"WHEN regexp_full_match({x}, '\\d{{8}}') THEN CAST(try_strptime({x}, '%Y%m%d') AS DATE) "
        f"WHEN regexp_full_match({x}, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') THEN CAST(try_strptime({x}, '%m/%d/%Y') AS DATE) "
        f"WHEN regexp_full_match({x}, '[A-Za-z]{{3}} \\d{{1,2}}, \\d{{4}}') THEN CAST(try_strptime({x}, '%b %d, %Y') AS DATE) END"
    )


def tidy_form_sql(x: str) -> str:
    return f"nullif(regexp_replace(regexp_replace(upper(trim({x})), '^FORM\\s+', ''), '^(\\d+)[\\s-]*([A-Z]+)', '\\1-\\2'), '')"


def tidy_ticker_sql(x: str) -> str:
    return f"nullif(upper(trim({x})), '')"


def tidy_code_sql(x: str) -> str:
    return f"nullif(regexp_replace(lower(trim(regexp_replace({x}, '[\\s\\x{{00A0}}\\x{{2000}}-\\x{{200A}}\\x{{3000}}]+', ' ', 'g'))), '[\\s_-]+', '_', 'g'), '')"


def chunks_once(spark: SparkSession, base: str) -> DataFrame:
    """Chunks without repeated deliveries: the first by time of ingestion."""
    return upserts.last_per_key(table(spark, base, "chunks").withColumn("__t", -F.unix_micros(F.col("ingested_at").cast("timestamp"))), ["chunk_id"], [F.col("__t"), F.col("n_tokens")]).drop("__t")


CHUNKS = "chunks_once AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at NULLS LAST, n_tokens DESC NULLS LAST) = 1)"


def _metrics(spark: SparkSession, base: str) -> DataFrame:
    return facts.curated_metrics(table(spark, base, "xbrl_facts"), table(spark, base, "concept_map"))


METRICS = f"""metrics AS (
  SELECT cik, metric, concept, period_start, period_end, val, unit,
    first_value(accn IGNORE NULLS) OVER (PARTITION BY cik, metric, period_end, unit ORDER BY filed NULLS LAST, accn NULLS LAST, concept, val, ticker NULLS FIRST, period_start
      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS accn, filed FROM (
    SELECT cik, ticker, metric, f.concept, {any_date_sql('period_start')} AS period_start, {any_date_sql('period_end')} AS period_end, val,
      upper(trim(unit)) AS unit, accn, {any_date_sql('filed')} AS filed
    FROM xbrl_facts f JOIN concept_map m ON f.concept = m.concept WHERE form IN ('10-K', '20-F') AND val IS NOT NULL) facts
  WHERE datediff('day', period_start, period_end) > 300
  QUALIFY row_number() OVER (PARTITION BY cik, metric, period_end, unit ORDER BY filed NULLS LAST, facts.accn NULLS LAST, concept, val, ticker NULLS FIRST, period_start) = 1)"""


def metric_first_disclosure(spark: SparkSession, base: str) -> DataFrame:
    return _metrics(spark, base).select("cik", "metric", "concept", "period_start", "period_end", "val", "unit", "accn", "filed")


def metric_lookup_topk(spark: SparkSession, base: str) -> DataFrame:
    return facts.metric_lookup(_metrics(spark, base), ANCHORS).select("cik", "metric", "unit", "val", "period_start", "period_end")


def metric_growth(spark: SparkSession, base: str) -> DataFrame:
    """Change of each metric against the period before."""
    before = Window.partitionBy("cik", "metric", "unit").orderBy("period_end")
    rows = _metrics(spark, base).withColumn("previous", F.lag("val").over(before))
    return rows.select("cik", "metric", "unit", "period_end", "val", "previous", F.when(F.col("previous") != 0, F.col("val") / F.col("previous") - 1).alias("change"))


def filing_scope(spark: SparkSession, base: str) -> DataFrame:
    return scopes.chunk_scope(chunks_once(spark, base)).select("chunk_id", "ticker", "form", "accession_no", "section_id")


SCOPE = f"""WITH {CHUNKS},
tidy AS (SELECT * REPLACE ({tidy_form_sql('form')} AS form, {tidy_ticker_sql('ticker')} AS ticker, {any_date_sql('filing_date')} AS filing_date) FROM chunks_once),
filed AS (SELECT ticker, form, accession_no, min(filing_date) AS filed FROM tidy WHERE form IN ('10-K', '20-F', '10-Q') GROUP BY 1, 2, 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY ticker, form ORDER BY filed DESC NULLS LAST, accession_no DESC) AS r FROM filed WHERE form <> '10-Q'),
wanted AS (
  SELECT ticker, form, accession_no, CASE WHEN r > 1 THEN CASE form WHEN '10-K' THEN 'I.1A' ELSE 'I.3' END END AS only_section FROM ranked WHERE r <= 2
  UNION ALL SELECT ticker, '10-Q', max(accession_no), NULL FROM filed WHERE form = '10-Q' GROUP BY ticker),
scope AS (SELECT c.* FROM tidy c JOIN wanted w ON c.ticker = w.ticker AND c.form = w.form AND c.accession_no = w.accession_no
  WHERE only_section IS NULL OR section_id = only_section)"""


def cost_estimate(spark: SparkSession, base: str) -> DataFrame:
    done = table(spark, base, "extractions")
    return scopes.work_estimate(files.pending(scopes.chunk_scope(chunks_once(spark, base)), done, "chunk_id"))


def extraction_resume(spark: SparkSession, base: str) -> DataFrame:
    return files.pending(chunks_once(spark, base), table(spark, base, "extractions"), "chunk_id").select("chunk_id", "ticker")


def filings_selected(spark: SparkSession, base: str) -> DataFrame:
    filings = table(spark, base, "filings").withColumn("filing_date", any_date(F.col("filing_date"))).where("ticker IS NOT NULL")
    once = upserts.last_per_key(filings, ["accession_no"], [F.col("fetched_at"), F.col("size_bytes")])
    return files.select_filings(once, annual_since=2018).select("accession_no", "ticker", "form", "filing_date")


def filing_last_write(spark: SparkSession, base: str) -> DataFrame:
    """Upsert of filings, later fetches over earlier ones."""
    rows = table(spark, base, "filings").where("accession_no IS NOT NULL")
    late = F.col("fetched_at") >= F.lit("2025-01-02").cast("timestamp_ntz")
    return upserts.upsert_last(rows.where(~late | F.col("fetched_at").isNull()), rows.where(late), ["accession_no"], [F.col("fetched_at"), F.col("size_bytes"), F.col("form")]).select("accession_no", "ticker", "form", "size_bytes")


def filing_first_write(spark: SparkSession, base: str) -> DataFrame:
    """Filings of two runs: what the first wrote stays, whatever the second brings for it."""
    rows = table(spark, base, "filings").where("accession_no IS NOT NULL").select("accession_no", "ticker", "form", "size_bytes", "fetched_at")
    order = [F.col("fetched_at"), F.col("size_bytes"), F.col("form"), F.col("ticker")]
    early = F.coalesce(F.col("fetched_at") < F.lit("2025-01-02").cast("timestamp_ntz"), F.lit(False))
    old = upserts.insert_new(rows.limit(0), rows.where(early), ["accession_no"], order)
    return upserts.insert_new(old, rows.where(~early), ["accession_no"], order).select("accession_no", "ticker", "form", "size_bytes")


def ticker_ciks(spark: SparkSession, base: str) -> DataFrame:
    """The lookup from ticker to company number: the one of the latest filing."""
    rows = table(spark, base, "filings").select(tidy_ticker(F.col("ticker")).alias("ticker"), "cik", any_date(F.col("filing_date")).alias("day"), "accession_no").where("ticker IS NOT NULL AND cik IS NOT NULL")
    return upserts.last_per_key(rows, ["ticker"], [F.col("day"), F.col("accession_no"), F.col("cik")]).select("ticker", "cik")


def ticker_filled(spark: SparkSession, base: str) -> DataFrame:
    """Missing tickers of filings filled from their chunks, first value wins."""
    filings = table(spark, base, "filings").where("accession_no IS NOT NULL").groupBy("accession_no").agg(F.max("ticker").alias("ticker"), F.max("cik").alias("cik"))
    chunks = table(spark, base, "chunks").where("accession_no IS NOT NULL").groupBy("accession_no").agg(F.max("ticker").alias("ticker"), F.max("cik").alias("cik"))
    return upserts.fill_missing(filings, chunks, ["accession_no"])


def provenance_lookup(spark: SparkSession, base: str) -> DataFrame:
    """Chunk to section to filing to company; a missing link leaves the whole chain empty."""
    chunks = chunks_once(spark, base).select("chunk_id", "accession_no", "section_id", "section_title")
    filings = table(spark, base, "filings").where("accession_no IS NOT NULL").groupBy("accession_no").agg(F.max("form").alias("form"), F.max("cik").alias("cik"))
    companies = table(spark, base, "canonical_entities").where("cik IS NOT NULL").select("cik", "name")
    chain = filings.join(companies, "cik")
    mentions = table(spark, base, "risk_factors").groupBy("chunk_id").agg(F.array_join(F.array_sort(F.collect_set("company")), "; ").alias("companies"))
    return chunks.join(chain, "accession_no", "left").join(mentions, "chunk_id", "left").select("chunk_id", "section_title", "accession_no", "form", "name", "companies")


def citation_ids_known(spark: SparkSession, base: str) -> DataFrame:
    """How many of the chunks that risks cite exist."""
    cited = table(spark, base, "risk_factors").select("chunk_id").where("chunk_id IS NOT NULL").distinct()
    known = table(spark, base, "chunks").select("chunk_id").distinct().withColumn("is_known", F.lit(True))
    return cited.join(known, "chunk_id", "left").agg(F.count("*").alias("cited"), F.count("is_known").alias("known"))


def chunk_form_pivot(spark: SparkSession, base: str) -> DataFrame:
    rows = chunks_once(spark, base).withColumn("form", tidy_form(F.col("form"))).where("form IN ('10-K', '10-Q', '20-F', '8-K')")
    return rows.groupBy("section_id").pivot("form", ["10-K", "10-Q", "20-F", "8-K"]).count().na.fill(0).select(
        "section_id", F.col("10-K").alias("n_10k"), F.col("10-Q").alias("n_10q"), F.col("20-F").alias("n_20f"), F.col("8-K").alias("n_8k")
    )


def section_kinds(spark: SparkSession, base: str) -> DataFrame:
    words = F.size(F.filter(F.split(F.col("text"), r"\s+"), lambda w: w != ""))
    return chunks_once(spark, base).groupBy("section_id").agg(
        F.count("*").alias("n_chunks"), F.count_if(F.col("kind") == "table").alias("n_tables"), F.sum(words).alias("words"), F.countDistinct("ticker").alias("tickers")
    )


def prose_about_supply(spark: SparkSession, base: str) -> DataFrame:
    rows = chunks_once(spark, base).where((F.col("kind") == "prose") & F.col("text").rlike("(?i)suppl|foundr"))
    return rows.groupBy("ticker", "section_id").agg(F.count("*").alias("n"))


def chunk_sample(spark: SparkSession, base: str) -> DataFrame:
    """A sample that is the same on every run: the ten least hashes of ids."""
    ids = table(spark, base, "chunks").select("chunk_id").where("chunk_id IS NOT NULL").distinct()
    return ids.orderBy(F.md5("chunk_id"), "chunk_id").limit(10)


def facts_flattened(spark: SparkSession, base: str) -> DataFrame:
    """Facts as nested documents per company, and flattened again."""
    rows = table(spark, base, "xbrl_facts").where("cik IS NOT NULL AND concept IS NOT NULL AND unit IS NOT NULL").withColumn("label", F.lit(None).cast("string"))
    flat = files.flatten_facts(files.nest_facts(rows))
    return flat.groupBy("cik", "taxonomy", "unit").agg(F.count("*").alias("n"), F.countDistinct("concept").alias("concepts"), F.count("val").alias("valued"), F.min("accn").alias("first_accn"))


def vector_lengths(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "evidence_spans").where("embedding IS NOT NULL").select("encoder", F.size("embedding").alias("dims"), norm(F.col("embedding")).alias("length"))
    return rows.groupBy("encoder", "dims").agg(F.count("*").alias("n"), F.round(F.min("length"), 5).alias("least"), F.round(F.avg("length"), 5).alias("mean"))


_FILINGS = f"(SELECT * REPLACE ({any_date_sql('filing_date')} AS filing_date) FROM filings WHERE ticker IS NOT NULL QUALIFY row_number() OVER (PARTITION BY accession_no ORDER BY fetched_at DESC NULLS LAST, size_bytes DESC NULLS LAST) = 1)"
QUERIES = {f.__name__: f for f in (
    metric_first_disclosure, metric_lookup_topk, metric_growth, filing_scope, cost_estimate, extraction_resume, filings_selected, filing_last_write, filing_first_write,
    ticker_ciks, ticker_filled, provenance_lookup, citation_ids_known, chunk_form_pivot, section_kinds, prose_about_supply, chunk_sample, facts_flattened, vector_lengths,
)}
SQL = {
    "metric_first_disclosure": f"WITH {METRICS} SELECT * FROM metrics",
    "metric_lookup_topk": f"WITH {METRICS} SELECT cik, metric, unit, val, period_start, period_end FROM metrics WHERE cik IN ({', '.join(map(str, ANCHORS))}) ORDER BY period_end DESC, cik, metric, unit LIMIT 20",
    "metric_growth": f"""WITH {METRICS}, l AS (SELECT *, lag(val) OVER (PARTITION BY cik, metric, unit ORDER BY period_end) AS previous FROM metrics)
      SELECT cik, metric, unit, period_end, val, previous, CASE WHEN previous <> 0 THEN val / previous - 1 END AS change FROM l""",
    "filing_scope": f"{SCOPE} SELECT chunk_id, ticker, form, accession_no, section_id FROM scope",
    "cost_estimate": f"""{SCOPE} SELECT ticker, count(*) AS n_chunks, sum(n_tokens)::BIGINT AS chunk_tokens, sum(n_tokens)::BIGINT + count(*) * 900 AS input_tokens, count(*) * 700 AS output_tokens
      FROM scope WHERE chunk_id NOT IN (SELECT chunk_id FROM extractions) GROUP BY 1""",
    "extraction_resume": f"WITH {CHUNKS} SELECT chunk_id, ticker FROM chunks_once c WHERE NOT EXISTS (SELECT 1 FROM extractions e WHERE e.chunk_id = c.chunk_id)",
    "filings_selected": f"""WITH f AS {_FILINGS} SELECT accession_no, ticker, form, filing_date FROM f WHERE form IN ('10-K', '20-F') AND year(filing_date) >= 2018
      UNION ALL SELECT accession_no, ticker, form, filing_date FROM (SELECT * FROM f WHERE form = '10-Q' QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY filing_date DESC NULLS LAST, accession_no DESC) = 1)""",
    "filing_last_write": """SELECT accession_no, ticker, form, size_bytes FROM filings WHERE accession_no IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY accession_no ORDER BY coalesce(fetched_at >= TIMESTAMP '2025-01-02', false) DESC, fetched_at DESC NULLS LAST, size_bytes DESC NULLS LAST, form DESC NULLS LAST) = 1""",
    "filing_first_write": """SELECT accession_no, ticker, form, size_bytes FROM filings WHERE accession_no IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY accession_no ORDER BY fetched_at NULLS LAST, size_bytes NULLS LAST, form NULLS LAST, ticker NULLS LAST) = 1""",
    "ticker_ciks": f"""SELECT {tidy_ticker_sql('ticker')} AS ticker, cik FROM filings WHERE {tidy_ticker_sql('ticker')} IS NOT NULL AND cik IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY {tidy_ticker_sql('ticker')} ORDER BY {any_date_sql('filing_date')} DESC NULLS LAST, accession_no DESC NULLS LAST, cik DESC) = 1""",
    "ticker_filled": """SELECT accession_no, coalesce(f.ticker, c.ticker) AS ticker, coalesce(f.cik, c.cik) AS cik
      FROM (SELECT accession_no, max(ticker) AS ticker, max(cik) AS cik FROM filings WHERE accession_no IS NOT NULL GROUP BY 1) f
      FULL JOIN (SELECT accession_no, max(ticker) AS ticker, max(cik) AS cik FROM chunks WHERE accession_no IS NOT NULL GROUP BY 1) c USING (accession_no)""",
    "provenance_lookup": f"""WITH {CHUNKS}, f AS (SELECT accession_no, max(form) AS form, max(cik) AS cik FROM filings WHERE accession_no IS NOT NULL GROUP BY 1),
      chain AS (SELECT accession_no, f.form, e.name FROM f JOIN canonical_entities e ON f.cik = e.cik),
      m AS (SELECT chunk_id, string_agg(DISTINCT company, '; ' ORDER BY company) AS companies FROM risk_factors GROUP BY 1)
      SELECT c.chunk_id, section_title, c.accession_no, chain.form, chain.name, CASE WHEN m.chunk_id IS NOT NULL THEN coalesce(companies, '') END AS companies
      FROM chunks_once c LEFT JOIN chain ON c.accession_no = chain.accession_no LEFT JOIN m ON c.chunk_id = m.chunk_id""",
    "citation_ids_known": "SELECT count(DISTINCT chunk_id) AS cited, count(DISTINCT chunk_id) FILTER (chunk_id IN (SELECT chunk_id FROM chunks)) AS known FROM risk_factors",
    "chunk_form_pivot": f"""WITH {CHUNKS}, tidy AS (SELECT section_id, {tidy_form_sql('form')} AS form FROM chunks_once) SELECT section_id, count(*) FILTER (form = '10-K') AS n_10k, count(*) FILTER (form = '10-Q') AS n_10q, count(*) FILTER (form = '20-F') AS n_20f,
      count(*) FILTER (form = '8-K') AS n_8k FROM tidy WHERE form IN ('10-K', '10-Q', '20-F', '8-K') GROUP BY 1""",
    "section_kinds": f"""WITH {CHUNKS} SELECT section_id, count(*) AS n_chunks, count(*) FILTER (kind = 'table') AS n_tables,
      sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')))::BIGINT AS words, count(DISTINCT ticker) AS tickers FROM chunks_once GROUP BY 1""",
    "prose_about_supply": f"WITH {CHUNKS} SELECT ticker, section_id, count(*) AS n FROM chunks_once WHERE kind = 'prose' AND regexp_matches(text, '(?i)suppl|foundr') GROUP BY 1, 2",
    "chunk_sample": "SELECT chunk_id FROM (SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id IS NOT NULL) ORDER BY md5(chunk_id), chunk_id LIMIT 10",
    "facts_flattened": """SELECT cik, taxonomy, unit, count(*) AS n, count(DISTINCT concept) AS concepts, count(val) AS valued, min(accn) AS first_accn FROM xbrl_facts
      WHERE cik IS NOT NULL AND concept IS NOT NULL AND unit IS NOT NULL AND taxonomy IN ('us-gaap', 'ifrs-full') GROUP BY 1, 2, 3""",
    "vector_lengths": """SELECT encoder, len(embedding) AS dims, count(*) AS n, round(min(l), 5) AS least, round(avg(l), 5) AS mean
      FROM (SELECT *, sqrt(coalesce(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 0)) AS l FROM evidence_spans WHERE embedding IS NOT NULL) GROUP BY 1, 2""",
}
