"""Queries over disclosed risks: retrieval by vector, lineages and their states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evistrata.functions.dates import any_date
from evistrata.functions.text import tidy_form
from evistrata.operators import temporal, vector_search
from evistrata.plans.lake import any_date_sql, tidy_form_sql
from evistrata.session import table

#: The supplied vectors are less alike than real ones; lineages of queries form at this similarity.
SUPPLIED_SIMILARITY = 0.30
DAY = "2021-06-30"


def annual_risks(spark: SparkSession, base: str) -> DataFrame:
    """Risks with a usable vector that annual filings disclose: company, risk, evidence, section, filing."""
    risks = table(spark, base, "risk_factors").where(
        F.col("embedding").isNotNull() & (F.size("embedding") == 128) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)) & F.exists("embedding", lambda x: x != 0) & F.col("cik").isNotNull()
    )
    chunks = table(spark, base, "chunks").select("chunk_id", "accession_no", "section_id").where("accession_no IS NOT NULL").distinct()
    filings = table(spark, base, "filings").where(tidy_form(F.col("form")).isin("10-K", "20-F")).groupBy("accession_no").agg(F.min(any_date(F.col("filing_date"))).alias("filing_date"))
    rows = risks.select("cik", "company", "risk_id", "summary", "category", "chunk_id", "embedding").join(chunks, "chunk_id").join(filings, "accession_no").where("filing_date IS NOT NULL")
    # A risk repeated in the register counts once, with all values of one of its rows.
    one = rows.groupBy("risk_id").agg(F.min(F.struct("cik", "company", "summary", "category", "chunk_id", "accession_no", "filing_date", "embedding")).alias("r"))
    return one.select("risk_id", "r.*")


_ANNUAL = f"""f AS (SELECT accession_no, min({any_date_sql('filing_date')}) AS filing_date FROM filings WHERE {tidy_form_sql('form')} IN ('10-K', '20-F') GROUP BY 1),
c AS (SELECT DISTINCT chunk_id, accession_no, section_id FROM chunks WHERE accession_no IS NOT NULL),
usable AS (SELECT * FROM risk_factors WHERE len(embedding) = 128 AND cik IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
annual AS (SELECT risk_id, cik, r.chunk_id, c.accession_no, f.filing_date, summary, embedding
  FROM usable r JOIN c ON r.chunk_id = c.chunk_id JOIN f ON c.accession_no = f.accession_no WHERE f.filing_date IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY risk_id ORDER BY cik, company NULLS FIRST, summary NULLS FIRST, category NULLS FIRST, r.chunk_id, c.accession_no, f.filing_date, embedding) = 1)"""
#: The greedy lineages step by step: of each company a list of vector sums, one of which each risk joins or adds to.
_LINEAGES = f"""{_ANNUAL},
seq AS (SELECT risk_id, cik, accession_no, filing_date, summary, row_number() OVER (PARTITION BY cik ORDER BY filing_date, risk_id) AS rn,
  list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM annual),
walk AS (
  SELECT cik, rn, 0::BIGINT AS no, [v] AS sums FROM seq WHERE rn = 1
  UNION ALL
  SELECT cik, rn, CASE WHEN hit THEN best - 1 ELSE len(sums) END::BIGINT AS no,
    CASE WHEN hit THEN list_transform(sums, lambda c, i: CASE WHEN i = best THEN list_transform(c, lambda x, j: x + v[j]) ELSE c END) ELSE list_append(sums, v) END AS sums
  FROM (SELECT *, list_position(sims, list_max(sims)) AS best, list_max(sims) > 0 AND list_max(sims) >= {SUPPLIED_SIMILARITY} - 1e-12 AS hit
    FROM (SELECT s.cik, s.rn, s.v, w.sums, list_transform(w.sums, lambda c: list_cosine_similarity(c, s.v)) AS sims FROM walk w JOIN seq s ON s.cik = w.cik AND s.rn = w.rn + 1))),
lin AS (SELECT risk_id, seq.cik, accession_no, filing_date, summary, seq.cik || ':' || no AS lineage_id FROM walk JOIN seq ON walk.cik = seq.cik AND walk.rn = seq.rn),
company AS (SELECT cik, max(filing_date) AS latest, count(DISTINCT accession_no) AS filings FROM lin GROUP BY 1),
seen AS (SELECT cik, lineage_id, min(filing_date) AS first_seen, max(filing_date) AS last_seen FROM lin GROUP BY 1, 2),
states AS (SELECT lin.*, first_seen, last_seen, CASE WHEN last_seen < latest AND filings > 1 THEN 'Deleted' ELSE 'Active' END AS status,
  CASE WHEN last_seen < latest AND filings > 1 THEN latest END AS end_date, latest FROM lin JOIN seen USING (cik, lineage_id) JOIN company USING (cik))"""


def risk_fetch_multi_join(spark: SparkSession, base: str) -> DataFrame:
    return annual_risks(spark, base).select("risk_id", "cik", "chunk_id", "accession_no", "filing_date")


def _states(spark: SparkSession, base: str) -> DataFrame:
    risks = annual_risks(spark, base)
    found = temporal.lineages(risks, threshold=SUPPLIED_SIMILARITY)
    return temporal.states(found.join(risks.drop("embedding", "cik", "filing_date"), "risk_id"))


def lineage_clusters(spark: SparkSession, base: str) -> DataFrame:
    return temporal.lineages(annual_risks(spark, base), threshold=SUPPLIED_SIMILARITY).select("risk_id", "cik", "lineage_id")


def temporal_states(spark: SparkSession, base: str) -> DataFrame:
    return _states(spark, base).select("risk_id", "lineage_id", "first_seen", "last_seen", "status", "end_date")


def lineage_statistics(spark: SparkSession, base: str) -> DataFrame:
    return temporal.company_statistics(_states(spark, base))


def state_violations(spark: SparkSession, base: str) -> DataFrame:
    return temporal.violations(_states(spark, base))


def lineage_status_counts(spark: SparkSession, base: str) -> DataFrame:
    """By status the edges from companies to risks, all of them and the deleted ones, and their lineages."""
    return _states(spark, base).groupBy("status").agg(F.count("*").alias("edges"), F.countDistinct("lineage_id").alias("lineages"))


def dropped_lineages(spark: SparkSession, base: str) -> DataFrame:
    return temporal.dropped(_states(spark, base))


def new_lineages(spark: SparkSession, base: str) -> DataFrame:
    return temporal.newest(_states(spark, base)).select("cik", "lineage_id", "risk_id", "first_seen")


def asof_active(spark: SparkSession, base: str) -> DataFrame:
    return temporal.active_lineages(_states(spark, base), F.lit(DAY).cast("date"))


# The states of snapshots, which SQL can follow: a risk is its own lineage, a snapshot a filing.
def _register(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "risk_snapshots").where("cik IS NOT NULL AND risk_id IS NOT NULL")
    rows = rows.groupBy("cik", "risk_id", F.col("snap_date").alias("filing_date")).agg(F.min("summary").alias("summary"))
    return temporal.states(rows.withColumn("lineage_id", F.col("risk_id")).withColumn("accession_no", F.col("filing_date")))


_REGISTER = """m AS (SELECT cik, risk_id, snap_date AS filing_date, min(summary) AS summary FROM risk_snapshots WHERE cik IS NOT NULL AND risk_id IS NOT NULL GROUP BY 1, 2, 3),
company AS (SELECT cik, max(filing_date) AS latest, count(DISTINCT filing_date) AS filings FROM m GROUP BY 1),
seen AS (SELECT cik, risk_id, min(filing_date) AS first_seen, max(filing_date) AS last_seen FROM m GROUP BY 1, 2),
states AS (SELECT m.*, first_seen, last_seen, CASE WHEN last_seen < latest AND filings > 1 THEN 'Deleted' ELSE 'Active' END AS status,
  CASE WHEN last_seen < latest AND filings > 1 THEN latest END AS end_date, latest FROM m JOIN seen USING (cik, risk_id) JOIN company USING (cik))"""


def register_states(spark: SparkSession, base: str) -> DataFrame:
    return _register(spark, base).select("cik", "risk_id", "filing_date", "first_seen", "last_seen", "status", "end_date")


def register_status_counts(spark: SparkSession, base: str) -> DataFrame:
    """States by risk, and both counts of what is deleted: edges and lineages."""
    rows = _register(spark, base)
    return rows.groupBy("status").agg(F.count("*").alias("edges"), F.countDistinct("cik", "lineage_id").alias("lineages"))


def register_active(spark: SparkSession, base: str) -> DataFrame:
    return temporal.active_lineages(_register(spark, base), F.lit(DAY).cast("date"))


def register_active_of_one(spark: SparkSession, base: str) -> DataFrame:
    """The same with the optional condition given."""
    return temporal.active_lineages(_register(spark, base), F.lit(DAY).cast("date"), only=F.col("cik") == 5_000_001)


def register_dropped(spark: SparkSession, base: str) -> DataFrame:
    return temporal.dropped(_register(spark, base)).select("cik", "lineage_id", "first_seen", "last_seen", "example")


def register_newest(spark: SparkSession, base: str) -> DataFrame:
    return temporal.newest(_register(spark, base)).select("cik", "lineage_id", "filing_date")


def _query_vector(spark: SparkSession, base: str) -> list[float]:
    return list(table(spark, base, "embeddings").where("vec_id = 0").select("embedding").head()[0])


def vector_topk(spark: SparkSession, base: str) -> DataFrame:
    found = vector_search.top_k(table(spark, base, "embeddings"), _query_vector(spark, base), 10, key="vec_id")
    return found.select("vec_id", "label", F.round("score", 6).alias("score"))


def vector_topk_scoped(spark: SparkSession, base: str) -> DataFrame:
    """The 40 nearest, of which those of some labels remain, the best 6."""
    items = table(spark, base, "embeddings")
    scope = items.where("label IN (1, 3, 5)").select("vec_id")
    found = vector_search.scoped_top_k(items, _query_vector(spark, base), key="vec_id", first=40, scope=scope, k=6)
    return found.select("vec_id", F.round("score", 6).alias("score"))


def vector_topk_each(spark: SparkSession, base: str) -> DataFrame:
    """Queries with ids divisible by 100 against all rows."""
    items = table(spark, base, "embeddings")
    queries = items.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector_search.top_k_each(items, queries, 5, key="vec_id", query_key="query_id").select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


def centroids(spark: SparkSession, base: str) -> DataFrame:
    """Mean vector per label at length one, entry by entry."""
    rows = table(spark, base, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = rows.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    lengths = means.groupBy("label").agg(F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("length"))
    return means.join(lengths, "label").select("label", "pos", F.round(F.col("mean") / F.col("length"), 6).alias("x"))


_DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
_LEN = "sqrt(list_sum(list_transform({0}.embedding, lambda x: x::DOUBLE * x::DOUBLE)))"
_SCORE = f"{_DOT} / ({_LEN.format('a')} * {_LEN.format('b')})"

QUERIES = {f.__name__: f for f in (
    risk_fetch_multi_join, lineage_clusters, temporal_states, lineage_statistics, lineage_status_counts, state_violations, dropped_lineages, new_lineages, asof_active, register_states,
    register_status_counts, register_active, register_active_of_one, register_dropped, register_newest, vector_topk, vector_topk_scoped, vector_topk_each, centroids,
)}
SQL = {
    "risk_fetch_multi_join": f"WITH {_ANNUAL} SELECT risk_id, cik, chunk_id, accession_no, filing_date FROM annual",
    "lineage_clusters": f"WITH RECURSIVE {_LINEAGES} SELECT risk_id, cik, lineage_id FROM lin",
    "temporal_states": f"WITH RECURSIVE {_LINEAGES} SELECT risk_id, lineage_id, first_seen, last_seen, status, end_date FROM states",
    "lineage_statistics": f"""WITH RECURSIVE {_LINEAGES} SELECT cik, count(DISTINCT accession_no) AS annuals, count(*) AS risk_nodes, count(DISTINCT lineage_id) AS lineages,
      count(DISTINCT lineage_id) FILTER (status = 'Deleted') AS closed_lineages FROM states GROUP BY 1""",
    "lineage_status_counts": f"WITH RECURSIVE {_LINEAGES} SELECT status, count(*) AS edges, count(DISTINCT lineage_id) AS lineages FROM states GROUP BY 1",
    "state_violations": f"""WITH RECURSIVE {_LINEAGES} SELECT 'not one state' AS problem, count(*) AS n FROM (SELECT risk_id FROM states GROUP BY 1 HAVING count(*) <> 1)
      UNION ALL SELECT 'deleted without end', count(*) FROM states WHERE status = 'Deleted' AND end_date IS NULL
      UNION ALL SELECT 'active with end', count(*) FROM states WHERE status = 'Active' AND end_date IS NOT NULL UNION ALL SELECT 'ends before it starts', count(*) FROM states WHERE end_date < first_seen""",
    "dropped_lineages": f"""WITH RECURSIVE {_LINEAGES} SELECT cik, lineage_id, min(first_seen) AS first_seen, max(last_seen) AS last_seen, first(summary ORDER BY risk_id) AS example
      FROM states WHERE status = 'Deleted' GROUP BY 1, 2 ORDER BY last_seen DESC, cik, lineage_id LIMIT 10""",
    "new_lineages": f"WITH RECURSIVE {_LINEAGES} SELECT cik, lineage_id, risk_id, first_seen FROM states WHERE first_seen = latest",
    "asof_active": f"""WITH RECURSIVE {_LINEAGES} SELECT cik, count(DISTINCT lineage_id) AS active_lineages FROM states WHERE first_seen <= DATE '{DAY}' AND (end_date IS NULL OR end_date > DATE '{DAY}') GROUP BY 1""",
    "register_states": f"WITH {_REGISTER} SELECT cik, risk_id, filing_date, first_seen, last_seen, status, end_date FROM states",
    "register_status_counts": f"WITH {_REGISTER} SELECT status, count(*) AS edges, count(DISTINCT (cik, risk_id)) AS lineages FROM states GROUP BY 1",
    "register_active": f"WITH {_REGISTER} SELECT cik, count(DISTINCT risk_id) AS active_lineages FROM states WHERE first_seen <= DATE '{DAY}' AND (end_date IS NULL OR end_date > DATE '{DAY}') GROUP BY 1",
    "register_active_of_one": f"WITH {_REGISTER} SELECT cik, count(DISTINCT risk_id) AS active_lineages FROM states WHERE first_seen <= DATE '{DAY}' AND (end_date IS NULL OR end_date > DATE '{DAY}') AND cik = 5000001 GROUP BY 1",
    "register_dropped": f"""WITH {_REGISTER} SELECT cik, risk_id AS lineage_id, min(first_seen) AS first_seen, max(last_seen) AS last_seen, min(summary) AS example FROM states WHERE status = 'Deleted'
      GROUP BY 1, 2 ORDER BY last_seen DESC, cik, lineage_id LIMIT 10""",
    "register_newest": f"WITH {_REGISTER} SELECT cik, risk_id AS lineage_id, filing_date FROM states WHERE first_seen = latest",
    "vector_topk": f"SELECT a.vec_id, a.label, round({_SCORE}, 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b ORDER BY {_SCORE} DESC, a.vec_id LIMIT 10",
    "vector_topk_scoped": f"""WITH near AS (SELECT a.vec_id, a.label, {_SCORE} AS s FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b ORDER BY s DESC, a.vec_id LIMIT 40)
      SELECT vec_id, round(s, 6) AS score FROM near WHERE label IN (1, 3, 5) ORDER BY s DESC, vec_id LIMIT 6""",
    "vector_topk_each": f"""SELECT b.vec_id AS query_id, a.vec_id, row_number() OVER (PARTITION BY b.vec_id ORDER BY {_SCORE} DESC, a.vec_id) AS rank, round({_SCORE}, 6) AS score
      FROM embeddings a, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) b QUALIFY rank <= 5""",
    "centroids": """WITH x AS (SELECT label, unnest(range(len(embedding)))::INT AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, pos, avg(x) AS mean FROM x GROUP BY 1, 2),
      l AS (SELECT label, sqrt(sum(mean * mean)) AS length FROM m GROUP BY 1) SELECT label, pos, round(mean / length, 6) AS x FROM m JOIN l USING (label)""",
}
