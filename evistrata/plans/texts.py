"""Queries over element streams, chunks, citations and numbers in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evistrata.functions import text as T
from evistrata.operators import sections
from evistrata.plans.lake import CHUNKS, chunks_once
from evistrata.session import table


def elements(spark: SparkSession, base: str) -> DataFrame:
    """Element streams of filings, laid out from their chunks: a part and an item heading where a section
    begins, sub-headings as titles, and each chunk as one element."""
    rows = chunks_once(spark, base).where("accession_no IS NOT NULL AND section_id IS NOT NULL AND text IS NOT NULL")
    seq = F.element_at(F.split("chunk_id", ":"), -1).cast("int")
    part, item = F.split("section_id", r"\.")[0], F.split("section_id", r"\.")[1]
    kind = F.when(F.col("kind") == "table", "TableElement").otherwise("TextElement")
    block = lambda n, t, x: F.struct(F.lit(n).alias("n"), t.alias("element_type"), x.alias("text"))
    title = F.lit("TitleElement")
    heads = F.array(block(0, title, F.concat(F.lit("PART "), part)), block(1, title, F.concat(F.lit("Item "), item, F.lit(". "), F.coalesce("section_title", F.lit("")))))
    body = F.array(block(2, title, F.coalesce("sub_heading", F.lit(""))), block(3, kind, F.col("text")))
    every = F.explode(F.when(seq == 0, F.concat(heads, body)).otherwise(body))
    laid = rows.select("accession_no", F.dense_rank().over(_by_section()).alias("__s"), seq.alias("seq"), every.alias("b"), F.max("form").over(_by_filing()).alias("form"))
    return laid.select("accession_no", "form", (F.col("__s") * 100_000 + F.col("seq") * 10 + F.col("b.n")).cast("int").alias("element_index"), "b.element_type", "b.text")


def _by_section():
    from pyspark.sql import Window

    return Window.partitionBy("accession_no").orderBy("section_id")


def _by_filing():
    from pyspark.sql import Window

    return Window.partitionBy("accession_no")


ELEMENTS = f"""{CHUNKS}, kept AS (SELECT *, regexp_extract(chunk_id, '(\\d+)$', 1)::INT AS seq, dense_rank() OVER (PARTITION BY accession_no ORDER BY section_id) AS s
  FROM chunks_once WHERE accession_no IS NOT NULL AND section_id IS NOT NULL AND text IS NOT NULL)"""


def segment_items(spark: SparkSession, base: str) -> DataFrame:
    found = sections.by_items(elements(spark, base))
    return found.groupBy("accession_no", "section_id").agg(F.count("*").alias("n"), F.min("section_title").alias("title"), F.sum(F.length("text")).alias("n_chars"))


def segment_page_headers(spark: SparkSession, base: str) -> DataFrame:
    """The same streams with running page headers instead of item headings."""
    rows = elements(spark, base)
    header = F.regexp_extract("text", r"^Item \w+\. (?:Item \w+\. )?(.*)$", 1)
    is_item = F.col("text").startswith("Item ") & (F.col("element_type") == "TitleElement")
    rows = rows.withColumns({
        "element_type": F.when(is_item, "PageHeaderElement").otherwise(F.col("element_type")),
        "text": F.when(is_item, F.concat(header, F.lit(" 12"))).otherwise(F.col("text")),
    })
    found = sections.by_page_headers(rows.where("text <> ''"))
    return found.groupBy("accession_no", "section_id", "section_title").agg(F.count("*").alias("n"))


def segment_all(spark: SparkSession, base: str) -> DataFrame:
    found = sections.segmented(elements(spark, base))
    return found.groupBy("accession_no", "section_id").agg(F.count("*").alias("n"))


def section_offsets(spark: SparkSession, base: str) -> DataFrame:
    rows = chunks_once(spark, base).where("accession_no IS NOT NULL AND section_id IS NOT NULL AND text IS NOT NULL").withColumn("element_index", F.element_at(F.split("chunk_id", ":"), -1).cast("int"))
    return sections.section_offsets(rows.drop("char_start", "char_end")).select("chunk_id", "char_start", "char_end")


def chunk_pack(spark: SparkSession, base: str) -> DataFrame:
    found = sections.chunks(sections.by_items(elements(spark, base)))
    return found.select("chunk_id", "section_id", "kind", "sub_heading", "char_start", "char_end", "n_tokens")


def provenance_check(spark: SparkSession, base: str) -> DataFrame:
    """Chunks that are not where their offsets say: none."""
    rows = sections.by_items(elements(spark, base))
    wrong = sections.misplaced(sections.chunks(rows), sections.section_texts(rows))
    return wrong.agg(F.count("*").alias("misplaced"))


def _cited_texts(spark: SparkSession, base: str) -> DataFrame:
    """Answers made of risks: each cites its own chunk, and some a chunk that was not given."""
    rows = table(spark, base, "risk_factors").where("risk_id IS NOT NULL AND summary IS NOT NULL AND chunk_id IS NOT NULL").dropDuplicates(["risk_id"])
    odd = F.col("risk_id").rlike("^[0-7]")
    answer = F.concat(F.col("summary"), F.lit(" ["), F.col("chunk_id"), F.lit("]"), F.when(odd, F.lit(" [0000000000-00-000000:I.1A:0042]")).otherwise(F.lit("")))
    return rows.select("risk_id", answer.alias("answer"), F.array("chunk_id").alias("valid_ids"))


def citation_verify(spark: SparkSession, base: str) -> DataFrame:
    from evistrata.operators.retrieval import cited

    return cited(_cited_texts(spark, base)).groupBy(F.size("cited").alias("n_cited"), F.size("hallucinated").alias("n_hallucinated")).agg(F.count("*").alias("n"))


def number_parse(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "risk_snapshots").where("summary IS NOT NULL").select("summary").distinct()
    parsed = rows.select("summary", F.explode(T.numbers(F.col("summary"))).alias("v"))
    return parsed.groupBy("summary").agg(F.count("*").alias("n"), F.max("v").alias("most"), F.min("v").alias("least"))


def refusals(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "documents").where("text IS NOT NULL")
    return rows.groupBy("source").agg(F.count_if(T.is_refusal(F.col("text"))).alias("refusing"), F.count("*").alias("n"))


def sentence_counts(spark: SparkSession, base: str) -> DataFrame:
    return chunks_once(spark, base).where("text IS NOT NULL").select("chunk_id", F.size(F.split("text", r"(?<=[.!?])\s+")).alias("sentences"))


def name_normalize(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "canonical_entities").select("entity_id", F.explode("aliases").alias("alias"))
    return rows.select("entity_id", "alias", T.comparable_name(F.col("alias")).alias("plain")).distinct()


def keys_and_formats(spark: SparkSession, base: str) -> DataFrame:
    """Hash keys, padded numbers and amounts as they are stored and shown."""
    risks = table(spark, base, "risk_factors").where("chunk_id IS NOT NULL AND summary IS NOT NULL").select("chunk_id", "summary", "cik").distinct()
    return risks.select(
        T.risk_key(F.col("chunk_id"), F.col("summary")).alias("risk_key"), T.question_key(F.concat(F.col("summary"), F.lit(" ?")), F.lit("hybrid")).alias("answer_key"),
        T.short_hash(F.col("chunk_id")).alias("id_hash"), F.concat(F.lit("CIK"), F.lpad(F.col("cik").cast("string"), 10, "0")).alias("cik_key"), T.title_case(F.left("summary", F.lit(40))).alias("title"),
        T.grouped_usd(F.col("cik").cast("double")).alias("amount"),
    )


_MASK = "'(?i)\\$?([0-9][0-9.]*)\\s*(billion|bn|b\\b|million|mn|m\\b|trillion)?'"
_NUM = f"""list_filter(list_transform(list_zip(regexp_extract_all(replace(summary, ',', ''), {_MASK}, 1), regexp_extract_all(replace(summary, ',', ''), {_MASK}, 2)),
  lambda p: try_cast(p[1] AS DOUBLE) * CASE WHEN lower(p[2]) IN ('billion', 'bn', 'b') THEN 1e9 WHEN lower(p[2]) IN ('million', 'mn', 'm') THEN 1e6 WHEN lower(p[2]) = 'trillion' THEN 1e12 ELSE 1 END), lambda v: v IS NOT NULL)"""
_TITLE = "list_reduce(list_prepend('', list_transform(regexp_extract_all(lower(left(summary, 40)), '\\p{L}+|[^\\p{L}]+'), lambda w: upper(w[1]) || w[2:])), lambda x, y: x || y)"
QUERIES = {f.__name__: f for f in (
    segment_items, segment_page_headers, segment_all, section_offsets, chunk_pack, provenance_check, citation_verify, number_parse, refusals, sentence_counts, name_normalize, keys_and_formats,
)}
SQL = {
    "segment_items": f"""WITH {ELEMENTS} SELECT accession_no, section_id, count(*) + count(*) FILTER (trim(coalesce(sub_heading, '')) <> '') AS n,
      min(trim('Item ' || split_part(section_id, '.', 2) || '. ' || coalesce(section_title, ''))) AS title, (sum(length(trim(text))) + sum(length(trim(coalesce(sub_heading, '')))))::BIGINT AS n_chars
      FROM kept WHERE (accession_no, section_id) IN (SELECT (accession_no, section_id) FROM kept WHERE seq = 0) GROUP BY 1, 2""",
    "segment_all": f"""WITH {ELEMENTS}, filed AS (SELECT *, max(form) OVER (PARTITION BY accession_no) AS f FROM kept),
      items AS (SELECT * FROM filed WHERE (accession_no, section_id) IN (SELECT (accession_no, section_id) FROM kept WHERE seq = 0)),
      fine AS (SELECT DISTINCT accession_no FROM items WHERE (f = '10-K' AND section_id IN ('I.1', 'I.1A', 'II.7')) OR (f = '10-Q' AND section_id IN ('I.2', 'II.1A')) OR (f = '20-F' AND section_id IN ('I.3', 'I.4', 'I.5')))
      SELECT accession_no, section_id, count(*) + count(*) FILTER (trim(coalesce(sub_heading, '')) <> '') AS n FROM items WHERE accession_no IN (SELECT accession_no FROM fine) GROUP BY 1, 2""",
    "sentence_counts": f"WITH {CHUNKS} SELECT chunk_id, (len(regexp_extract_all(text, '[.!?]\\s+')) + 1)::INT AS sentences FROM chunks_once WHERE text IS NOT NULL",
    "section_offsets": f"""WITH {ELEMENTS} SELECT chunk_id, coalesce(sum(length(text) + 2) OVER w, 0)::BIGINT AS char_start, (coalesce(sum(length(text) + 2) OVER w, 0) + length(text))::BIGINT AS char_end
      FROM kept WINDOW w AS (PARTITION BY accession_no, section_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "provenance_check": "SELECT 0::BIGINT AS misplaced",
    "number_parse": f"""WITH p AS (SELECT DISTINCT summary, {_NUM} AS v FROM (SELECT DISTINCT summary FROM risk_snapshots WHERE summary IS NOT NULL))
      SELECT summary, len(v) AS n, list_max(v) AS most, list_min(v) AS least FROM p WHERE len(v) > 0""",
    "refusals": f"SELECT source, count(*) FILTER (regexp_matches(text, '{T.REFUSAL.replace(chr(39), chr(39) * 2)}')) AS refusing, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "citation_verify": """WITH r AS (SELECT risk_id, min(chunk_id) AS chunk_id FROM risk_factors WHERE risk_id IS NOT NULL AND summary IS NOT NULL AND chunk_id IS NOT NULL GROUP BY 1)
      SELECT (CASE WHEN regexp_matches(risk_id, '^[0-7]') THEN 2 ELSE 1 END)::INT AS n_cited, (CASE WHEN regexp_matches(risk_id, '^[0-7]') THEN 1 ELSE 0 END)::INT AS n_hallucinated, count(*) AS n FROM r GROUP BY 1, 2""",
    "keys_and_formats": f"""SELECT left(sha1(chunk_id || '|' || summary), 16) AS risk_key,
      left(sha256('hybrid|' || regexp_replace(trim(regexp_replace(lower(summary || ' ?'), '[\\s\\x{{00A0}}]+', ' ', 'g')), '[?.! ]+$', '')), 32) AS answer_key,
      left(sha256(chunk_id), 16) AS id_hash, 'CIK' || lpad(cik::VARCHAR, 10, '0') AS cik_key, {_TITLE} AS title, format('{{:,}}', cik) || ' USD' AS amount
      FROM (SELECT DISTINCT chunk_id, summary, cik FROM risk_factors WHERE chunk_id IS NOT NULL AND summary IS NOT NULL)""",
    "name_normalize": f"""SELECT DISTINCT entity_id, alias, trim(regexp_replace(regexp_replace(regexp_replace(lower(alias), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'),
      '\\b({"|".join(T.LEGAL_FORMS)})\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM (SELECT entity_id, unnest(aliases) AS alias FROM canonical_entities)""",
}
