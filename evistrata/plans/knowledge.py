"""Queries over relations, organisations and their graph."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from evistrata.functions.categories import EXTRACTED, KEYWORDS, REGISTERED, extracted_category, registered_category
from evistrata.functions.dates import any_date
from evistrata.functions.text import quote_in_text, tidy_code
from evistrata.operators import graph, mentions, model_calls, resolution, upserts
from evistrata.plans.lake import CHUNKS, any_date_sql, chunks_once, tidy_code_sql
from evistrata.session import materialize, table

ANCHORS = [-132, -26, 5_000_281]
#: The relation types that make edges.
RELATIONS = ("SUPPLIES_TO", "DEPENDS_ON", "CUSTOMER_OF", "COMPETES_WITH")


def companies(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "canonical_entities").select(F.col("entity_id").alias("cik"), "name")


def relation_mentions(spark: SparkSession, base: str) -> DataFrame:
    """Relations whose ends are names or aliases as they stand, with the date of their filing."""
    names = mentions.aliases(table(spark, base, "canonical_entities")).select(F.lower(F.trim("alias")).alias("a"), "entity_id")
    names = names.groupBy("a").agg(F.min("entity_id").alias("id"))
    days = table(spark, base, "chunks").groupBy("chunk_id").agg(F.min(any_date(F.col("filing_date"))).alias("date"))
    rows = table(spark, base, "extractions").select("chunk_id", F.explode("relations").alias("r")).select(
        "chunk_id", F.lower(F.trim("r.source_entity")).alias("s"), F.upper(F.trim("r.relation")).alias("rel"), F.lower(F.trim("r.target_entity")).alias("t"), F.col("r.evidence_quote").alias("quote")
    )
    rows = rows.where(F.col("rel").isin(*RELATIONS))
    ends = lambda side, name: names.select(F.col("a").alias(side), F.col("id").alias(name))
    rows = rows.join(ends("s", "src"), "s").join(ends("t", "dst"), "t").where("src <> dst")
    return rows.join(days, "chunk_id").select("src", "rel", "dst", "date", "chunk_id", "quote")


def relation_graph(spark: SparkSession, base: str) -> DataFrame:
    """The graph of ends as they are spelled, a part of the resolved one that SQL can follow."""
    return upserts.accumulate_edges(relation_mentions(spark, base))


def resolved_mentions(spark: SparkSession, base: str) -> DataFrame:
    """Relations whose ends the resolver knows, filers that name themselves included, with the date of their filing."""
    entities = table(spark, base, "canonical_entities")
    ids = entities.groupBy("name").agg(F.min("entity_id").alias("id"))
    days = table(spark, base, "chunks").groupBy("chunk_id").agg(F.min(any_date(F.col("filing_date"))).alias("date"))
    rows = resolution.resolved_relations(table(spark, base, "extractions"), entities).where("kept").select(
        "chunk_id", F.col("src").alias("s"), F.upper(F.trim("relation")).alias("rel"), F.col("dst").alias("t"), F.col("evidence_quote").alias("quote")
    )
    rows = rows.where(F.col("rel").isin(*RELATIONS))
    ends = lambda side, name: ids.select(F.col("name").alias(side), F.col("id").alias(name))
    rows = rows.join(ends("s", "src"), "s").join(ends("t", "dst"), "t").where("src <> dst")
    return rows.join(days, "chunk_id").select("src", "rel", "dst", "date", "chunk_id", "quote")


def resolved_graph(spark: SparkSession, base: str) -> DataFrame:
    """The graph of resolved relations. SQL has no such similarity, so its queries have none; the same queries
    over ``relation_graph``, named ``..._as_spelled``, are compared with SQL."""
    return upserts.accumulate_edges(resolved_mentions(spark, base))


_MENTIONS = f"""names AS (SELECT lower(trim(a)) AS a, min(entity_id) AS id FROM (
    SELECT entity_id, name AS a FROM canonical_entities UNION ALL SELECT entity_id, unnest(aliases) FROM canonical_entities) WHERE trim(a) <> '' GROUP BY 1),
days AS (SELECT chunk_id, min({any_date_sql('filing_date')}) AS date FROM chunks GROUP BY 1),
rel AS (SELECT chunk_id, unnest(relations) AS r FROM extractions),
rm AS (SELECT s.id AS src, upper(trim(r.relation)) AS rel, t.id AS dst, date, rel.chunk_id, r.evidence_quote AS quote
  FROM rel JOIN names s ON lower(trim(r.source_entity)) = s.a JOIN names t ON lower(trim(r.target_entity)) = t.a JOIN days ON rel.chunk_id = days.chunk_id
  WHERE upper(trim(r.relation)) IN {RELATIONS} AND s.id <> t.id)"""
EDGES = f"""{_MENTIONS},
firsts AS (SELECT * FROM rm QUALIFY row_number() OVER (PARTITION BY src, rel, dst, chunk_id ORDER BY date NULLS FIRST, quote NULLS FIRST) = 1),
edges AS (SELECT src, rel, dst, min(date) AS start_date, list(chunk_id ORDER BY date NULLS FIRST, chunk_id) AS ids,
  first(quote ORDER BY date NULLS FIRST, chunk_id, quote NULLS FIRST) AS quote FROM firsts GROUP BY 1, 2, 3)"""


def edge_upsert_accumulate(spark: SparkSession, base: str, rows=resolved_mentions) -> DataFrame:
    return upserts.accumulate_edges(rows(spark, base)).select("src", "rel", "dst", "start_date", F.array_join("evidence_chunk_ids", ",").alias("ids"), F.col("evidence_quote").alias("quote"))


def edge_merge(spark: SparkSession, base: str, rows=resolved_mentions) -> DataFrame:
    """Edges of two runs, split by date, merged into one table."""
    rows = materialize(rows(spark, base))
    early = F.col("date") < F.lit("2020-01-01").cast("date")
    merged = upserts.merge_accumulated(upserts.accumulate_edges(rows.where(early)), upserts.accumulate_edges(rows.where(~early)))
    return merged.select("src", "rel", "dst", "start_date", F.size("evidence_chunk_ids").alias("n_ids"), F.col("evidence_quote").alias("quote"))


def edge_create_once(spark: SparkSession, base: str) -> DataFrame:
    """Exposure edges of two runs, first write wins."""
    rows = table(spark, base, "risk_factors").where("risk_id IS NOT NULL AND cik IS NOT NULL").select("cik", "risk_id", F.col("filing_date").alias("start_date"))
    early = F.coalesce(F.col("start_date") < F.lit("2020-01-01").cast("date"), F.lit(False))
    old = rows.where(early).groupBy("cik", "risk_id").agg(F.min("start_date").alias("start_date"))
    return upserts.insert_new(old, rows.where(~early), ["cik", "risk_id"], [F.col("start_date")])


def k_hop_edges(spark: SparkSession, base: str, rows=resolved_mentions) -> DataFrame:
    start = spark.createDataFrame([(a,) for a in ANCHORS], "node long")
    edges = graph.k_hop_edges(rows(spark, base).select("src", "rel", "dst").distinct(), start, 2)
    return graph.labelled(edges, companies(spark, base), key="cik", name="name").select("src", "rel", "dst", "src_name", "dst_name")


def reachability_count(spark: SparkSession, base: str, rows=resolved_mentions) -> DataFrame:
    edges = materialize(rows(spark, base).where("rel IN ('CUSTOMER_OF', 'DEPENDS_ON')").select("src", "rel", "dst").distinct())
    return graph.reaching(edges, edges.select(F.col("dst").alias("node")).distinct(), 3)


def shortest_path(spark: SparkSession, base: str, rows=resolved_mentions) -> DataFrame:
    """From one company to any of those that nobody but the last few names end with."""
    edges = materialize(rows(spark, base).select("src", "rel", "dst").distinct())
    goals = edges.where("dst < -200").select(F.col("dst").alias("node"))
    found = graph.shortest_path(edges, F.lit(ANCHORS[0]).cast("long"), goals)
    return found.select(F.concat_ws(">", F.transform("path", lambda x: x.cast("string"))).alias("path"), "length")


def neighborhood_evidence(spark: SparkSession, base: str, rows=resolved_mentions) -> DataFrame:
    found = graph.neighbourhood(upserts.accumulate_edges(rows(spark, base)), ANCHORS[0], chunks_once(spark, base))
    return found.select("src", "rel", "dst", "chunk_id", F.length("text").alias("n_chars"))


def graph_stats(spark: SparkSession, base: str, rows=resolved_mentions) -> DataFrame:
    """Nodes per label, those of the service itself (labels with its prefix) aside, and edges per type."""
    t = lambda n: table(spark, base, n)
    count = lambda label, df, key: df.where(F.col(key).isNotNull()).agg(F.countDistinct(key).alias("n")).select(F.lit(label).alias("label"), "n")
    parts = [
        count("Company", t("canonical_entities"), "entity_id"), count("Filing", t("filings"), "accession_no"),
        count("FilingSection", t("chunks").withColumn("k", F.when(F.col("accession_no").isNotNull() & F.col("section_id").isNotNull(), F.concat_ws(":", "accession_no", "section_id"))), "k"),
        count("EvidenceSpan", t("chunks"), "chunk_id"), count("RiskFactor", t("risk_factors"), "risk_id"),
        count("Product", t("extractions").select(F.explode("products").alias("p")).select("p.name"), "name"),
        count("SvcEvent", t("events"), "event_id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    edges = rows(spark, base).select("src", "rel", "dst").distinct().groupBy(F.col("rel").alias("label")).agg(F.count("*").alias("n"))
    return out.where(~F.col("label").startswith("Svc")).union(edges)


def entity_ids_assigned(spark: SparkSession, base: str) -> DataFrame:
    """Numbers for the organisations of the dictionary: their own, or -1, -2, ... by name for those without one.

    The dictionary is a list of fixed size, so one task may number it.
    """
    rows = table(spark, base, "canonical_entities").groupBy("name").agg(F.max("cik").alias("cik"))
    missing = rows.where("cik IS NULL").withColumn("entity", -F.row_number().over(Window.orderBy("name")).cast("long"))
    return rows.where("cik IS NOT NULL").select("name", F.col("cik").alias("entity")).union(missing.select("name", "entity"))


def exposure_screening(spark: SparkSession, base: str) -> DataFrame:
    """Companies and notices that share a topic: risk texts against rule notices, by topic keywords."""
    risks = table(spark, base, "risk_factors").select("cik", extracted_category(F.col("category")).alias("category"), "chunk_id", F.col("evidence_quote").alias("text"))
    exposed = mentions.exposure_text(risks.where("cik IS NOT NULL"))
    rules = table(spark, base, "documents").where((tidy_code(F.col("source")) == "rule_notices") & F.col("text").isNotNull()).select(F.col("doc_id").alias("rule_id"), F.col("text").alias("title"), F.lit("").alias("text"))
    return mentions.cooccurrences(exposed, rules, SCREENED).select("cik", "rule_id", "topic")


#: Topics of the supplied notices, whose goods are the ones that risks name.
SCREENED = {"photoresist": ("photoresist", "mask blanks"), "helium": ("helium", "neon gas"), "gallium": ("gallium", "germanium"), "quartz": ("quartz", "slurry")}


def mention_edges(spark: SparkSession, base: str) -> DataFrame:
    return mentions.mentioned(chunks_once(spark, base), table(spark, base, "canonical_entities"))


def mention_counts(spark: SparkSession, base: str) -> DataFrame:
    lists = mentions.mention_lists(chunks_once(spark, base), table(spark, base, "canonical_entities"))
    return lists.select("chunk_id", F.array_join(F.transform("entity_ids", lambda x: x.cast("string")), ",").alias("ids"))


def detect_anchors(spark: SparkSession, base: str) -> DataFrame:
    questions = table(spark, base, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("question_id"), F.col("text").alias("question"))
    return mentions.anchors(questions, table(spark, base, "canonical_entities"), default=ANCHORS[0])


def quote_gate(spark: SparkSession, base: str) -> DataFrame:
    """Evidence quotes of risks against the text of their chunk."""
    texts = chunks_once(spark, base).select("chunk_id", "text")
    rows = table(spark, base, "risk_factors").join(texts, "chunk_id").select("risk_id", quote_in_text(F.col("evidence_quote"), F.col("text")).alias("supported"))
    return rows.groupBy("risk_id").agg(F.max("supported").alias("supported"))


def extraction_gate(spark: SparkSession, base: str) -> DataFrame:
    gated = model_calls.with_supported_quotes(table(spark, base, "extractions"), chunks_once(spark, base))
    return gated.select("record_no", F.size("relations").alias("relations"), F.size("risk_factors").alias("risks"), "dropped_quotes")


def category_normalize(spark: SparkSession, base: str) -> DataFrame:
    risks = table(spark, base, "risk_factors")
    return risks.groupBy(F.col("category").alias("written"), extracted_category(F.col("category")).alias("category")).agg(F.count("*").alias("n"))


def category_mapping(spark: SparkSession, base: str) -> DataFrame:
    """The changes that bring written categories to the register's spelling."""
    written = table(spark, base, "risk_snapshots").select(F.col("category").alias("old")).where("category IS NOT NULL").distinct()
    return written.withColumn("new", registered_category(F.col("old"))).where("old <> new")


def category_rewrite(spark: SparkSession, base: str) -> DataFrame:
    rows = upserts.rewrite_values(table(spark, base, "risk_snapshots"), category_mapping(spark, base), "category")
    return rows.groupBy("category").agg(F.count("*").alias("n"))


def entity_resolution(spark: SparkSession, base: str) -> DataFrame:
    rows = resolution.resolved_relations(table(spark, base, "extractions"), table(spark, base, "canonical_entities"))
    return rows.select("record_no", "rel_pos", "src", "relation", "dst", "kept")


def resolution_report(spark: SparkSession, base: str) -> DataFrame:
    return resolution.resolution_report(resolution.resolved_relations(table(spark, base, "extractions"), table(spark, base, "canonical_entities")))


def unresolved_top(spark: SparkSession, base: str) -> DataFrame:
    return resolution.unresolved_names(resolution.resolved_relations(table(spark, base, "extractions"), table(spark, base, "canonical_entities")))


def relation_types(spark: SparkSession, base: str) -> DataFrame:
    """How often each relation type was given, and whether it makes an edge."""
    rows = table(spark, base, "extractions").select(F.explode("relations").alias("r")).select(F.upper(F.trim("r.relation")).alias("relation"))
    return rows.groupBy("relation").agg(F.count("*").alias("n")).withColumn("is_edge", F.coalesce(F.col("relation").isin(*RELATIONS), F.lit(False)))


def product_types(spark: SparkSession, base: str) -> DataFrame:
    """Products with the first type given, by record."""
    rows = table(spark, base, "extractions").select("record_no", F.posexplode("products").alias("pos", "p")).select("record_no", "pos", "p.name", "p.type").where("name IS NOT NULL AND type IS NOT NULL")
    return rows.groupBy("name").agg(F.min_by("type", F.struct("record_no", "pos")).alias("type"), F.countDistinct("record_no").alias("records"))


_NB, _NA = "(^|[^\\p{L}\\p{N}_])", "($|[^\\p{L}\\p{N}_])"
_ALIAS = "al AS (SELECT DISTINCT entity_id, lower(trim(a)) AS a FROM (SELECT entity_id, name AS a FROM canonical_entities UNION ALL SELECT entity_id, unnest(aliases) FROM canonical_entities) WHERE trim(a) <> '')"


def _found(table_: str, key: str, text: str) -> str:
    return f"""SELECT DISTINCT t.{key}, al.entity_id FROM {table_} t JOIN al ON
      CASE WHEN contains(lower(t.{text}), al.a) THEN regexp_matches(lower(t.{text}), '{_NB}' || regexp_escape(al.a) || '{_NA}') ELSE false END"""


def _category_sql() -> str:
    t = "lower(trim(category))"
    cases = [f"WHEN category IS NULL OR {t} = '' THEN 'Other'"] + [f"WHEN {t} = '{c.lower()}' THEN '{c}'" for c in EXTRACTED]
    cases += [f"WHEN {' OR '.join(f"contains({t}, '{w}')" for w in words)} THEN '{c}'" for c, words in KEYWORDS.items()]
    return f"CASE {' '.join(cases)} ELSE 'Other' END"


def _registered_sql() -> str:
    cases = " ".join(f"WHEN lower(trim(old)) = '{c.lower()}' THEN '{c}'" for c in REGISTERED)
    words = "list_reduce(list_prepend('', list_transform(regexp_extract_all(lower(trim(old)), '[a-z]+|[^a-z]+'), lambda w: upper(w[1]) || w[2:])), lambda x, y: x || y)"
    return f"CASE {cases} ELSE {words} END"


_MAPPING = f"map AS (SELECT old, new FROM (SELECT old, {_registered_sql()} AS new FROM (SELECT DISTINCT category AS old FROM risk_snapshots WHERE category IS NOT NULL)) WHERE old <> new)"
_COMPARABLE = "trim(lower(regexp_replace({0}, '[\\s\\x{{00A0}}\\x{{2000}}-\\x{{200A}}\\x{{3000}}’''\"“”]+', ' ', 'g')))"
_BOTH = "both_ways AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges)"
_ANCHORED = ", ".join(map(str, ANCHORS))

_GRAPH = (edge_upsert_accumulate, edge_merge, k_hop_edges, reachability_count, shortest_path, neighborhood_evidence, graph_stats)
QUERIES = {f.__name__: f for f in (
    *_GRAPH, edge_create_once, entity_ids_assigned, exposure_screening,
    mention_edges, mention_counts, detect_anchors, quote_gate, extraction_gate, category_normalize, category_mapping, category_rewrite, entity_resolution,
    resolution_report, unresolved_top, relation_types, product_types,
)} | {f"{f.__name__}_as_spelled": functools.partial(f, rows=relation_mentions) for f in _GRAPH}
SQL = {
    "edge_upsert_accumulate_as_spelled": f"WITH {EDGES} SELECT src, rel, dst, start_date, array_to_string(ids, ',') AS ids, quote FROM edges",
    "edge_merge_as_spelled": f"""WITH {EDGES}, part AS (SELECT *, coalesce(date >= DATE '2020-01-01', true) AS late FROM rm WHERE date IS NOT NULL),
      pf AS (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY src, rel, dst, chunk_id, late ORDER BY date, quote NULLS FIRST) = 1)
      SELECT src, rel, dst, min(date) AS start_date, count(DISTINCT chunk_id) AS n_ids, first(quote ORDER BY late, date, chunk_id, quote NULLS FIRST) AS quote FROM pf GROUP BY 1, 2, 3""",
    "edge_create_once": "SELECT cik, risk_id, min(filing_date) AS start_date FROM risk_factors WHERE risk_id IS NOT NULL AND cik IS NOT NULL GROUP BY 1, 2",
    "k_hop_edges_as_spelled": f"""WITH {EDGES}, near AS (SELECT unnest([{_ANCHORED}]) AS n UNION SELECT b FROM (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges) WHERE a IN ({_ANCHORED}))
      SELECT DISTINCT src, rel, dst, s.name AS src_name, d.name AS dst_name FROM edges LEFT JOIN canonical_entities s ON src = s.entity_id LEFT JOIN canonical_entities d ON dst = d.entity_id
      WHERE src IN (SELECT n FROM near) OR dst IN (SELECT n FROM near)""",
    "reachability_count_as_spelled": f"""WITH {EDGES}, e AS (SELECT DISTINCT src, dst FROM edges WHERE rel IN ('CUSTOMER_OF', 'DEPENDS_ON')),
      one AS (SELECT dst AS t, src AS s FROM e), two AS (SELECT one.t, e.src AS s FROM one JOIN e ON e.dst = one.s), three AS (SELECT two.t, e.src AS s FROM two JOIN e ON e.dst = two.s)
      SELECT x.t AS target, count(DISTINCT s) FILTER (s <> x.t) AS sources FROM (SELECT * FROM one UNION SELECT * FROM two UNION SELECT * FROM three) x GROUP BY 1""",
    "shortest_path_as_spelled": f"""WITH RECURSIVE {EDGES}, {_BOTH},
      walk AS (SELECT {ANCHORS[0]}::BIGINT AS node, [{ANCHORS[0]}::BIGINT] AS path UNION ALL
        SELECT b, list_append(path, b) FROM walk JOIN both_ways ON node = a WHERE len(path) <= 4 AND NOT list_contains(path, b) AND node >= -200)
      SELECT array_to_string(path, '>') AS path, len(path) - 1 AS length FROM walk WHERE node < -200 AND node IN (SELECT dst FROM edges) ORDER BY len(path), walk.path LIMIT 1""",
    "neighborhood_evidence_as_spelled": f"""WITH {EDGES}, {CHUNKS}, x AS (SELECT src, rel, dst, unnest(ids) AS chunk_id FROM edges WHERE src = {ANCHORS[0]} OR dst = {ANCHORS[0]})
      SELECT src, rel, dst, chunk_id, length(text) AS n_chars FROM x JOIN chunks_once USING (chunk_id)""",
    "graph_stats_as_spelled": f"""WITH {EDGES} SELECT 'Company' AS label, count(DISTINCT entity_id) AS n FROM canonical_entities
      UNION ALL SELECT 'Filing', count(DISTINCT accession_no) FROM filings UNION ALL SELECT 'FilingSection', count(DISTINCT accession_no || ':' || section_id) FROM chunks
      UNION ALL SELECT 'EvidenceSpan', count(DISTINCT chunk_id) FROM chunks UNION ALL SELECT 'RiskFactor', count(DISTINCT risk_id) FROM risk_factors
      UNION ALL SELECT 'Product', count(DISTINCT p.name) FROM (SELECT unnest(products) AS p FROM extractions) UNION ALL SELECT rel, count(*) FROM edges GROUP BY 1""",
    "exposure_screening": f"""WITH picked AS (SELECT DISTINCT cik, chunk_id, evidence_quote AS text FROM risk_factors WHERE cik IS NOT NULL AND {_category_sql()} = 'Export Controls'),
      x AS (SELECT cik, left(string_agg(' ' || coalesce(text, ''), '' ORDER BY chunk_id, text), 8000) AS text FROM
        (SELECT * FROM picked QUALIFY row_number() OVER (PARTITION BY cik ORDER BY chunk_id NULLS FIRST, text NULLS FIRST) <= 5) GROUP BY 1),
      topics AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{t}', {list(w)})" for i, (t, w) in enumerate(SCREENED.items()))}) v(i, topic, words)),
      r AS (SELECT doc_id, v.i, v.topic, v.words FROM documents d JOIN topics v ON contains(lower(d.text), v.topic) WHERE {tidy_code_sql('source')} = 'rule_notices')
      SELECT cik, doc_id AS rule_id, arg_min(r.topic, r.i) AS topic FROM x JOIN r ON len(list_filter(words, lambda w: contains(lower(x.text), w))) > 0 GROUP BY 1, 2""",
    "mention_edges": f"WITH {CHUNKS}, {_ALIAS} {_found('chunks_once', 'chunk_id', 'text')}",
    "mention_counts": f"WITH {CHUNKS}, {_ALIAS}, m AS ({_found('chunks_once', 'chunk_id', 'text')}) SELECT chunk_id, string_agg(entity_id::VARCHAR, ',' ORDER BY entity_id) AS ids FROM m GROUP BY 1",
    "detect_anchors": f"""WITH q AS (SELECT doc_id AS question_id, text AS question FROM documents WHERE text IS NOT NULL), {_ALIAS}, m AS MATERIALIZED ({_found('q', 'question_id', 'question')})
      SELECT question_id, entity_id, name FROM m JOIN canonical_entities USING (entity_id)
      UNION ALL SELECT question_id, {ANCHORS[0]}, (SELECT name FROM canonical_entities WHERE entity_id = {ANCHORS[0]}) FROM q ANTI JOIN m USING (question_id)""",
    "entity_ids_assigned": """WITH e AS (SELECT name, max(cik) AS cik FROM canonical_entities GROUP BY 1)
      SELECT name, cik AS entity FROM e WHERE cik IS NOT NULL UNION ALL SELECT name, -row_number() OVER (ORDER BY name) FROM e WHERE cik IS NULL""",
    "quote_gate": f"""WITH {CHUNKS} SELECT risk_id, max(contains({_COMPARABLE.format('c.text')}, {_COMPARABLE.format('evidence_quote')})) AS supported
      FROM risk_factors r JOIN chunks_once c ON r.chunk_id = c.chunk_id GROUP BY 1""",
    "extraction_gate": f"""WITH {CHUNKS}, x AS (SELECT record_no, relations, risk_factors, {_COMPARABLE.format('c.text')} AS t FROM extractions e LEFT JOIN chunks_once c ON e.chunk_id = c.chunk_id),
      g AS (SELECT *, len(list_filter(relations, lambda r: coalesce(contains(t, {_COMPARABLE.format('r.evidence_quote')}), false))) AS a,
        len(list_filter(risk_factors, lambda r: coalesce(contains(t, {_COMPARABLE.format('r.evidence_quote')}), false))) AS b FROM x)
      SELECT record_no, a AS relations, b AS risks, len(relations) - a + len(risk_factors) - b AS dropped_quotes FROM g""",
    "category_normalize": f"SELECT category AS written, {_category_sql()} AS category, count(*) AS n FROM risk_factors GROUP BY 1, 2",
    "category_mapping": f"WITH {_MAPPING} SELECT old, new FROM map",
    "category_rewrite": f"WITH {_MAPPING} SELECT coalesce(new, category) AS category, count(*) AS n FROM risk_snapshots LEFT JOIN map ON category = old GROUP BY 1",
    "relation_types": f"""SELECT upper(trim(r.relation)) AS relation, count(*) AS n, coalesce(upper(trim(r.relation)) IN {RELATIONS}, false) AS is_edge
      FROM (SELECT unnest(relations) AS r FROM extractions) GROUP BY 1""",
    "product_types": """WITH p AS (SELECT record_no, unnest(range(len(products))) AS pos, unnest(products) AS p FROM extractions)
      SELECT p.name AS name, arg_min(p.type, (record_no, pos)) AS type, count(DISTINCT record_no) AS records FROM p WHERE p.name IS NOT NULL AND p.type IS NOT NULL GROUP BY 1""",
}
