import datetime
import random
from collections import deque

import numpy as np
from pyspark.sql import functions as F

from evistrata import schemas
from evistrata.functions import categories, text, vectors
from evistrata.functions.dates import any_date
from evistrata.operators import evaluation, facts, graph, limits, mentions, model_calls, resolution, retrieval, scopes, sections, temporal, upserts, vector_search

DAY = datetime.date


def values(df, *names):
    return sorted((tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect()), key=repr)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()["x"]


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, text.comparable_quote(lit("  The “quick”\n fox’s "))) == "the quick fox s"
    assert one(spark, text.quote_in_text(lit(""), lit("abc"))) is True
    assert one(spark, text.comparable_name(lit("Taiwan Semi-Conductor Co., Ltd."))) == "taiwan semi conductor"
    assert one(spark, text.title_case(lit("legal/regulatory o'neil ÄRA"))) == "legal/regulatory o'neil ära".title()
    assert one(spark, text.numbers(lit("$60.9 billion, 1,200 units, 3.5M and 1.2.3"))) == [60.9e9, 1200.0, 3.5e6]
    assert one(spark, text.citations(lit("a [0001-24-01:I.1A:0003] b [0001-24-01:I.1A:0003] [x]"))) == ["0001-24-01:I.1A:0003"]
    assert one(spark, text.section_marker(lit("Risk factors (continued)"))) == "risk factors"
    assert one(spark, text.section_marker(lit("MD&A58"))) == "md&a"
    assert one(spark, text.is_refusal(lit("The context does not contain it"))) is True
    a, b = (one(spark, text.question_key(lit(q), lit("hybrid"))) for q in ("Who supplies X?", "  who   supplies x ?! "))
    assert a == b and len(a) == 32
    assert one(spark, any_date(lit("Jan 5, 2024"))) == DAY(2024, 1, 5) == one(spark, any_date(lit("01/05/2024"))) == one(spark, any_date(lit("2024-01-05T00:00:00Z")))
    assert one(spark, any_date(lit("2024-02-31"))) is None


def test_categories(spark):
    cases = {"Export Control policy": "Export Controls", " supply chain ": "Supply Chain", "cybersecurity": "Technology", "": "Other", "weather": "Other", "trade war with China": "Geopolitical"}
    for given, want in cases.items():
        assert one(spark, categories.extracted_category(F.lit(given))) == want
    assert one(spark, categories.registered_category(F.lit("cybersecurity"))) == "Cybersecurity"
    assert one(spark, categories.registered_category(F.lit("legal/other"))) == "Legal/Other"


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None), (5, [4.0, 3.0])], "id int, v array<float>")
    found = vector_search.top_k(df, [3.0, 4.0], 3, key="id", vector="v").collect()
    assert [(r.id, round(r.score, 6)) for r in found] == [(1, 1.0), (5, 0.96)]
    assert one(spark, vectors.unit(F.array(F.lit(0.0)))) is None


def test_scoped_search_filters_after_the_limit(spark):
    df = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(5)], "id int, v array<float>")
    scope = spark.createDataFrame([(4,), (0,)], "id int")
    found = vector_search.scoped_top_k(df, [1.0, 0.0], key="id", first=2, scope=scope, k=2, vector="v").collect()
    assert [r.id for r in found] == [0]


def test_upserts(spark):
    kind = "k string, v string, t int"
    old, new = spark.createDataFrame([("a", "1", 1), ("b", None, 1)], kind), spark.createDataFrame([("a", "2", 5), ("a", "3", 4), ("c", "9", 1)], kind)
    assert values(upserts.upsert_last(old, new, ["k"], [F.col("t")]), "k", "v") == [("a", "2"), ("b", None), ("c", "9")]
    assert values(upserts.insert_new(old, new, ["k"], [F.col("t")]), "k", "v") == [("a", "1"), ("b", None), ("c", "9")]
    assert values(upserts.fill_missing(old, spark.createDataFrame([("b", "x", 7)], kind), ["k"]), "k", "v", "t") == [("a", "1", 1), ("b", "x", 1)]


def test_accumulated_edges(spark):
    rows = [("s", "R", "d", DAY(2021, 1, 1), "c2", "q2"), ("s", "R", "d", DAY(2020, 1, 1), "c1", "q1"), ("s", "R", "d", DAY(2022, 1, 1), "c1", "q3"), ("s", "R", "d", DAY(2020, 1, 1), "c1", "q0")]
    df = spark.createDataFrame(rows, "src string, rel string, dst string, date date, chunk_id string, quote string")
    r = upserts.accumulate_edges(df).head()
    assert (r.start_date, r.evidence_chunk_ids, r.evidence_quote) == (DAY(2020, 1, 1), ["c1", "c2"], "q0")
    merged = upserts.merge_accumulated(upserts.accumulate_edges(df.where("chunk_id = 'c2'")), upserts.accumulate_edges(df.where("chunk_id = 'c1'"))).head()
    assert (merged.start_date, merged.evidence_chunk_ids, merged.evidence_quote) == (DAY(2020, 1, 1), ["c2", "c1"], "q2")


def test_first_disclosure(spark):
    rows = [
        (1, "T", "Rev", "2020-01-01", "12/31/2020", 5.0, "USD", "b", "2021-03-01", "10-K"), (1, "T", "Rev", "2020-01-01", "2020-12-31", 6.0, "USD", "a", "2022-03-01", "10-K"),
        (1, "T", "Rev2", "2020-10-01", "2020-12-31", 7.0, "USD", "c", "2020-03-01", "10-K"), (1, "T", "Rev", None, "2020-12-31", 8.0, "USD", "c", "2020-03-01", "10-K"),
        (1, "T", "Rev", "2020-01-01", "2020-12-31", 9.0, "EUR", "d", None, "20-F"), (1, "T", "Rev", "2020-01-01", "2020-12-31", 9.0, "USD", "d", "2019-01-01", "10-Q"),
    ]
    df = spark.createDataFrame(rows, "cik long, ticker string, concept string, period_start string, period_end string, val double, unit string, accn string, filed string, form string")
    found = facts.curated_metrics(df, spark.createDataFrame([("revenue", "Rev"), ("revenue", "Rev2")], "metric string, concept string"))
    assert values(found, "unit", "val", "accn") == [("EUR", 9.0, "d"), ("USD", 5.0, "b")]


def test_scope(spark):
    rows = [(f"{a}:{s}", "T", f, d, a, s) for f, d, a in [("10-K", "2020", "a1"), ("10-K", "2021", "a2"), ("10-K", "2022", "a3"), ("10-Q", "2022", "q1"), ("10-Q", "2021", "q2")] for s in ("I.1", "I.1A")]
    df = spark.createDataFrame(rows + rows[:2], "chunk_id string, ticker string, form string, filing_date string, accession_no string, section_id string")
    assert values(scopes.chunk_scope(df), "chunk_id") == ["a2:I.1A", "a3:I.1", "a3:I.1A", "q2:I.1", "q2:I.1A"]


def trails(edges, anchors, hops):
    """Edges on undirected paths that use no edge twice, by enumeration."""
    found = set()

    def walk(at, used):
        for i, (s, r, d) in enumerate(edges):
            if i not in used and at in (s, d):
                found.add((s, r, d))
                if len(used) + 1 < hops:
                    walk(d if at == s else s, used | {i})

    for a in anchors:
        walk(a, frozenset())
    return found


def test_k_hop_equals_trail_enumeration(spark):
    r = random.Random(5)
    for hops in (1, 2, 3):
        edges = list({(r.randrange(7), r.choice("AB"), r.randrange(7)) for _ in range(9)})
        df = spark.createDataFrame(edges, "src int, rel string, dst int")
        got = {tuple(x) for x in graph.k_hop_edges(df, spark.createDataFrame([(0,), (3,)], "node int"), hops).collect()}
        assert got == trails(edges, (0, 3), hops)


def test_paths_and_reach(spark):
    df = spark.createDataFrame([(1, "R", 2), (2, "R", 3), (1, "R", 4), (4, "R", 3), (3, "R", 5), (9, "R", 9)], "src long, rel string, dst long")
    goal = spark.createDataFrame([(5,)], "node long")
    found = graph.shortest_path(df, F.lit(1).cast("long"), goal).head()
    assert (found.path, found.length) == ([1, 2, 3, 5], 3)
    assert graph.shortest_path(df, F.lit(9).cast("long"), goal).count() == 0
    assert values(graph.reaching(df, spark.createDataFrame([(5,), (1,)], "node long"), 2), "target", "sources") == [(1, 0), (5, 3)]
    assert values(graph.nodes_within(df, spark.createDataFrame([(1,)], "node long"), 2), "node", "distance") == [(1, 0), (2, 1), (3, 2), (4, 1)]


def test_mentions(spark):
    entities = spark.createDataFrame([(1, "Nvidia", ["NVDA", "nvidia corp."]), (2, "AMD", None), (3, "C++ Works", [])], "entity_id long, name string, aliases array<string>")
    texts = spark.createDataFrame([("a", "NVIDIA's chips; AMDahl"), ("b", "énvidia"), ("c", "amd, and c++ works"), ("d", None)], "chunk_id string, text string")
    assert values(mentions.mentioned(texts, entities), "chunk_id", "entity_id") == [("a", 1), ("c", 2), ("c", 3)]
    questions = spark.createDataFrame([(1, "What of Nvidia?"), (2, "What else?")], "question_id int, question string")
    assert values(mentions.anchors(questions, entities, default=2), "question_id", "name") == [(1, "Nvidia"), (2, "AMD")]


def test_mentions_by_words_are_the_same(spark, monkeypatch):
    entities = spark.createDataFrame([(1, "Nvidia", ["NVDA", "x_y"]), (2, "Ångström & Co", ["a.b"]), (3, "...", [])], "entity_id long, name string, aliases array<string>")
    texts = spark.createDataFrame([("a", "nvda nvdas x_y"), ("b", "ÅNGSTRÖM & CO, a.b"), ("c", "aXb NVDA_"), (None, "nvda"), ("a", "a.b"), ("e", "")], "chunk_id string, text string")
    one = values(mentions.mentioned(texts, entities), "chunk_id", "entity_id")
    assert one == [("a", 1), ("a", 2), ("b", 2)] and mentions.mentioned(texts, entities.limit(0)).count() == 0
    monkeypatch.setattr(mentions, "AUTOMATON_LETTERS", 0)
    assert values(mentions.mentioned(texts, entities), "chunk_id", "entity_id") == one


def test_edges_of_unnamed_nodes_are_kept(spark):
    edges, names = spark.createDataFrame([(1, "R", 2), (1, "R", 9)], "src long, rel string, dst long"), spark.createDataFrame([(1, "a"), (2, "b")], "cik long, name string")
    assert {(r.src_name, r.dst_name) for r in graph.labelled(edges, names, key="cik", name="name").collect()} == {("a", "b"), ("a", None)}


def test_cooccurrence_takes_the_first_topic(spark):
    companies = spark.createDataFrame([(1, "our GPU and accelerator sales are on the entity list"), (2, "nothing")], "cik long, text string")
    rules = spark.createDataFrame([("r", "Additions to the Entity List; advanced computing", ""), ("s", "Advanced Computing rule", "")], "rule_id string, title string, text string")
    found = mentions.cooccurrences(companies, rules, mentions.TOPICS)
    assert values(found, "cik", "rule_id", "topic") == [(1, "r", "entity list"), (1, "s", "advanced computing")]


def test_resolution(spark):
    entities = spark.createDataFrame([(1, "Nvidia", "NVDA", ["NVIDIA Corporation"]), (2, "TSMC", None, ["Taiwan Semiconductor Manufacturing Company Limited"])], "entity_id long, name string, ticker string, aliases array<string>")
    names = spark.createDataFrame([("nvidia corp",), ("Taiwan Semiconductor Manufacturng",), ("Inc.",), ("Intel",), (None,)], "raw string")
    assert dict(values(resolution.resolve(names, entities), "raw", "canonical")) == {"nvidia corp": "Nvidia", "Taiwan Semiconductor Manufacturng": "TSMC", "Inc.": None, "Intel": None}
    rel = "array<struct<source_entity:string,relation:string,target_entity:string,evidence_quote:string>>"
    records = spark.createDataFrame([(1, "c", "NVDA", [("we", "R", "TSMC", "q"), ("Nvidia", "R", "our", "q"), ("Nvidia", "R", "Intel", "q")])], f"record_no long, chunk_id string, ticker string, relations {rel}")
    rows = resolution.resolved_relations(records, entities)
    assert values(rows, "rel_pos", "src", "dst", "kept") == [(0, "Nvidia", "TSMC", True), (1, "Nvidia", "Nvidia", False), (2, "Nvidia", None, False)]
    assert resolution.resolution_report(rows).count() == 2
    assert values(resolution.unresolved_names(rows), "name", "n") == [("Intel", 1)]


def test_resolution_is_that_of_all_aliases(spark):
    from difflib import SequenceMatcher

    r = random.Random(2)
    known = ["".join(r.choice("abcde ") for _ in range(r.randrange(4, 14))).strip() or "a" for _ in range(80)]
    typed = ["".join(c for c in r.choice(known) if r.random() > 0.06) + r.choice(["", "", "e"]) for _ in range(120)]
    entities = spark.createDataFrame([(i, k, []) for i, k in enumerate(known)], "entity_id long, name string, aliases array<string>")
    lookup = sorted((x.alias, x.name) for x in resolution.alias_lookup(entities).collect())
    raw = spark.createDataFrame([(t,) for t in typed], "raw string").withColumn("a", resolution.comparable_name(F.col("raw")))
    want = {}
    for x in raw.collect():
        ratios = [(SequenceMatcher(None, x.a, alias).ratio(), -i, name) for i, (alias, name) in enumerate(lookup)]
        exact = dict(lookup).get(x.a)
        want[x.raw] = exact or (max(ratios)[2] if x.a and max(ratios)[0] >= 0.9 else None)
    assert dict(values(resolution.resolve(raw.select("raw"), entities), "raw", "canonical")) == want


def test_lineages_do_not_hang_on_lengths(spark):
    r = random.Random(3)
    vectors = [[r.gauss(0, 1) for _ in range(5)] for _ in range(60)]
    longer = [[x * f for x in v] for v in vectors for f in [r.uniform(0.01, 90)]]
    assert temporal.greedy_lineages(vectors, 0.6).tolist() == temporal.greedy_lineages(longer, 0.6).tolist()


def test_search_in_blocks(spark):
    r = random.Random(4)
    items = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(50)], "id int, embedding array<double>")
    queries = items.where("id < 9").select(F.col("id").alias("q"), "embedding")
    rows = lambda **x: values(vector_search.top_k_each(items, queries, 3, key="id", query_key="q", **x), "q", "id", "rank")
    assert rows() == rows(block_bytes=200) and len(rows()) == 27


def plain_lineages(vectors, threshold):
    groups = []
    for v in vectors:
        best, most = None, 0.0
        for g in groups:
            c = np.mean(g, axis=0)
            s = float(v @ (c / np.linalg.norm(c)))
            if s > most:
                best, most = g, s
        if best is not None and most >= threshold:
            best.append(v)
        else:
            groups.append([v])
    return [next(i for i, g in enumerate(groups) if any(x is v for x in g)) for v in vectors]


def test_lineages_equal_a_plain_loop():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(80, 4))
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = list(v)
    assert temporal.greedy_lineages(v, 0.75).tolist() == plain_lineages(rows, 0.75)
    assert temporal.greedy_lineages(np.array([[1.0, 0.0], [0.75, 0.6614378]]), 0.75).tolist() == [0, 0]


def test_temporal_states(spark):
    e = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, "r1", "a", "x", e[0], DAY(2020, 1, 1)), (1, "r2", "b", "x", e[0], DAY(2021, 1, 1)), (1, "r3", "a", "y", e[1], DAY(2020, 1, 1)), (2, "r4", "z", "y", e[1], DAY(2020, 1, 1)), (2, "r5", "z", "y", None, DAY(2020, 1, 1))]
    risks = spark.createDataFrame(rows, "cik long, risk_id string, accession_no string, summary string, embedding array<float>, filing_date date")
    found = temporal.lineages(risks)
    states = temporal.states(found.join(risks.drop("cik", "filing_date", "embedding"), "risk_id"))
    assert values(states, "risk_id", "lineage_id", "status", "end_date") == [("r1", "1:0", "Active", None), ("r2", "1:0", "Active", None), ("r3", "1:1", "Deleted", DAY(2021, 1, 1)), ("r4", "2:0", "Active", None)]
    assert values(temporal.active_lineages(states, F.lit("2020-06-01").cast("date")), "cik", "active_lineages") == [(1, 2), (2, 1)]
    assert values(temporal.active_lineages(states, F.lit("2021-01-01").cast("date")), "cik", "active_lineages") == [(1, 1), (2, 1)]
    assert values(temporal.dropped(states), "lineage_id", "example") == [("1:1", "y")]
    assert {r.n for r in temporal.violations(states).collect()} == {0}
    assert values(temporal.newest(states), "risk_id") == ["r4"]


ELEMENTS = "accession_no string, form string, element_index int, element_type string, text string"


def test_item_segmentation(spark):
    rows = [
        ("TextElement", "cover"), ("TitleElement", "PART I"), ("TopSectionTitle", "Item 1. Business"), ("TextElement", "we make"), ("TitleElement", "Item 1A. Risk Factors"),
        ("PageNumberElement", "7"), ("TextElement", "risky"), ("TitleElement", "Part II"), ("TextElement", "still risky"), ("TitleElement", "ITEM 7: MD&A"), ("TextElement", "results"), ("TextElement", "  "),
    ]
    df = spark.createDataFrame([("d", "10-K", i, k, t) for i, (k, t) in enumerate(rows)], ELEMENTS)
    found = sections.by_items(df).orderBy("element_index").collect()
    assert [(r.section_id, r.text) for r in found] == [("I.1", "we make"), ("I.1A", "risky"), ("I.1A", "still risky"), ("II.7", "results")]


def test_fallback_segmentation(spark):
    rows = [
        ("TitleElement", "Item 17 ☐ 18 ☐"), ("TextElement", "junk"), ("TextElement", "Risk Factors44"), ("TextElement", "a risk"), ("PageHeaderElement", "Risk factors (continued)"), ("TextElement", "more risk"),
        ("TextElement", "Available Information112"), ("TextElement", "elsewhere"), ("PageHeaderElement", "MD&A58"), ("TextElement", "results"), ("PageHeaderElement", "Other"), ("TextElement", "gone"),
    ]
    df = spark.createDataFrame([("d", "10-K", i, k, t) for i, (k, t) in enumerate(rows)] + [("e", "10-K", 0, "TitleElement", "Item 1. Business"), ("e", "10-K", 1, "TextElement", "fine")], ELEMENTS)
    found = sections.segmented(df).orderBy("accession_no", "element_index").collect()
    assert [(r.section_id, r.text) for r in found] == [("I.1A", "a risk"), ("I.1A", "more risk"), ("II.7", "results"), ("I.1", "fine")]


def test_html_elements(spark):
    page = "<html><head><style>x</style></head><body><h1>Item 1. Business</h1><p>We make <b>chips</b>.</p><table><tr><td>a</td><td>1</td></tr></table><div>End &amp; out</div></body></html>"
    df = spark.createDataFrame([("d", page), ("e", None)], "accession_no string, html string")
    found = sections.html_elements(df).orderBy("element_index").collect()
    assert [(r.element_type, r.text) for r in found] == [("TitleElement", "Item 1. Business"), ("TextElement", "We make chips."), ("TableElement", "| a | 1"), ("TextElement", "End & out")]


def test_chunks(spark):
    words = "one two three four five six seven eight nine ten"
    long = "  ".join(f"Sentence {i} has quite a few words in it." for i in range(20))
    rows = [("TitleElement", "Heading"), ("TextElement", words), ("TextElement", words), ("TableElement", "| a |"), ("TextElement", words), ("TextElement", long), ("TextElement", "short")]
    df = spark.createDataFrame([("d", "s", "t", i, k, t) for i, (k, t) in enumerate(rows)], "accession_no string, section_id string, section_title string, element_index int, element_type string, text string")
    found = sections.chunks(df, target=20, most=40).orderBy("chunk_id").collect()
    assert [r.kind for r in found][:3] == ["prose", "table", "prose"]
    assert found[0].n_tokens == 20 and found[0].sub_heading == "Heading" and found[0].chunk_id == "d:s:0000"
    assert all(r.n_tokens <= 40 for r in found)
    assert sections.misplaced(sections.chunks(df, target=20, most=40), sections.section_texts(df)).count() == 0
    assert " ".join(r.text for r in found if r.text.startswith("Sentence")).split() == long.split()
    assert sections.chunks(df.limit(0)).count() == 0


def replay(events, most, window):
    accepted, out = {}, {}
    for key, t, i in sorted(events, key=lambda e: (e[1], e[2])):
        q = accepted.setdefault(key, deque())
        while q and t - q[0] > window:
            q.popleft()
        out[i] = most <= 0 or len(q) < most
        if out[i] and most > 0:
            q.append(t)
    return out


def test_rate_limit(spark):
    r = random.Random(1)
    events = [(f"u{r.randrange(3)}", r.randrange(200), i) for i in range(120)]
    base = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(k, base + datetime.timedelta(seconds=t), i) for k, t, i in events], "user string, ts timestamp_ntz, id int")
    for most in (0, 1, 4):
        got = limits.rate_limited(df, key="user", at="ts", most=most, window_seconds=30, order="id")
        assert dict(values(got, "id", "allowed")) == replay(events, most, 30)


def test_evaluation(spark):
    kind = "id string, system string, answer string, cited array<string>, hallucinated array<string>, judged boolean, supported int, total int, present int, needed int, verdicts array<boolean>, n_excerpts int"
    rows = [
        ("n", "s", "about $60.9 billion", ["a"], [], None, 3, 4, 1, 2, [True, False], 2), ("r", "s", "No information on that.", [], [], None, None, None, None, None, [], 0),
        ("d", "s", "It is tsmc.", ["a"], ["a"], None, 0, 0, 0, 0, [True], 2), ("j", "s", "hm", [], [], None, None, None, None, None, None, 0),
    ]
    bench = spark.createDataFrame([("n", "numeric", 60.922e9, None), ("r", "refusal", None, None), ("d", "dependency", None, ["TSMC"]), ("j", "risk", None, None)], "id string, type string, value double, any_of array<string>")
    scores = evaluation.scored(spark.createDataFrame(rows, kind), bench)
    got = {r.id: r for r in scores.collect()}
    assert [got[i].correct for i in "nrdj"] == [True, True, True, None]
    assert (got["n"].faithfulness, got["n"].context_recall, got["n"].context_precision) == (0.75, 0.5, 0.5)
    assert (got["d"].faithfulness, got["d"].context_recall, got["d"].context_precision, got["d"].citation_ok) == (1.0, 1.0, None, False)
    failed = evaluation.failures(scores, spark.createDataFrame(rows, kind))
    assert values(failed, "id", "label", "mechanical") == [("d", "FORMAT_OR_CITATION", True), ("n", "OTHER", False)]
    judged = evaluation.failures(scores, spark.createDataFrame(rows, kind), judge=lambda batch: batch["id"].map({"n": "UNGROUNDED_CLAIM"}))
    assert ("n", "UNGROUNDED_CLAIM", False) in values(judged, "id", "label", "mechanical")


def test_model_calls(spark):
    assert model_calls.first_object('x {"a": "}{", "b": {"c": 1}} y') == '{"a": "}{", "b": {"c": 1}}'
    assert model_calls.fenced("```json\n{}\n```") == "{}"
    budgets, replies = [], iter([model_calls.Truncated(), "no json", '{"a": 1}'])

    def ask(prompt, budget):
        budgets.append((budget, "did not fit" in prompt))
        said = next(replies)
        if isinstance(said, Exception):
            raise said
        return said

    assert model_calls.structured("p", ask, lambda d: d, sleep=lambda s: None) == {"a": 1}
    assert budgets == [(4000, False), (8000, False), (8000, True)]
    rows = spark.createDataFrame([([1, 2], [True, False]), ([1, 2], [False])], "relations array<int>, verdicts array<boolean>")
    assert values(model_calls.with_verdicts(rows), "relations") == [[1, 2], [1]]


def test_context_blocks(spark):
    kinds = {
        "edges": "source string, relation string, target string, status string, quote string, chunk_ids array<string>", "metrics": "company string, metric string, val double, unit string, period_start date, period_end date",
        "risks": "company string, category string, summary string, chunk_id string, score double", "temporal": "company string, lineage string, first_seen date, last_seen date, example string",
        "chunks": "chunk_id string, score double, text string, source_url string",
    }
    layers = {n: spark.createDataFrame([], k) for n, k in kinds.items()}
    blocks, ids = retrieval.context(layers)
    assert blocks.count("(none)") == 5 and not ids
    layers["edges"] = spark.createDataFrame([("A", "R", "B", "Active", "q", ["0-1:I.1:0001", "0-1:I.1:0002"]), ("A", "R", "C", None, None, None)], kinds["edges"])
    layers["metrics"] = spark.createDataFrame([("A", "revenue", 60922e6, "USD", DAY(2023, 1, 30), DAY(2024, 1, 28))], kinds["metrics"])
    blocks, ids = retrieval.context(layers)
    assert "- A R B (status=Active) [0-1:I.1:0001] [0-1:I.1:0002]" in blocks and "60,922,000,000 USD" in blocks and len(ids) == 2
    said = retrieval.answer("q", layers, lambda prompt: "yes [0-1:I.1:0001] and [9-9:I.1:0009]")
    assert said.hallucinated == ["9-9:I.1:0009"]
    events = list(retrieval.answer_events("q", layers, lambda prompt: iter(["a", "b"])))
    assert [e["event"] for e in events] == ["retrieval", "delta", "delta", "done"]


def test_schemas(spark):
    for ddl in [*schemas.LAKE.values(), *schemas.EDGES.values(), *schemas.SERVICE.values(), *(d for _, d in schemas.NODES.values())]:
        assert schemas.empty(spark, ddl).count() == 0
    df = schemas.conform(spark.createDataFrame([("t", 1)], "ticker string, junk int"), schemas.LAKE["manifest"])
    assert df.columns[0] == "ticker" and "junk" not in df.columns
    bad = schemas.key_violations(spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "k string"), "k")
    assert bad.count() == 2
