import random

import pytest
from pyspark.sql import functions as F

from evistrata.llm import names, survivors, truncation

FACT = "fact_id long, cik long, concept string, unit string, period_start string, period_end string, val double, accn string, fp string, filed string, frame string, value string"
MAP = [("revenue", "NetRevenueTotal"), ("revenue", "TurnoverNet")]


def fact(i, concept="TurnoverNet", unit="USD", start="2020-01-01", end="2020-12-31", val=1.0, accn="0001-21-000001", fp="FY", filed="2021-02-01", frame="CY2020", cik=1):
    return (i, cik, concept, unit, start, end, val, accn, fp, filed, frame, "clash")


def survived(spark, rows):
    found = survivors.field_survivors(spark.createDataFrame(rows, FACT), spark.createDataFrame(MAP, "metric string, concept string"))
    return {(r.group_id, r.field_name): r.fact_id for r in found.collect()}


def test_groups_in_any_notation(spark):
    rows = [fact(7), fact(3, concept="us-gaap:net_revenue_total", unit="iso4217:usd", end="12/31/2020", filed="20220301", accn="n/a", frame="unknown"), fact(5, end="Dec 31, 2020", filed="2021-06-01T00:00:00Z", val=None, start=" "), fact(9, unit="EUR"), fact(11, concept="Other")]
    assert survived(spark, rows) == {(3, "concept"): 3, (3, "period_start"): 3, (3, "val"): 3, (3, "accn"): 5, (3, "frame"): 5}


def test_ties_and_missing(spark):
    rows = [fact(2, filed=None, accn="9"), fact(1, filed="bad", accn="0000000009"), fact(4, frame=None), fact(6, frame="", cik=2), fact(8, frame="unknown", cik=2)]
    got = survived(spark, rows)
    assert got[(1, "val")] == 4 and got[(1, "frame")] == 1
    assert (6, "frame") not in got and got[(6, "val")] == 6
    assert survived(spark, []) == {} and survived(spark, [fact(1), fact(1)]) == {} and survived(spark, [fact(None), fact(2)]) == {}


@pytest.mark.parametrize("seed", range(2))
def test_survivors_by_brute_force(spark, seed):
    r = random.Random(seed)
    rows = [fact(i, cik=r.choice([1, 2, None]), val=r.choice([None, 1.0, 2.0]), accn=r.choice([None, "n/a", "0001-20-3", "000120 4"]), filed=r.choice([None, "2020-01-01", "2021-01-01"]), frame=r.choice(["", "unknown", "x"])) for i in range(60)]
    want = {}
    for cik in (1, 2, None):
        group = [x for x in rows if x[1] == cik]
        for name, at in (("concept", 2), ("period_start", 4), ("val", 6), ("accn", 7), ("frame", 10)):
            held = [x for x in group if x[at] not in (None, "", "n/a", "unknown")]
            code = lambda x: "".join(c for c in x[7] or "" if c.isdigit()) if x[7] != "n/a" else ""
            if held:
                best = max(held, key=lambda x: (x[9] or "", code(x), -x[0]))
                want[(min(x[0] for x in group), name)] = best[0]
    assert survived(spark, rows) == want


WHOLE = [
    "The quarter ended well and nothing else happened.", "Is this the end of the text?", "He said “no further questions.”", "A closing note in brackets (see above.)", "これは完全な文であり、問題はありません。",
    "A line.\n\n| Total | 14,207 | 13,881 |", "A text that is over.</p>", "<p>A text that is <b>over</b>.</p>", "All sales were made in cash and paid at once.   \n\t", "Sentence one is fine.\n\n* * *", "Sentence one is fine.\n\n- wafer starts per month",
    "Sentence one is fine.\n\n(Signature page follows)", "short",
]
CUT = [
    "The quarter ended well and nothing el", "The quarter ended well and…", "The quarter ended well and [...]", "The quarter ended well [truncated]", "The quarter ended well and some (more)", "これは完全な文であり、問題は", "A line.\n\n| Total | 14,207 | 13,",
    "A text that is over.</", "<p>A text that is over and then", "A text with R&am", "All sales were made in cas   \n", "The total came to $45.", "All sales of the year, including", "A byte was cut here as well �",
]


@pytest.mark.parametrize("text", WHOLE)
def test_whole(text):
    assert truncation.ending(text)[0] in ("whole", "looks") or len(text) < truncation.LEAST


@pytest.mark.parametrize("text", CUT)
def test_cut(text):
    assert truncation.ending(text)[0] in ("cut", "line")  # a line is cut unless the corpus knows it


def test_truncations(spark):
    rows = [(i, "News", f"Report {i} says that all went well in the year.\n\nLiquidity\nand more of the same follows here.") for i in range(6)]
    rows += [(10, "news ", "All of it is fine here.\n\nLiquidity"), (11, "news", "All of it is fine here.\n\nIn the territory ser"), (12, None, None), (13, "x", ""), (14, "x", "tiny tex"), (15, "x", "w " * 50_000 + "and th"), (15, "x", "w " * 50_000 + "and th"), (None, "x", "no key at all he")]
    found = {r.doc_id: r.is_cut for r in truncation.truncations(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert {k for k, v in found.items() if v} == {11, 15} and found[10] is False and found[14] is False
    assert truncation.truncations(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0


def test_copies_and_masked_ends_do_not_hide_cuts(spark):
    r = random.Random(3)
    body = lambda i, n: f"Report {i} says that all went well. ".ljust(n, "x")
    rows = [(i, "copies", "All of it is fine here.\n\nUntil the Geskiong line is requa") for i in range(40)]
    rows += [(100 + i, "dates", f"Text {i} is over.\n\nDated: September {i + 1}, 2020") for i in range(6)]
    rows += [(110, "dates", "Another text is over.\n\nDated: September 12, 20"), (111, "dates", "Another text is over.\n\nDated: May 12, 2021")]
    rows += [(200 + i, "limit", body(i, r.randrange(150, 900)) + ".\n\nSigned: Anna Smith") for i in range(300)]
    rows += [(600 + i, "limit", body(i, 500)) for i in range(60)] + [(700, "limit", body(700, 485) + ".\n\nSigned: Anna")]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert frame.where("doc_id = 700 AND length(text) = 500 OR doc_id = 600 AND length(text) = 500").count() == 2
    cut = {x.doc_id for x in truncation.truncations(frame.union(spark.createDataFrame([(701, "other", "A text.\n\nSigned: Anna"), (702, "other", "B text.\n\nSigned: Berta"), (703, "other", "C text.\n\nSigned: Carla")], frame.schema))).where("is_cut").collect()}
    assert set(range(40)) <= cut and 110 in cut and 700 in cut
    assert not cut & {*range(100, 106), 111, 701, 702, 703}


HEADINGS = ["Risk factors", "Results of operations", "Liquidity and capital", "Notes to the accounts"]
SUBJECTS, VERBS = ["The quarter", "Our plant", "Revenue of the segment", "A new supplier", "The customer"], ["was delayed by", "depends on", "fell because of", "is limited to", "was raised for"]
OBJECTS = ["weeks of transit", "orders from the north", "a warranty claim", "the price of copper", "export licences"]


def reports(n, seed, start=0):
    """Texts of headings and sentences, of which some end with a heading and a few stop anywhere; with the true ones."""
    r, rows, cut = random.Random(seed), [], set()
    for i in range(start, start + n):
        text = "\n\n".join(
            r.choice(HEADINGS) + "\n" + " ".join(f"{r.choice(SUBJECTS)} {r.choice(VERBS)} {r.choice(OBJECTS)} in {r.randrange(2001, 2025)}." for _ in range(r.randrange(1, 5))) for _ in range(r.randrange(2, 5))
        )
        if i % 10 == 0:
            text += "\n\n" + r.choice(HEADINGS)
        elif i % 17 == 0:
            # Inside a word of a sentence.
            places = [k for k in range(60, len(text) - 1) if text[k - 1].islower() and text[k].islower() and text[text.rfind("\n", 0, k) + 1 :].split("\n")[0] not in HEADINGS]
            text = text[: r.choice(places)]
            cut.add(i)
        rows.append((i, "reports", text))
    return rows, cut


def judged(spark, rows):
    found = truncation.truncations(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert all(x.is_cut == (x.at_limit or x.in_transfer) and not (x.at_limit and x.in_transfer) for x in found)
    return {x.doc_id: x for x in found}


def test_verdicts_do_not_hang_on_the_size_of_the_corpus(spark):
    rows, cut = reports(400, 1)
    more, more_cut = reports(3_600, 2, 1_000)
    few, many = judged(spark, rows), judged(spark, rows + more)
    assert {i for i in range(400) if few[i].is_cut} == {i for i in range(400) if many[i].is_cut} == cut
    assert {i for i, x in many.items() if x.is_cut} == cut | more_cut


def test_cuts_at_a_limit_and_lines_seen_once(spark):
    rows, _ = reports(400, 3)
    fit = lambda i, n: f"Report {i} is about the plant. " + "Our plant depends on copper. " * n
    rows += [(2_000 + i, "feed", fit(i, 40)[: 500]) for i in range(60)]  # at the limit, cut inside a sentence
    rows += [(3_000 + i, "feed", fit(i, 5 + i % 10).strip()) for i in range(200)]
    last = "\nThe customer de"
    cut_line = [(4_000 + i, "feed", fit(i, 40)[: 500 - len(last)] + last) for i in range(3)]  # the same cut line in three texts at the limit
    copies = [(4_010 + i, "feed", cut_line[0][2]) for i in range(3)]  # and one of them stored three times more
    whole = [(4_100, "feed", fit(9, 40)[: 499] + "."), (4_101, "reports", "The customer depends on a warranty claim.\n\nGovernance matters"), (4_102, "reports", "Our plant is limited to export licences.\n\nZymurgy")]
    found = judged(spark, rows + cut_line + copies + whole)
    assert all(found[i].at_limit for i in [*range(2_000, 2_060), *range(4_000, 4_003), *range(4_010, 4_013)])
    assert not any(found[i].is_cut for i in [*range(3_000, 3_200), 4_100, 4_101, 4_102])
    report = {x.source: x for x in truncation.truncation_report(spark.createDataFrame(rows + copies, "doc_id long, source string, text string")).collect()}
    assert report["feed"].cut_at_limit == report["feed"].cut == 63 and report["feed"].cut_at_limit_share == pytest.approx(63 / 263) and report["reports"].cut_at_limit == 0


def test_length_limits(spark):
    r = random.Random(1)
    rows = [("a", "chars", min(512, 300 + int(r.expovariate(1 / 150)))) for _ in range(2000)] + [("b", "chars", 300 + int(r.expovariate(1 / 150))) for _ in range(2000)]
    found = truncation.length_limits(spark.createDataFrame(rows, "source string, unit string, length int"))
    assert [(x.source, x.length) for x in found.collect()] == [("a", 512)]


ENTITIES = [
    (1, "General Toviofop Optics", ["general toviofop optics s.a."]), (2, "Toviofop Storage", []), (3, "Skyzaltrult Robotics Networks", ["syrn", "glass compass"]), (4, "Hewipjen & Brypun Chemicals", ["hewipjen"]), (5, "Quybroadiv Laboratories", ["qyl"]),
    *[(10 + i, f"{head} {tail}", []) for i, (head, tail) in enumerate([(h, t) for h in ("Abcorvim", "Dextrolus", "Munhygs", "Pralomis", "Zeltarin", "Vorwexel", "Kriptofan") for t in ("Optics Networks", "Storage Devices", "Chemicals Robotics", "General Laboratories")])],
]


@pytest.fixture(scope="module")
def entities(spark):
    return spark.createDataFrame(ENTITIES, "entity_id long, name string, aliases array<string>")


VARIANTS = {
    "Gen. Toviofop Opt.": 1, "TOVIOFOP STORAGE LLC": 2, "Storage, Toviofop": 2, "Tovíofop Storage": 2, "T0viofop Storage": 2, "Toviofpo Storage": 2, "S.Y.R.N.": 3, "s-y-r-n": 3, "SYRN plc": 3, "Glass-Compass": 3, "SkyzaltrultRobotics Networks": 3,
    "Skyz altrult Robotics Networks": 3, "Networks of Skyzaltrult Robotics": 3, "The Hewipjen & Brypun Chems and its subsidiaries": 4, "Hewipjen group": 4, "QYL (Quybroadiv)": 5, "Quybroadiv Labs’s": 5, "Quybroadiv Laboratories [formerly listed]": 5,
    "Toviofop": None, "Toviofop Airways": None, "Skyzaltrult Pension Trust": None, "we": None, "the Company": None, " ": None, "": None, None: None, "Marolund Optics": None, "x" * 5000: None, "contract manufacturers": None,
}


def test_links(spark, entities):
    found = names.link_names(spark.createDataFrame([(v,) for v in VARIANTS] * 2, "text string"), entities)
    got = {r.text: r.entity_id for r in found.collect()}
    assert {v: got.get(v) for v in VARIANTS} == VARIANTS
    assert names.link_names(spark.createDataFrame([("x",)], "text string"), entities.limit(0)).head().entity_id is None


def test_mentions_and_exact(spark, entities):
    kind = "record_no long, relations array<struct<source_entity:string,relation:string,target_entity:string>>, text string"
    rows = [(1, [("Toviofop Storage ", "R", "Glass Compas"), (None, "R", "we")], "x"), (2, None, "x"), (3, [], "x")]
    found = names.linked_mentions(spark.createDataFrame(rows, kind), entities).collect()
    assert sorted((r.record_no, r.rel_pos, r.side, r.entity_id, r.is_exact) for r in found if r.entity_id) == [(1, 0, "source", 2, True), (1, 0, "target", 3, False)]
    assert len(found) == 4


@pytest.mark.parametrize("least", [0.25, 0.4, 0.8])
def test_similar_words_equals_all_pairs(least):
    r = random.Random(4)
    draw = lambda: "".join(r.choice("abcdef") for _ in range(r.randrange(1, 12)))
    left, right = sorted({draw() for _ in range(200)} | {"zz", "x" * 500}), sorted({draw() for _ in range(200)})
    lookup = names.Lookup(right, least)
    got = {(w, k) for w in left for k in lookup.similar(w)}
    sets = {w: set(names.grams(names.sight(w))) for w in left + right}
    want = {(a, b) for a in left for b in right if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9}
    assert got == want and names.Lookup([], least).similar("abc") == []


def test_words_of_other_organisations_are_compared_too(spark):
    """A typo that happens to be another organisation's word still leads to the right one."""
    known = [(1, "Marelund Optics Networks", []), (2, "Marolund Storage Devices", []), *[(10 + i, f"{h} {t}", []) for i, (h, t) in enumerate((h, t) for h in ("Abcorvim", "Dextrolus", "Munhygs") for t in ("Optics Networks", "Storage Devices"))]]
    found = names.link_names(spark.createDataFrame([("Marolund Optics Networks",), ("y" * 300,)], "text string"), spark.createDataFrame(known, "entity_id long, name string, aliases array<string>"))
    assert {r.text[:8]: r.entity_id for r in found.collect()} == {"Marolund": 1, "yyyyyyyy": None}


def test_edits():
    assert names.edits("abcd", "abdc", 2) == 1 and names.edits("abc", "xyz", 1) == 2 and names.edits("", "ab", 3) == 2
    assert names.short_for("mfg", "manufacturing") and names.short_for("nets", "networks") and not names.short_for("opt", "storage")


def test_column_expressions(spark):
    row = spark.range(1).select(*[survivors.as_date(F.lit(x)).cast("string").alias(f"c{i}") for i, x in enumerate(["2024-01-05", "20240105", "1/5/2024", "Jan 5, 2024", "2024-01-05T10:00:00Z", "5 January 2024", "n/a", "junk", "99999999"])]).head()
    assert list(row) == ["2024-01-05"] * 6 + [None] * 3
