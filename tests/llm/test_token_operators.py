import pytest
from pyspark.sql import functions as F

from evistrata.llm import bpe, budget, encoding, mixing, splitting

TEXTS = [(1, "a plain text", "x"), (2, "", "x"), (3, None, "y"), (4, "<|endoftext|>", "y"), (5, "word " * 3000, "y"), (5, "word " * 3000, "y"), (None, "no key", "z")]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string, key string")


def test_encode(spark, texts):
    got = {r.doc_id: r.ids for r in encoding.encode(texts).collect()}
    assert got[2] == got[3] == [] and got[4] == bpe.encoder().ids("<|endoftext|>") and len(got[5]) == bpe.counter().count("word " * 3000)
    assert encoding.encode(texts).count() == 7 and encoding.encode(texts.limit(0)).count() == 0
    assert dict(encoding.encode(texts).dtypes) == {"doc_id": "bigint", "ids": "array<int>"}


def test_suspect_counts(spark):
    n = bpe.counter().count("one two three four")
    rows = [("ok", n, "one two three four"), ("twice", 2 * n, "one two three four"), ("more", 2 * n + 1, "one two three four"), ("half", n // 2, "one two three four"), ("less", n // 2 - 1, "one two three four"),
            ("null", None, "x"), ("zero", 0, "x"), ("minus", -1, "x"), ("minus", -1, "x"), ("empty", 3, ""), ("void", 1, None), (None, None, "x")]
    df = spark.createDataFrame(rows, "chunk_id string, n_tokens long, text string")
    assert sorted(r.chunk_id for r in budget.suspect_counts(df).collect()) == ["empty", "less", "minus", "more", "null", "void", "zero"]
    assert budget.suspect_counts(df.limit(0)).count() == 0


def test_totals(spark):
    rows = [("a", "t ", "Form 10-k", "one two", 2, 1), ("a", "T", "10-K", "one two", 2, 2), ("b", "t", "10K", "three", 1, 1), ("c", None, None, None, None, 1), (None, "t", "10-K", "x", 1, 1)]
    df = spark.createDataFrame(rows, "chunk_id string, ticker string, form string, text string, n_tokens long, at int")
    groups = {"ticker": budget.tidy_ticker(F.col("ticker")), "form": budget.tidy_form(F.col("form"))}
    found = {(r.ticker, r.form): (r["items"], r.tokens, r.unusable_counts) for r in budget.totals(df, key="chunk_id", groups=groups, stored=F.col("n_tokens"), latest=F.col("at")).collect()}
    assert found == {("T", "10-K"): (2, 3, 0), (None, None): (1, 0, 1)}


def test_tidy(spark):
    row = spark.range(1).select(
        budget.tidy_code(F.lit(" Annual-Reports ")).alias("a"), budget.tidy_lang(F.lit("de-DE")).alias("b"), budget.tidy_form(F.lit("10-k/A")).alias("c"), budget.tidy_code(F.lit("  ")).alias("d"), budget.tidy_form(F.lit("Form 20F")).alias("e")
    ).head()
    assert tuple(row) == ("annual_reports", "de", "10-K/A", None, "20-F")


PROSE = "\n\n".join(" ".join(f"Sentence {i}-{j} tells of the quarter and of the plant in some detail." for j in range(9)) for i in range(40))
TABLE = "\n".join(f"| Row {i} | {i * 37} | {i * 91} |" for i in range(400))


@pytest.mark.parametrize("text", [PROSE, TABLE, "a" * 60_000, "あ" * 4_000, " " * 40_000, "word " * 4_000, "\n" * 8_000, PROSE.replace(" ", "　")])
def test_pieces(text):
    counter = bpe.counter()
    pieces = splitting.split(text)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (a, b, n, shared), before in zip(pieces, [None, *pieces]):
        assert n == counter.count(text[a:b]) <= splitting.CAP
        if before:
            assert before[0] < a < before[1] < b and 90 <= shared <= 140


def test_cuts_are_natural_and_local():
    natural = [splitting._level(PROSE, b) for _, b, *_ in splitting.split(PROSE)]
    assert min(natural) >= 2
    assert all(TABLE[b - 1] == "\n" or TABLE[b : b + 1] == "\n" for _, b, *_ in splitting.split(TABLE)[:-1])
    edited = PROSE[:9_000] + "An inserted sentence. " + PROSE[9_000:]
    before, after = ({t[a:b] for a, b, *_ in splitting.split(t)} for t in (PROSE, edited))
    assert len(before - after) <= 4 and len(before & after) >= len(before) - 4


def test_split_oversized(spark):
    rows = [("big", "I.1", PROSE, "x"), ("big", "I.1", PROSE, "x"), ("small", "I.1", "short", "x"), ("none", None, None, "x"), ("empty", "I.1", "", "x"), ("edge", "I.1", " word" * 1100, "x"), ("over", "I.1", " word" * 1101, "x")]
    df = spark.createDataFrame(rows, "chunk_id string, section_id string, text string, piece string")
    pieces = splitting.distinct_pieces(splitting.split_oversized(df)).collect()
    assert {r.chunk_id for r in pieces} == {"big", "over"}
    assert all(r.piece == {"big": PROSE, "over": " word" * 1101}[r.chunk_id][r.piece_from : r.piece_to] for r in pieces)
    big = sorted(r.piece_no for r in pieces if r.chunk_id == "big")
    assert big == list(range(len(big))) == list(range(pieces[0].n_pieces)) if pieces[0].chunk_id == "big" else big
    assert splitting.split_oversized(df.limit(0)).count() == 0


def test_mix(spark):
    rows = [(i, "A-reports", "one two three four five") for i in range(400)] + [(1000 + i, "b_notes ", "six seven") for i in range(50)] + [(2000, "c", None), (2001, None, "x"), (2002, "other", "x"), (3000, "A_REPORTS", "")]
    documents = spark.createDataFrame(rows + rows[:3], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a_reports", 0.5, 2), ("b_notes", 0.5, 3), ("c", 0.1, 2), ("d", 0.0, None)], "source string, target_share double, max_repeats int")
    found = mixing.mix(documents, targets, total_tokens=3_000)
    used, plan = found.documents.collect(), {r.source: r for r in found.plan.collect()}
    a, b = plan["a_reports"], plan["b_notes"]
    assert a.available_tokens == 2000 and b.available_tokens == 100
    assert 0 <= a.wanted_tokens - a.used_tokens < 5 and b.used_tokens == 300 and b.most_copies == 3
    assert plan["c"].used_tokens == plan["d"].used_tokens == 0
    assert abs(sum(r.actual_share for r in plan.values()) - 1) < 1e-9
    assert sum(r.copies * r.n_tokens for r in used if r.source == "a_reports") == a.used_tokens
    assert len(used) == len({r.doc_id for r in used})
    smaller = {r.doc_id for r in mixing.mix(documents, targets, total_tokens=1_000).documents.collect() if r.source == "a_reports"}
    assert smaller <= {r.doc_id for r in used}
    assert mixing.mix(documents.limit(0), targets).documents.count() == 0 and mixing.mix(documents, targets.limit(0)).plan.count() == 0


def test_mix_of_equal_tokens_is_exact(spark):
    """Against a plain sum over documents in the order of their hash."""
    documents = spark.createDataFrame([(i, "s", "one two three four five six seven"[: 3 + 4 * (i % 8)]) for i in range(3000)], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int")
    found = mixing.mix(documents, targets, total_tokens=5_000)
    used = {r.doc_id for r in found.documents.collect()}
    order = documents.select("doc_id", mixing.spot(F.col("doc_id")).alias("spot"), budget.token_count(F.col("text")).alias("n")).orderBy("spot").collect()
    total, want = 0, set()
    for r in order:
        if total + r.n > 5_000:
            break
        total += r.n
        want.add(r.doc_id)
    assert used == want
