"""Texts that were cut off by a field limit or in transfer (problem 10).

Field limits: the lengths of each source tell where it has one. The hazard of ending at exactly that
length, given that it is reached, is tested against the hazards of neighbouring lengths under
false-discovery control; a text is cut ``at_limit`` if its length is significant and its ending incomplete.

Transfers stop anywhere, which lengths cannot tell. A text is cut ``in_transfer`` if its end says so: by a
mark, by an unfinished row, mark-up or sentence, or by a last line that the corpus shows to be the
beginning of a sentence. Such lines are judged by how often random cuts, at the rate seen in this corpus,
would leave them, and by how their words are used in sentences and in closing lines and headings. Rates
and shares decide, no counts, so a corpus of another size gives the same verdicts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from evistrata.llm.budget import tidy_code
from evistrata.session import materialize

#: Texts of fewer characters are never cases.
LEAST = 20
#: Lengths to each side that a length's hazard is compared with, and the accepted rate of false limits.
NEIGHBOURS, FALSE_DISCOVERIES = 40, 0.01
#: Characters up to which a line without an end mark may be a heading or closing line.
LINE = 100
#: Words that a task counts before it passes them on.
WORDS = 200_000

_BLANK = " \t\r\n\x0b\x0c\xa0​‌‍⁠﻿　  \u0085    "
_MARK = re.compile(r"(?:\.{3,}|…|\[\s*(?:\.{3,}|…|truncated|cut|cut off|more|continued)\s*\]|\(\s*(?:more|truncated|cut|cut off|continued|\.{3,}|…)\s*\)|<(?:truncated|cut|more)>|�+)$", re.I)
_OPEN_TAG = re.compile(r"<[A-Za-z/!][^<>]{0,200}$|<$")
_OPEN_ENTITY = re.compile(r"&(?:[A-Za-z]{1,8}|#\d{0,6})$")
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)[^<>]*?(/?)>")
_VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "col", "area"}
_END = ".!?。！？｡‼⁉‽۔।"
_CLOSE = "\"'”’»›)]}）」』】》〉*_`"
_LABEL = re.compile(r"^([A-Z][\w /&’'-]{0,30}: )(.*)$")
_LOOKS = re.compile(r"^https?://\S+$|^/s/ \S|^Page \d+ of \d+$|^\W+$|^[(\[{].*[)\]}]$|^[“\"].*[”\"]$")
_NAME = re.compile(r"\b[^\W\d_a-z]\w+")
_ITEM = re.compile(r"^(?:[-*•–‣·▪]|\(?[0-9a-z]{1,3}[.)])\s+\S")
_DIGITS = re.compile(r"\d*$")
_GOES_ON = re.compile(r"[,;、，；(]$")
_HAN = "\u3040-\u30ff\u3400-\u9fff"
_WORD = re.compile(rf"[^\W\d_{_HAN}]+|\d+")
_PAIR = re.compile(rf"(?=([{_HAN}]{{2}}))")
_LAST = re.compile(rf"([^\W\d_{_HAN}]+|\d+|[{_HAN}]{{1,2}})[\W_]*$")
_BROKEN_NUMBER = re.compile(r"(?:[$€£¥]|(?<=\s))\d{1,3}[.,]$")


def mask(line: str) -> str:
    """A line with its numbers and capital codes (behind a label, names too) made alike, as it is counted over the corpus."""
    line = re.sub(r"\b[A-Z]{2,}(?=-9)", "AA", re.sub(r"\d+", "9", line))
    labelled = _LABEL.match(line)
    return labelled[1] + _NAME.sub("X", labelled[2]) if labelled else line


def ending(text: str) -> tuple[str, str]:
    """How a text ends, and its last line as counted over the corpus.

    ``cut``: a mark of a cut, or an unfinished word, sentence, row or mark-up. ``whole``: finished.
    ``line``: a new line that is no sentence. ``looks``: such a line with the looks of a complete one.
    """
    bare = text.rstrip(_BLANK)
    if not bare:
        return "whole", ""
    if _MARK.search(bare):
        return "cut", ""
    line = bare[bare.rfind("\n") + 1 :].strip(_BLANK)
    if "<" in bare or "&" in bare:
        if _OPEN_TAG.search(bare) or _OPEN_ENTITY.search(bare):
            return "cut", ""
        depth: dict[str, int] = {}
        for closing, name, empty in _TAG.findall(bare):
            if name.lower() not in _VOID and not empty:
                depth[name.lower()] = depth.get(name.lower(), 0) + (-1 if closing else 1)
        if any(n > 0 for n in depth.values()):
            return "cut", ""
        if bare.endswith(">") and _TAG.search(bare[-60:]):
            return "whole", ""
    if line.startswith("|"):
        return ("whole" if len(line) > 1 and line.endswith("|") else "cut"), ""
    core = bare.rstrip(_CLOSE)
    if core and core[-1] in _END:
        return ("cut" if core == bare and _BROKEN_NUMBER.search(bare) else "whole"), ""
    if len(line) <= LINE and (len(line) < len(bare) or len(bare) <= LINE):
        fresh = line[:1] in "-*•–‣·▪([{“\"/" or line[:1].isupper() or line[:1].isdigit() or not line[:1].isalpha()
        if fresh or len(line) == len(bare):
            if _LOOKS.search(line) or _ITEM.search(line):
                return "looks", mask(line)
            return ("cut", "") if _GOES_ON.search(line) else ("line", mask(line))
    return "cut", ""


def tokens(text: str) -> list[str]:
    """Lower-cased words, numbers as 9; of scripts written without blanks all pairs of characters."""
    found = ["9" if w[0].isdigit() else w.lower() for w in _WORD.findall(text)]
    return found if text.isascii() else found + _PAIR.findall(text)


def last_token(line: str) -> str:
    last = _LAST.search(line)
    return "" if last is None else "9" if last[1][0].isdigit() else last[1].lower()


_SEEN = pa.schema(
    [
        ("key", pa.int64()), ("source", pa.string()), ("same", pa.int64()), ("chars", pa.int64()), ("bytes", pa.int64()), ("state", pa.string()), ("line", pa.string()), ("digits", pa.int32()),
        ("hidden", pa.bool_()), ("tokens", pa.list_(pa.string())), ("last", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("t", pa.int64()), ("u", pa.int64()),
    ]
)


def _rows(**columns: list) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in _SEEN], schema=_SEEN)


def _seen(documents: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """One pass over the texts, giving three kinds of rows.

    Texts: ``key, source, same`` (hash of the text), lengths and ending. Complete lines (state 'head'): the
    short unpunctuated lines that texts go on after, once a task. Words, summed over a task: how often each
    is in sentences (n), in such lines (t), and at their end (u). The last line of a text is no evidence
    unless it is finished. Words of repeated texts count as often as they are there.
    """
    rows = documents.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).cast("long").alias("key"), tidy_code(F.col(source)).alias("source"), F.xxhash64(text).alias("same"), F.col(text).alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_text, in_lines, at_end = Counter(), Counter(), Counter()
        heads: dict[str, int] = {}

        def counted() -> Iterator[pa.RecordBatch]:
            words = list(in_text | in_lines)
            yield _rows(word=words, n=[in_text[w] for w in words], t=[in_lines[w] for w in words], u=[at_end[w] for w in words])
            yield _rows(state=["head"] * len(heads), line=list(heads), digits=list(heads.values()))
            for held in (in_text, in_lines, at_end, heads):
                held.clear()

        for batch in batches:
            states, lines, digits, hidden, words, lasts, prose = [], [], [], [], [], [], []
            texts = batch.column(3).to_pylist()
            for value in texts:
                bare = value.rstrip(_BLANK)
                state, line = ("short", "") if len(value) < LEAST else ending(value)
                before, _, last = bare.rpartition("\n")
                if state == "whole":
                    prose.append(last)
                last = last.strip(_BLANK) if line else ""
                states.append(state)
                lines.append(line)
                # What counting hides of the end: the digits of a last number, and whether the last word is masked.
                digits.append(len(_DIGITS.search(last)[0]))
                hidden.append(last.split()[-1:] != line.split()[-1:])
                words.append(tokens(last[: _LAST.search(last).start()] if _LAST.search(last) else last) if state == "line" else None)
                lasts.append(last_token(last) if state == "line" else None)
                for one in before.split("\n"):
                    one = one.strip(_BLANK)
                    if not one or one[0] == "|":
                        continue
                    if len(one) > LINE or one[-1] in ".。!?|,;:":
                        prose.append(one)
                        continue
                    in_lines.update(tokens(one))
                    at_end[last_token(one)] += 1
                    masked, k = mask(one), len(_DIGITS.search(one)[0])
                    heads[masked] = min(heads.get(masked, k), k)
            in_text.update(tokens("\n".join(prose)))
            yield _rows(
                key=batch.column(0).to_pylist(), source=batch.column(1).to_pylist(), same=batch.column(2).to_pylist(), chars=[len(t) for t in texts], bytes=[len(t.encode()) for t in texts],
                state=states, line=lines, digits=digits, hidden=hidden, tokens=words, last=lasts,
            )
            if len(in_text) + len(in_lines) + len(heads) > WORDS:
                yield from counted()
        yield from counted()

    kinds = "key long, source string, same long, chars long, bytes long, state string, line string, digits int, hidden boolean, tokens array<string>, last string, word string, n long, t long, u long"
    return rows.mapInArrow(run, kinds)


def _unlikely(n, expected):
    """Chernoff's bound on the log chance of ``n`` or more where ``expected`` are, for Poisson counts; 0 if no excess."""
    return F.when(n > expected, -(n * F.ln(n / expected) - n + expected)).otherwise(0.0)


def _discoveries(tests: DataFrame, rate: float) -> DataFrame:
    """The rows of ``tests`` whose ``log_p`` passes the step-up rule of Benjamini and Hochberg.

    A value passes if it is at most rate * (tests at or under it) / (all tests). Values are counted in bins
    first, of which there is a fixed number, and a bin passes by its upper end; no task orders all tests.
    """
    tests = materialize(tests)
    fine, least = 64, -700.0
    bins = tests.groupBy(F.floor(F.greatest("log_p", F.lit(least)) * fine).alias("b")).agg(F.count("*").alias("n")).collect()
    total, under, most = sum(b["n"] for b in bins), 0, -math.inf
    for b in sorted(bins, key=lambda b: b["b"]):
        under += b["n"]
        if (edge := (b["b"] + 1) / fine) <= math.log(rate * under / total):
            most = edge
    return tests.where(F.col("log_p") < F.lit(most)) if most > -math.inf else tests.limit(0)


def length_limits(lengths: DataFrame, *, neighbours: int = NEIGHBOURS, rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """Lengths at which a source ends suspiciously often: ``source, unit, length, n, expected``.

    ``lengths`` has source, unit ('chars' or 'bytes') and length, one row a text. They are counted
    first; windows then run over distinct lengths only. The hazard at a length is the number of texts
    ending there over those that reach it; expected is the pooled hazard of the neighbouring lengths.
    The chance of so many or more is bounded by Chernoff's bound for Poisson counts, and
    Benjamini-Hochberg's step-up rule keeps the false limits under ``rate``.
    """
    counts = lengths.groupBy("source", "unit", "length").agg(F.count("*").alias("n"))
    by = Window.partitionBy("source", "unit").orderBy("length")
    reach = F.sum("n").over(Window.partitionBy("source", "unit").orderBy(F.desc("length")))
    at = counts.withColumn("reached", reach)
    near = by.rangeBetween(-neighbours, neighbours)
    # Texts at risk at the lengths around, those without an ending included, are about so many a length.
    tests = (
        at.withColumn("around", F.sum("n").over(near) - F.col("n"))
        .withColumn("risk", F.avg("reached").over(near))
        .withColumn("expected", (F.col("around") + 1) / (2 * neighbours * F.col("risk")) * F.col("reached"))
        .withColumn("log_p", F.when(F.col("n") > 1, _unlikely(F.col("n"), F.col("expected"))).otherwise(0.0))
    )
    return _discoveries(tests, rate).select("source", "unit", "length", "n", "expected")


def _limited(ends: DataFrame) -> DataFrame:
    units = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length"))))
    # Copies of a text, and texts of one form, all end at one length, which is no sign of a limit.
    form = F.when(F.col("line") != "", F.xxhash64("line", "chars", "bytes")).otherwise(F.col("same"))
    single = ends.where(F.col("chars") >= LEAST).select("source", form.alias("form"), "chars", "bytes").dropDuplicates(["source", "form"])
    long = single.select("source", units.alias("u")).select("source", "u.*")
    return length_limits(long)


def _known_lines(ends: DataFrame, heads: DataFrame, rate: float) -> DataFrame:
    """``line, least``: masked lines that end as they should, and the fewest digits such lines end with.

    Either texts go on after the line, or, besides any one text, so many others end with it that random cuts,
    at the rate at which unfinished ends are seen here, would not leave it that often. Texts at limits do not testify,
    and copies of a text are one text.
    """
    single = ends.groupBy("same").agg(F.first("chars").alias("chars"), F.max((F.col("state") == "cut") & ~F.col("at_limit")).alias("cut"))
    all_ = single.agg(F.count("*").alias("texts"), F.sum("chars").alias("chars"), F.count_if("cut").alias("cut")).first()
    # A cut at one given character of each text would be met so often.
    expected = max(all_["texts"], 1) * (all_["cut"] + 1) / max(all_["chars"] or 0, 1)
    finals = ends.where(F.col("state").isin("line", "looks") & ~F.col("at_limit")).groupBy("line", "digits").agg(F.countDistinct("same").alias("n"))
    forms = _discoveries(finals.withColumn("log_p", _unlikely(F.col("n") - 1, F.lit(expected))), rate)
    return forms.select("line", "digits").union(heads.select("line", "digits")).groupBy("line").agg(F.min("digits").alias("least"))


def _begun_sentences(lines: DataFrame, words: DataFrame) -> DataFrame:
    """``line, last, words`` of those last lines that rather begin a sentence than close a text.

    The log odds of a line are summed over its words: how often a word is in sentences against in complete
    unpunctuated lines, and for the last one, how often a random cut leaves it (as a whole word, or as the
    beginning of longer ones) against how often such lines end with it. Each share is smoothed by half an
    occurrence a word; words that the corpus has nowhere else say nothing.
    """
    words = materialize(words.groupBy("word").agg(*(F.sum(c).alias(c) for c in "ntu")))
    total = words.agg(F.count("*").alias("v"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "ntu"), F.coalesce(F.sum(F.col("n") * F.length("word")), F.lit(0)).alias("c")).first()
    odds = lambda x, y, nx, ny: F.when((x > 0) | (y > 0), F.ln((x + 0.5) / (nx + total["v"] / 2 + 0.5)) - F.ln((y + 0.5) / (ny + total["v"] / 2 + 0.5))).otherwise(0.0)
    lines = lines.select("line", "tokens", "last").distinct().withColumn("id", F.xxhash64("line", "tokens", "last"))
    inner = lines.select("id", F.explode("tokens").alias("word")).join(words, "word").select("id", odds(F.col("n"), F.col("t"), total["n"], total["t"]).alias("odds"))
    asked = lines.select(F.col("last").alias("word")).where("word <> ''").distinct()
    longer = (
        words.where((F.length("word") > 1) & (F.col("n") > 0)).select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda k: F.substring(F.col("word"), F.lit(1), k))).alias("word"))
        .join(asked, "word", "left_semi").groupBy("word").agg(F.sum("n").alias("more"))
    )
    ends = asked.join(words, "word", "left").join(longer, "word", "left").select("word", (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("c"), F.coalesce("u", F.lit(0)).alias("u"))
    last = lines.select("id", F.col("last").alias("word")).join(ends, "word").select("id", odds(F.col("c"), F.col("u"), total["c"], total["u"]).alias("odds"))
    begun = inner.union(last).groupBy("id").agg(F.sum("odds").alias("odds")).where("odds > 0")
    return lines.join(begun, "id", "left_semi").select("line", "tokens", "last")


def truncations(documents: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """Every document with ``doc_id, source, chars, at_limit, in_transfer, is_cut``.

    ``at_limit``: its length is significant for its source and its ending is incomplete. ``in_transfer``: cut
    elsewhere, by the evidence of its end. ``is_cut``: either.

    Defined cases: texts under 20 characters, empty or null are never cut; a text ending in blanks is
    judged by what stands before them; a null or blank source is one source of its own; a repeated key
    is cut if one of its rows is; rows without a key are left out; an empty table gives no rows.
    """
    seen = materialize(_seen(documents, key, text, source))
    ends = seen.where("key IS NOT NULL").select("key", "source", "same", "chars", "bytes", "state", "line", "digits", "hidden", "tokens", "last")
    limits = materialize(_limited(ends))
    on = lambda unit: limits.where(F.col("unit") == unit).select(F.col("source").alias("s"), F.col("length").alias("l"), F.lit(True).alias(f"hit_{unit}"))
    chars, bytes_ = on("chars"), on("bytes")
    ends = ends.join(chars, F.col("source").eqNullSafe(chars["s"]) & (F.col("chars") == chars["l"]), "left").drop("s", "l")
    ends = ends.join(bytes_, F.col("source").eqNullSafe(bytes_["s"]) & (F.col("bytes") == bytes_["l"]), "left").drop("s", "l")
    ends = ends.withColumn("at_limit", F.coalesce("hit_chars", F.lit(False)) | F.coalesce("hit_bytes", F.lit(False))).drop("hit_chars", "hit_bytes")

    known = materialize(_known_lines(ends, seen.where("state = 'head'"), rate))
    undecided = F.col("state").isin("line", "looks")
    open_ = materialize(ends.where(undecided).join(known, "line", "left"))
    begun = _begun_sentences(open_.where("state = 'line' AND NOT at_limit AND least IS NULL"), seen.where("word IS NOT NULL").select("word", "n", "t", "u"))
    open_ = open_.join(begun.withColumn("begun", F.lit(True)), ["line", "tokens", "last"], "left")
    # A number shorter than such lines end with is unfinished; at a limit, a name that is masked may be so too.
    short = F.coalesce(F.col("digits") < F.col("least"), F.lit(False))
    unfinished = F.col("least").isNull() | short | (F.col("hidden") & (F.col("digits") == 0))
    by_length = F.col("at_limit") & F.when(undecided, unfinished).otherwise(F.col("state") == "cut")
    by_ending = ~F.col("at_limit") & F.when(F.col("state") == "line", short | F.coalesce("begun", F.lit(False))).otherwise(F.col("state") == "cut")
    columns = ["key", "source", "chars", by_length.alias("at_limit"), by_ending.alias("in_transfer")]
    decided = ends.where(~undecided).withColumns({"least": F.lit(None).cast("int"), "begun": F.lit(False)})
    return (
        open_.select(*columns).union(decided.select(*columns)).groupBy(F.col("key").alias(key))
        .agg(*(F.max(c).alias(c) for c in ("source", "chars", "at_limit", "in_transfer"))).withColumn("is_cut", F.col("at_limit") | F.col("in_transfer"))
    )


def truncation_report(documents: DataFrame, **names: str) -> DataFrame:
    """Per source: documents, how many are cut, how many of them at a limit and in transfer, and their shares."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    return truncations(documents, **names).groupBy("source").agg(
        F.count("*").alias("documents"),
        F.count_if("is_cut").alias("cut"), F.count_if("at_limit").alias("cut_at_limit"), F.count_if("in_transfer").alias("cut_in_transfer"),
        share("is_cut").alias("cut_share"), share("at_limit").alias("cut_at_limit_share"), share("in_transfer").alias("cut_in_transfer_share"),
    )
