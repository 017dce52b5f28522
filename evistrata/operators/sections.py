"""Sections of filings from streams of elements, their canonical texts, and chunks of those."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from evistrata.functions.text import section_marker

#: Element types that carry no content, and those that may head a section.
NOISE = ("IrrelevantElement", "PageHeaderElement", "PageNumberElement", "EmptyElement", "NotYetClassifiedElement", "ImageElement", "IntroductorySectionElement")
HEADINGS = ("TitleElement", "TopSectionTitle")
#: The sections worth reading, by form.
KEPT = {"10-K": ("I.1", "I.1A", "II.7"), "10-Q": ("I.2", "II.1A"), "20-F": ("I.3", "I.4", "I.5")}
#: Running page headers that name a section, by form.
PAGE_HEADERS = {
    "10-K": {
        "our business": "I.1", "our strategy": "I.1", "overview and our strategy": "I.1", "fundamentals of our business": "I.1",
        "risk factors": "I.1A", "risk factors and other key information": "I.1A", "md&a": "II.7",
    },
    "10-Q": {"md&a": "I.2", "risk factors": "II.1A"},
    "20-F": {"risk factors": "I.3"},
}
#: Headings of items and parts, and a page header with its page number.
ITEM = r"(?iU)^item\s+(\d+[a-z]?)[.:\s]"
PART = r"(?iU)^part\s+(i{1,3}|iv)\b"
NUMBERED = r"(?U)^([A-Za-z][A-Za-z &,’'\-]{2,60}?)\s*(\d{1,3})$"
HEADING_LENGTH, MARKER_LENGTH, SUB_HEADING_LENGTH = 200, 80, 150
SEPARATOR = "\n\n"
TARGET_TOKENS, MOST_TOKENS = 700, 1100


def by_items(elements: DataFrame, *, doc: str = "accession_no") -> DataFrame:
    """Content elements with the section of the last item heading before them.

    A part heading changes the part of later items only; it neither ends the section at hand nor is it
    content. Elements before the first item and noise are left out. Both are last values carried forward
    by windows over a document, without Python.
    """
    text = F.trim("text")
    rows = elements.withColumn("text", text).where((F.col("text") != "") & ~F.col("element_type").isin(*NOISE))
    heading = F.col("element_type").isin(*HEADINGS) & (F.length("text") < HEADING_LENGTH)
    part, item = F.regexp_extract("text", PART, 1), F.regexp_extract("text", ITEM, 1)
    so_far = Window.partitionBy(doc).orderBy("element_index").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__part", F.when(heading & (part != ""), F.upper(part))).withColumn("__item", F.when(heading & (part == "") & (item != ""), F.upper(item)))
    rows = rows.withColumn("__in", F.coalesce(F.last("__part", True).over(so_far), F.lit("I")))
    opened = F.when(F.col("__item").isNotNull(), F.struct(F.concat_ws(".", "__in", "__item").alias("id"), F.col("text").alias("title")))
    rows = rows.withColumn("__s", F.last(opened, True).over(so_far)).where("__part IS NULL AND __item IS NULL AND __s IS NOT NULL")
    return rows.withColumn("section_id", F.col("__s.id")).withColumn("section_title", F.col("__s.title")).drop("__part", "__item", "__in", "__s")


def by_page_headers(elements: DataFrame, *, doc: str = "accession_no", form: str = "form") -> DataFrame:
    """Content elements with the section that running page headers name, for filings without item headings.

    A short element opens a section if its marker is a known one and it is numbered, a page header or a
    heading. A numbered name of no known section ends the section; so does a page header of another name.
    Whether it does depends on the state, so a document is one sequence: its rows are sorted in their
    partition and streamed, with only the state in memory.
    """
    names = elements.columns
    known = F.lit(None).cast("string")
    for f, markers in PAGE_HEADERS.items():
        for marker, section in markers.items():
            known = F.when((F.col(form) == f) & (F.col("__marker") == marker), section).otherwise(known)
    short = F.length("text") < MARKER_LENGTH
    rows = elements.withColumn("text", F.trim("text")).where("text <> ''").withColumn("__marker", F.when(short, section_marker(F.col("text"))))
    rows = rows.withColumn("__numbered", F.coalesce(short & F.col("text").rlike(NUMBERED), F.lit(False)))
    rows = rows.withColumn("__opens", F.when(F.col("__numbered") | F.col("element_type").isin("PageHeaderElement", *HEADINGS), known))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in elements.schema) + ", section_id string, section_title string"

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        document, section, name = object(), None, None
        for batch in batches:
            found = []
            for i, (d, kind, marker, numbered, opens) in enumerate(zip(batch[doc], batch["element_type"], batch["__marker"], batch["__numbered"], batch["__opens"])):
                if d != document:
                    document, section, name = d, None, None
                if isinstance(opens, str):
                    section, name = opens, marker
                elif numbered or (kind == "PageHeaderElement" and isinstance(marker, str) and section is not None and marker != name):
                    section, name = None, None
                elif section is not None and kind not in NOISE:
                    found.append((i, section, name))
            columns = {n: batch[n].tolist() for n in names}
            picked = {n: [values[i] for i, *_ in found] for n, values in columns.items()}
            yield pd.DataFrame(picked | {"section_id": [s for _, s, _ in found], "section_title": [n for *_, n in found]}, dtype=object)

    return rows.repartition(doc).sortWithinPartitions(doc, "element_index").mapInPandas(walk, kinds)


def kept_section(form: Column, section: Column) -> Column:
    test = F.lit(False)
    for f, sections in KEPT.items():
        test = test | ((form == f) & section.isin(*sections))
    return test


def segmented(elements: DataFrame, *, doc: str = "accession_no", form: str = "form") -> DataFrame:
    """Sections by items; for documents in which these give no section worth reading, by page headers."""
    items = by_items(elements, doc=doc)
    fine = items.where(kept_section(F.col(form), F.col("section_id"))).select(doc).distinct()
    rest = elements.join(fine, doc, "left_anti")
    return items.join(fine, doc, "left_semi").unionByName(by_page_headers(rest, doc=doc, form=form).select(*items.columns))


class _Elements(HTMLParser):
    """Blocks of an HTML page as typed elements."""

    KINDS = {**dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6", "title"), "TitleElement"), "table": "TableElement", "header": "PageHeaderElement", **dict.fromkeys(("p", "div", "li", "pre", "blockquote", "td"), "TextElement")}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []
        self.open: list[str] = []
        self.text: list[str] = []

    def _close(self):
        text = re.sub(r"[ \t\r\f\v]+", " ", "".join(self.text)).strip()
        self.text.clear()
        if text:
            kind = "TableElement" if "table" in self.open else next((self.KINDS[t] for t in reversed(self.open) if t in self.KINDS), "TextElement")
            self.found.append((kind, text))

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.open.append(tag)
        elif "table" in self.open:
            self.text.append(" | " if tag in ("td", "th") else "\n" if tag == "tr" else "")
            self.open += [tag] if tag == "table" else []
        elif tag in self.KINDS:
            self._close()
            self.open.append(tag)
        elif tag == "br":
            self.text.append("\n")

    def handle_endtag(self, tag):
        if tag in self.open:
            if tag == "table" or "table" not in self.open:
                self._close()
            while self.open and self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if not {"script", "style"} & set(self.open):
            self.text.append(data)

    def close(self):
        super().close()
        self._close()
        return self.found


def html_elements(pages: DataFrame, *, key: str = "accession_no", html: str = "html") -> DataFrame:
    """``key, element_index, element_type, text`` of the blocks of every page. A null page has none."""
    kind = dict(pages.dtypes)[key]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, page in zip(batch["key"], batch["html"]):
                if page:
                    parser = _Elements()
                    parser.feed(page)
                    rows += [(k, i, *e) for i, e in enumerate(parser.close())]
            yield pd.DataFrame(rows, columns=["key", "element_index", "element_type", "text"])

    return pages.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInPandas(parse, f"key {kind}, element_index int, element_type string, text string").withColumnRenamed("key", key)


def section_offsets(rows: DataFrame, *, doc: str = "accession_no") -> DataFrame:
    """Rows with ``char_start`` and ``char_end`` in the canonical text of their section, its elements joined
    by a blank line: a running sum over the elements before."""
    before = Window.partitionBy(doc, "section_id").orderBy("element_index").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + len(SEPARATOR)).over(before), F.lit(0))
    return rows.withColumn("char_start", start.cast("long")).withColumn("char_end", (F.col("char_start") + F.length("text")).cast("long"))


def section_texts(rows: DataFrame, *, doc: str = "accession_no") -> DataFrame:
    """The canonical text of every section. A section is a bounded part of one filing."""
    listed = F.array_sort(F.collect_list(F.struct("element_index", "text")))
    text = F.array_join(F.transform(listed, lambda x: x["text"]), SEPARATOR)
    out = rows.groupBy(doc, "section_id").agg(F.min_by("section_title", "element_index").alias("section_title"), text.alias("text"))
    return out.withColumn("n_chars", F.length("text"))


def word_count(text: str) -> int:
    """A token counter that needs no vocabulary; others may be given instead."""
    return len(text.split())


def sentence_pieces(text: str, most: int, count: Callable[[str], int]) -> list[tuple[int, int]]:
    """Spans of a text, each of whole sentences and within ``most`` tokens where its sentences allow.

    Spans are those of the sentences in the text itself, so a piece is a substring whatever blanks
    separate its sentences. A sentence over the limit is a piece of its own.
    """
    spans, at = [], 0
    for gap in re.finditer(r"(?<=[.!?])\s+", text):
        spans.append((at, gap.start()))
        at = gap.end()
    spans.append((at, len(text)))
    pieces: list[tuple[int, int]] = []
    for start, end in spans:
        if pieces and count(text[pieces[-1][0] : end]) <= most:
            pieces[-1] = (pieces[-1][0], end)
        else:
            pieces.append((start, end))
    return [p for p in pieces if p[0] < p[1]]


def chunks(
    rows: DataFrame, *, doc: str = "accession_no", count: Callable[[str], int] = word_count, target: int = TARGET_TOKENS, most: int = MOST_TOKENS
) -> DataFrame:
    """Chunks of sections, packed from whole elements.

    A title ends the chunk at hand and names the ones after it. A table is a chunk alone. An element over
    the limit is cut at sentence ends. Other elements gather until their text has ``target`` tokens. A
    chunk is a substring of its section's canonical text and never crosses a section.

    Columns: chunk_id (doc:section:sequence), doc, section_id, section_title, sub_heading, kind, text,
    char_start, char_end, n_tokens. The elements of a section are streamed in order; what is held is one
    chunk. Rows with a null section or text are left out.
    """
    rows = section_offsets(rows.where("section_id IS NOT NULL AND text IS NOT NULL"), doc=doc)
    kinds = f"chunk_id string, {doc} string, section_id string, section_title string, sub_heading string, kind string, text string, char_start long, char_end long, n_tokens long"
    columns = [c.split()[0] for c in kinds.split(", ")]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = None
        title = sub = None
        number = begin = 0
        held: list[str] = []
        out: list[tuple] = []

        def put(kind: str, text: str, start: int) -> None:
            nonlocal number
            out.append((f"{place[0]}:{place[1]}:{number:04d}", *place, title, sub, kind, text, start, start + len(text), count(text)))
            number += 1

        def flush() -> None:
            if held:
                put("prose", SEPARATOR.join(held), begin)
                held.clear()

        for batch in batches:
            for d, s, t, kind, text, start in zip(batch[doc], batch["section_id"], batch["section_title"], batch["element_type"], batch["text"], batch["char_start"]):
                if (d, s) != place:
                    if place:
                        flush()
                    place, title, sub, number = (d, s), t, None, 0
                start = int(start)
                if kind == "TitleElement":
                    flush()
                    sub = text[:SUB_HEADING_LENGTH]
                elif kind == "TableElement":
                    flush()
                    put("table", text, start)
                elif count(text) > most:
                    flush()
                    for a, b in sentence_pieces(text, most, count):
                        put("prose", text[a:b], start + a)
                else:
                    if held and begin + len(SEPARATOR.join(held)) + len(SEPARATOR) != start:
                        flush()
                    if not held:
                        begin = start
                    held.append(text)
                    if count(SEPARATOR.join(held)) >= target:
                        flush()
            if out:
                yield pd.DataFrame(out, columns=columns)
                out = []
        if place:
            flush()
        yield pd.DataFrame(out, columns=columns)

    picked = rows.select(doc, "section_id", "section_title", "element_index", "element_type", "text", "char_start")
    return picked.repartition(doc, "section_id").sortWithinPartitions(doc, "section_id", "element_index").mapInPandas(pack, kinds)


def misplaced(chunks: DataFrame, texts: DataFrame, *, doc: str = "accession_no") -> DataFrame:
    """Chunks that are not the substring of their section's text that their offsets name."""
    whole = texts.select(doc, "section_id", F.col("text").alias("__whole"))
    found = F.col("__whole").substr((F.col("char_start") + 1).cast("int"), (F.col("char_end") - F.col("char_start")).cast("int"))
    return chunks.join(whole, [doc, "section_id"], "left").where(~F.coalesce(found == F.col("text"), F.lit(False))).drop("__whole")
