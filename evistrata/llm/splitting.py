"""Content-defined splitting of oversized texts at natural boundaries (problem 2).

A rolling hash over the last words marks landmarks. From each cut on, the first landmark that leaves a
piece of at least the minimum size is taken and snapped to the nearest paragraph, sentence or row end;
without one the best boundary before the maximum serves. As both depend on nearby words only, an edit
moves the cuts next to it and no others.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evistrata.llm import bpe

CAP, OVERLAP = 1100, 100
#: Fewest new tokens of a piece but the last; room for an overlap that is a little over its size.
LEAST, ROOM = 400, 40
#: One word in so many is a landmark; the rolling hash spans WINDOW words.
SPACING, WINDOW = 128, 8
#: Tokens by which a landmark may be moved to reach a boundary of that level.
REACH = {3: 160, 2: 80, 1: 40}
#: Longer words, of scripts without blanks or of junk, are taken in slices of so many characters.
SLICE = 16

_MASK = (1 << 32) - 1
_FACTOR = 0x01000193
_TOP = pow(_FACTOR, WINDOW, 1 << 32)


def _units(text: str, count) -> tuple[list[int], list[int]]:
    """End offsets and token counts of the words of a text, long words in slices."""
    ends, sizes, at = [], [], 0
    for word in bpe.words(text):
        if len(word) <= SLICE:
            at += len(word)
            ends.append(at)
            sizes.append(count(word))
        else:
            n = count(word)
            if n <= 8:
                at += len(word)
                ends.append(at)
                sizes.append(n)
            else:
                for k in range(0, len(word), SLICE):
                    part = word[k : k + SLICE]
                    at += len(part)
                    ends.append(at)
                    sizes.append(count(part))
    return ends, sizes


def _level(text: str, end: int) -> int:
    """How natural a cut at ``end`` is: 3 paragraph, 2 sentence or row, 1 word, 0 inside a word."""
    if end >= len(text):
        return 3
    before, after = text[end - 1], text[end]
    if before == "\n":
        return 3 if end > 1 and text[end - 2] == "\n" else 2
    if after == "\n":
        return 0 if before == "\r" else 1
    if before in "。！？":
        return 2
    if after.isspace():
        closed = text[max(0, end - 3) : end].rstrip("\"'”’)]»")
        return 2 if closed and closed[-1] in ".!?。！？" else 1
    return 1 if before.isspace() else 0


def split(text: str, cap: int = CAP, overlap: int = OVERLAP, vocabulary: str = bpe.VOCABULARY) -> list[tuple[int, int, int, int]]:
    """Pieces as (start, end, tokens, tokens shared with the piece before); one piece if within the cap."""
    counter = bpe.counter(vocabulary)
    total = counter.count(text)
    if total <= cap:
        return [(0, len(text), total, 0)]
    ends, sizes = _units(text, counter.word)
    upto = list(accumulate(sizes))  # tokens up to and with each unit
    levels = [_level(text, e) for e in ends]
    marks, rolling, codes = [], 0, []
    start = 0
    for k, end in enumerate(ends):
        code = zlib.crc32(text[start:end].encode())
        codes.append(code)
        rolling = (rolling * _FACTOR + code - (codes[k - WINDOW] * _TOP if k >= WINDOW else 0)) & _MASK
        if (rolling >> 8) % SPACING == 0:
            marks.append(k)
        start = end
    least = min(LEAST, (cap - overlap) // 3)
    most = max(1, cap - overlap - min(ROOM, (cap - overlap) // 4))
    pieces, begun, cut = [], 0, -1  # cut: last unit of the piece before; begun: first unit of this one
    last = len(ends) - 1
    while cut < last:
        done = upto[cut] if cut >= 0 else 0
        if upto[last] - done <= most:
            chosen = last
        else:
            chosen = _next_cut(upto, levels, marks, cut, done, least, most)
        first = ends[begun - 1] if begun else 0
        n = counter.count(text[first : ends[chosen]])
        while n > cap and chosen > cut + 1:  # joined slices of a word may count otherwise than apart
            chosen -= 1
            n = counter.count(text[first : ends[chosen]])
        shared = counter.count(text[first : ends[cut]]) if cut >= 0 else 0
        pieces.append((first, ends[chosen], n, shared))
        cut = chosen
        begun = min(cut, max(bisect_right(upto, upto[cut] - overlap), begun + 1)) if overlap else cut + 1
    return pieces


def _next_cut(upto: list[int], levels: list[int], marks: list[int], cut: int, done: int, least: int, most: int) -> int:
    low = max(cut + 1, bisect_left(upto, done + least))
    high = max(cut + 1, bisect_right(upto, done + most) - 1)
    low = min(low, high)
    at = bisect_left(marks, low)
    if at < len(marks) and marks[at] <= high:
        mark = marks[at]
        for level, reach in REACH.items():
            near = [k for k in range(low, high + 1) if levels[k] >= level and abs(upto[k] - upto[mark]) <= reach]
            if near:
                return min(near, key=lambda k: (abs(upto[k] - upto[mark]), k))
        return mark
    for level in (3, 2, 1):
        for k in range(high, low - 1, -1):
            if levels[k] >= level:
                return k
    return high


def split_oversized(
    rows: DataFrame, *, key: str = "chunk_id", section: str = "section_id", text: str = "text", cap: int = CAP, overlap: int = OVERLAP, vocabulary: str = bpe.VOCABULARY
) -> DataFrame:
    """The pieces of every row whose text has more than ``cap`` tokens.

    Columns: ``key``, ``section``, ``source_tokens``, ``piece_no`` (from 0), ``n_pieces``,
    ``piece_from`` and ``piece_to`` (characters of the text), ``n_tokens``, ``shared_tokens`` (with the
    piece before), ``piece``. A piece is a substring of the text and has at most ``cap`` tokens.

    Defined cases: null, empty and small texts give no rows; a row repeated with the same text gives
    its pieces once, and texts that differ under one key are each split; a null key stays null. A text
    of fewer bytes than ``cap`` cannot have more tokens, and is passed over unread by Python.
    """
    large = rows.where(F.octet_length(F.col(text)) > cap).select(
        F.col(key).cast("string").alias("key"), F.col(section).cast("string").alias("section"), F.col(text).alias("text")
    )
    names = ["key", "section", "source_tokens", "piece_no", "n_pieces", "piece_from", "piece_to", "n_tokens", "shared_tokens", "piece"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = bpe.counter(vocabulary).count
        schema = pa.schema([(n, pa.string() if n in ("key", "section", "piece") else pa.int64()) for n in names])
        for batch in batches:
            out = []
            for k, s, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                total = count(t)
                if total > cap:
                    pieces = split(t, cap, overlap, vocabulary)
                    out += [(k, s, total, i, len(pieces), a, b, n, m, t[a:b]) for i, (a, b, n, m) in enumerate(pieces)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    kinds = ", ".join(f"{n} {'string' if n in ('key', 'section', 'piece') else 'long'}" for n in names)
    pieces = large.mapInArrow(run, kinds)
    return pieces.withColumnsRenamed({"key": key, "section": section})


def distinct_pieces(pieces: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Pieces without those of repeated rows."""
    return pieces.dropDuplicates([key, "source_tokens", "piece_no", "piece_from", "piece_to", "piece"])
