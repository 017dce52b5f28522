"""Encoding of a corpus with a public tokenizer (problem 8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evistrata.llm import bpe


def encode(texts: DataFrame, key: str = "doc_id", text: str = "text", *, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """``key`` and ``ids``, the token ids of each row's whole text, without special tokens.

    Per distinct word of a worker the prefix table of ``bpe.PrefixTable`` is filled once; a text is then
    its words' ids in a row. Rows stay where they are read, there is no shuffle.

    Defined cases: a null and an empty text give an empty list; text that looks like a special token is
    plain text; repeated rows come out repeated; a null key stays null; other columns are not read.
    """
    rows = texts.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = bpe.encoder(vocabulary).ids
        for batch in batches:
            offsets, flat = np.zeros(batch.num_rows + 1, np.int32), []
            for i, value in enumerate(batch.column(1).to_pylist()):
                flat += ids(value)
                offsets[i + 1] = len(flat)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.array(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["key", "ids"])

    return rows.mapInArrow(run, f"key {kind}, ids array<int>").select(F.col("key").alias(key), "ids")
