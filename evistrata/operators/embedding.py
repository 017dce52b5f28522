"""Vectors of passages and questions by an encoder that the user gives."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


class Encoder(Protocol):
    """Texts in, one vector per text out; called in batches on the executors."""

    dims: int

    def __call__(self, texts: list[str]) -> np.ndarray: ...


def passage(heading: Column, text: Column) -> Column:
    """What of a chunk is encoded: its sub-heading, if any, above its text."""
    return F.trim(F.concat(F.coalesce(heading, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit(""))))


def encode_passages(chunks: DataFrame, encoder: Encoder, *, key: str = "chunk_id", heading: str = "sub_heading", text: str = "text", batch: int = 8) -> DataFrame:
    """``key, embedding`` at length one. A vector of the wrong size is an error, not a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = []
            for start in range(0, len(rows), batch):
                vectors = np.asarray(encoder(rows["__p"].iloc[start : start + batch].tolist()), np.float64)
                if vectors.shape[1:] != (encoder.dims,):
                    raise ValueError(f"the encoder gave vectors of shape {vectors.shape[1:]}, not ({encoder.dims},)")
                found += list(vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12))
            yield pd.DataFrame({key: rows[key], "embedding": found})

    kind = dict(chunks.dtypes)[key]
    return chunks.select(key, passage(F.col(heading), F.col(text)).alias("__p")).mapInPandas(run, f"{key} {kind}, embedding array<float>")


def encode_question(question: str, encoder: Encoder, instruction: str = "") -> list[float]:
    """A question's vector at length one, on the driver."""
    vector = np.asarray(encoder([f"{instruction}{question}"]), np.float64)[0]
    return (vector / max(np.linalg.norm(vector), 1e-12)).tolist()


def pooled(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The state of each row's last token that the mask keeps, wherever the padding is."""
    last = mask.shape[1] - 1 - np.argmax(mask[:, ::-1] > 0, axis=1)
    return states[np.arange(len(states)), last]


def fidelity(a: DataFrame, b: DataFrame, *, key: str = "chunk_id") -> DataFrame:
    """Least and mean cosine between two encodings of the same rows."""
    from evistrata.functions.vectors import cosine

    both = a.select(key, F.col("embedding").alias("__a")).join(b.select(key, F.col("embedding").alias("__b")), key)
    return both.select(cosine(F.col("__a"), F.col("__b")).alias("c")).agg(F.min("c").alias("least"), F.avg("c").alias("mean"), F.count("c").alias("n"))


def answered(questions: DataFrame, models: dict[str, Callable[[str], str]], systems: Sequence[str] | None = None) -> DataFrame:
    """``id, system, answer, latency_s`` of each open run: questions with their ``system`` (see
    ``evaluation.open_runs``) and ``prompt``, asked on the executors."""
    import time

    names = list(systems or models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for i, system, prompt in zip(rows["id"], rows["system"], rows["prompt"]):
                began = time.monotonic()
                out.append((i, system, models[system](prompt), time.monotonic() - began))
            yield pd.DataFrame(out, columns=["id", "system", "answer", "latency_s"])

    return questions.where(F.col("system").isin(*names)).select("id", "system", "prompt").mapInPandas(run, "id string, system string, answer string, latency_s double")
