"""Calls of language models through callables given by the user, and what keeps them in check."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from evistrata.functions.text import quote_in_text

MOST_TOKENS = 8_000


class Truncated(Exception):
    """A reply that stopped at its token budget."""


def fenced(text: str) -> str:
    """The inside of a code fence, or the text itself."""
    found = re.search(r"```[\w-]*\s*\n(.*?)(?:```|\Z)", text, re.S)
    return (found[1] if found else text).strip()


def first_object(text: str) -> str | None:
    """The first JSON object in a text, whose braces balance outside of strings."""
    start = text.find("{")
    while start >= 0:
        depth, quoted, escaped = 0, False, False
        for i in range(start, len(text)):
            c = text[i]
            if quoted:
                quoted, escaped = (escaped or c != '"'), (c == "\\" and not escaped)
            elif c == '"':
                quoted = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    return text[start : i + 1]
        start = text.find("{", start + 1)
    return None


def structured(
    prompt: str, ask: Callable[[str, int], str], check: Callable[[dict], dict], *, budget: int = 4_000, waits: Sequence[float] = (15, 60, 180, 300), sleep: Callable[[float], None] = time.sleep
) -> dict:
    """A checked JSON object from a model.

    A truncated reply doubles the budget up to a limit; one that does not check is sent back once more
    with the complaint; failed calls are repeated after pauses.
    """
    text, problem = prompt, None
    for wait in waits:
        try:
            said = ask(text, budget)
            found = first_object(fenced(said))
            if found is None:
                raise ValueError("no JSON object in the reply")
            return check(json.loads(found))
        except Truncated as e:
            budget, problem = min(MOST_TOKENS, 2 * budget), e
        except (ValueError, KeyError, TypeError) as e:
            text, problem = f"{prompt}\n\nThe reply did not fit: {e}. Reply with the JSON object only.", e
        except OSError as e:
            problem = e
            sleep(wait)
    raise RuntimeError(f"no usable reply after {len(waits)} attempts: {problem}")


class TextStream:
    """An iterator over parts of a reply that keeps the text so far and the reported usage."""

    def __init__(self, parts: Iterator[str | dict]):
        self._parts, self.text, self.usage = parts, "", None

    def __iter__(self) -> Iterator[str]:
        for part in self._parts:
            if isinstance(part, dict):
                self.usage = part
            else:
                self.text += part
                yield part


def with_supported_quotes(extractions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Extractions without relations and risks whose quote is not in the chunk, and how many were dropped.

    Arrays are filtered in place; only the chunk's text is joined to them.
    """
    rows = extractions.join(chunks.select("chunk_id", F.col("text").alias("__t")).dropDuplicates(["chunk_id"]), "chunk_id", "left")
    held = lambda x: F.coalesce(quote_in_text(x["evidence_quote"], F.col("__t")), F.lit(False))
    kept = rows.withColumn("__r", F.filter("relations", held)).withColumn("__f", F.filter("risk_factors", held))
    dropped = F.size("relations") - F.size("__r") + F.size("risk_factors") - F.size("__f")
    return kept.withColumn("dropped_quotes", dropped).withColumn("relations", F.col("__r")).withColumn("risk_factors", F.col("__f")).drop("__r", "__f", "__t")


def with_verdicts(rows: DataFrame, items: str = "relations", verdicts: str = "verdicts") -> DataFrame:
    """Items whose verdict is true; all of them if there is not one verdict per item."""
    paired = F.transform(F.filter(F.arrays_zip(F.col(items).alias("i"), F.col(verdicts).alias("v")), lambda p: p["v"]), lambda p: p["i"])
    return rows.withColumn(items, F.when(F.size(items) == F.size(verdicts), paired).otherwise(F.col(items)))


def extract(chunks: DataFrame, model: Callable[[str], dict], schema: str) -> DataFrame:
    """``chunk_id`` and the model's fields for every chunk, called on the executors batch by batch."""
    import pyspark.sql.types as T

    names = [f.name for f in T.StructType.fromDDL(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *(found.get(n) for n in names)) for k, found in ((k, model(t)) for k, t in zip(batch["chunk_id"], batch["text"]))]
            yield pd.DataFrame(rows, columns=["chunk_id", *names])

    return chunks.select("chunk_id", "text").mapInPandas(run, f"chunk_id string, {schema}")
