"""Resolution of organisation names to the dictionary: exact, then by similarity, else none."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from evistrata.functions.text import SELF_REFERENCES, comparable_name
from evistrata.operators.mentions import ALIAS_BOUND

SIMILAR = 0.90


def alias_lookup(entities: DataFrame) -> DataFrame:
    """``alias, name``: comparable forms of names and aliases. Of two owners the later in the dictionary,
    by entity_id, wins; a name comes before its owner's aliases."""
    listed = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = entities.select("entity_id", "name", F.posexplode(listed).alias("pos", "text"))
    return rows.select(comparable_name(F.col("text")).alias("alias"), "name", "entity_id", "pos").where("alias <> ''").groupBy("alias").agg(F.max_by("name", F.struct("entity_id", "pos")).alias("name"))


def letter_counts(texts: list[str]) -> np.ndarray:
    """How often each text has each letter, in 64 columns that letters may share."""
    counts = np.zeros((len(texts), 64), np.int32)
    for i, text in enumerate(texts):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        counts[i] = np.bincount(codes & 63, minlength=64)
    return counts


def resolve(names: DataFrame, entities: DataFrame, *, threshold: float = SIMILAR) -> DataFrame:
    """``raw, canonical``: the canonical name of each distinct raw name, or null.

    Names that match no alias as they stand are compared by the Ratcliff-Obershelp ratio, first best by
    alias order. The ratio is at most that of the letters two names have in common, whatever their order,
    which is counted for all aliases at once; only aliases that it lets pass are compared. The aliases, a
    list of bounded size, are shipped to the tasks; names are compared once however often they occur.
    """
    lookup = alias_lookup(entities)
    raw = names.select(F.col(names.columns[0]).alias("raw")).where("raw IS NOT NULL").distinct().withColumn("alias", comparable_name(F.col("raw")))
    exact = raw.join(lookup, "alias", "left")
    count = lookup.count()
    if count > ALIAS_BOUND:
        raise ValueError(f"{count} aliases exceed the bound of {ALIAS_BOUND}")
    listed = sorted((r["alias"], r["name"]) for r in lookup.collect())
    shipped = names.sparkSession.sparkContext.broadcast(listed)

    @F.pandas_udf(T.StringType())
    def similar(values: pd.Series) -> pd.Series:
        known = shipped.value
        memory: dict[str, str | None] = {}
        lengths = np.array([len(a) for a, _ in known])
        letters = letter_counts([a for a, _ in known])

        def best(value: str) -> str | None:
            found, most = None, 0.0
            bounds = 2 * np.minimum(letters, letter_counts([value])).sum(1) / (lengths + len(value))
            for i in np.flatnonzero(bounds >= threshold - 1e-9) if len(known) else ():
                if bounds[i] <= most:
                    continue
                alias, name = known[i]
                ratio = SequenceMatcher(None, value, alias).ratio()
                if ratio > most:
                    found, most = name, ratio
            return found if most >= threshold else None

        for value in values:
            if value and value not in memory:
                memory[value] = best(value)
        return values.map(lambda v: memory.get(v) if v else None)

    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    open_ = exact.where("name IS NULL").select("raw", "alias").repartition(tasks, "alias").select("raw", similar("alias").alias("canonical"))
    return exact.where("name IS NOT NULL").select("raw", F.col("name").alias("canonical")).unionByName(open_)


def resolved_relations(extractions: DataFrame, entities: DataFrame, *, threshold: float = SIMILAR) -> DataFrame:
    """Every relation with ``src`` and ``dst`` (canonical names or null) and whether it is ``kept``: both
    known and different. A bare self-reference is the filer, the organisation of the record's ticker."""
    rows = extractions.select(
        *[c for c in ("record_no", "chunk_id", "ticker") if c in extractions.columns], F.posexplode("relations").alias("rel_pos", "r")
    ).select("*", "r.source_entity", "r.relation", "r.target_entity", "r.evidence_quote").drop("r")
    names = rows.select(F.col("source_entity").alias("raw")).union(rows.select("target_entity")).distinct()
    known = resolve(names, entities, threshold=threshold)
    filers = entities.where("ticker IS NOT NULL").groupBy("ticker").agg(F.min("name").alias("filer"))
    rows = rows.join(filers, "ticker", "left")
    for side, raw in (("src", "source_entity"), ("dst", "target_entity")):
        named = known.select(F.col("raw").alias(raw), F.col("canonical").alias(f"__{side}"))
        self_ = F.lower(F.trim(raw)).isin(*SELF_REFERENCES) & F.col("filer").isNotNull()
        rows = rows.join(named, raw, "left").withColumn(side, F.when(self_, F.col("filer")).otherwise(F.col(f"__{side}"))).drop(f"__{side}")
    kept = F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst"))
    return rows.withColumn("kept", kept).drop("filer")


def resolution_report(relations: DataFrame) -> DataFrame:
    """The relations that were dropped, with what each side resolved to."""
    return relations.where("NOT kept").select(
        "ticker", "chunk_id", "source_entity", "relation", "target_entity", "evidence_quote", F.col("src").alias("src_resolved"), F.col("dst").alias("tgt_resolved")
    )


def unresolved_names(relations: DataFrame, limit: int = 10) -> DataFrame:
    """The most frequent names that resolved to nothing."""
    dropped = relations.where("NOT kept")
    names = dropped.where("src IS NULL").select(F.col("source_entity").alias("name")).union(dropped.where("dst IS NULL").select("target_entity"))
    return names.where("name IS NOT NULL").groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(limit)
