"""Organisations named in texts."""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

try:
    import ahocorasick
except ImportError:  # texts then meet the aliases by words
    ahocorasick = None

#: Names up to which a dictionary, a hand-kept list, is compiled into a pattern or shipped to be compared by similarity.
ALIAS_BOUND = 20_000
#: Letters of aliases up to which all of them are searched for in one pass over each text.
AUTOMATON_LETTERS = 8 << 20
_WORD = r"[\p{L}\p{N}_]"


def aliases(entities: DataFrame) -> DataFrame:
    """``entity_id, name, alias``: every name and alias of every organisation, once."""
    every = F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))))
    return entities.select("entity_id", "name", every.alias("alias")).where(F.trim("alias") != "").distinct()


def mentioned(texts: DataFrame, entities: DataFrame, *, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """``key, entity_id`` of every organisation of which a text holds a name or alias as whole words,
    whatever the case.

    An automaton of all aliases is shipped and runs once over each text where it is, so neither texts nor
    words are shuffled. A dictionary of more than AUTOMATON_LETTERS meets the texts by words instead.
    """
    word = rf"{_WORD}+"
    names = aliases(entities).select("entity_id", F.lower(F.trim("alias")).alias("alias")).distinct()
    names = names.withColumn("first", F.regexp_extract("alias", word, 0)).where("first <> ''")
    texts = texts.where(F.col(key).isNotNull())
    if ahocorasick is not None and (names.agg(F.sum(F.length("alias"))).first()[0] or 0) <= AUTOMATON_LETTERS:
        return _mentioned_in_one_pass(texts, names, key, text)
    return _mentioned_by_words(texts, names, key, text)


_built: dict[str, object] = {}


def _automaton(token: str, rows: list[tuple[int, str]]):
    if token not in _built:
        _built.clear()
        owners = defaultdict(list)
        for entity, alias in rows:
            owners[alias].append(entity)
        found = ahocorasick.Automaton()
        for alias, entities in owners.items():
            found.add_word(alias, (len(alias), entities))
        if owners:
            found.make_automaton()
        _built[token] = found
    return _built[token]


def _mentioned_in_one_pass(texts: DataFrame, names: DataFrame, key: str, text: str) -> DataFrame:
    shipped = texts.sparkSession.sparkContext.broadcast([(r["entity_id"], r["alias"]) for r in names.select("entity_id", "alias").collect()])
    token = uuid.uuid4().hex
    inside = lambda c: c.isalnum() or c == "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(token, shipped.value)
        for batch in batches:
            rows, ids = [], []
            for row, low in enumerate(batch.column(1).to_pylist() if len(automaton) else []):
                met = set()
                for end, (length, entities) in automaton.iter(low or ""):
                    start = end - length
                    if (start < 0 or not inside(low[start])) and (end + 1 == len(low) or not inside(low[end + 1])):
                        met.update(entities)
                rows += [row] * len(met)
                ids += met
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(ids, pa.int64())], [key, "entity_id"])

    found = texts.select(key, F.lower(F.col(text)).alias("__t")).mapInArrow(run, f"`{key}` {dict(texts.dtypes)[key]}, entity_id long")
    return found.distinct()


def _mentioned_by_words(texts: DataFrame, names: DataFrame, key: str, text: str) -> DataFrame:
    """Texts become their distinct words, which meet the aliases by first word, so a text is only searched
    for aliases that begin with one of its words."""
    lowered, word = F.lower(F.col(text)), rf"{_WORD}+"
    words = F.array_distinct(F.regexp_extract_all(lowered, F.lit(rf"({word})"), F.lit(1)))
    # Only words that begin an alias travel: a text meets the few aliases before its text does.
    hits = texts.select(key, F.explode(words).alias("first")).join(names, "first").groupBy(key).agg(F.collect_set(F.struct("entity_id", "alias")).alias("maybe"))
    found = texts.select(key, lowered.alias("__t")).join(hits, key)
    return found.select(key, F.explode(F.filter("maybe", lambda m: holds_words(F.col("__t"), m["alias"]))).alias("m")).select(key, "m.entity_id").distinct()


def holds_words(text: Column, phrase: Column) -> Column:
    """Whether a lower-cased text holds a lower-cased phrase that neither starts nor ends inside a word."""
    quoted = F.regexp_replace(phrase, r"([\\.\[\](){}*+?^$|\-/])", r"\\$1")
    # Most phrases are not there at all; only for the rest is a pattern compiled.
    return F.contains(text, phrase) & F.regexp_like(text, F.concat(F.lit(rf"(?<!{_WORD})"), quoted, F.lit(rf"(?!{_WORD})")))


def mention_lists(texts: DataFrame, entities: DataFrame, **names: str) -> DataFrame:
    """Per text the sorted ids of the organisations it names; texts that name none are left out."""
    key = names.get("key", "chunk_id")
    return mentioned(texts, entities, **names).groupBy(key).agg(F.array_sort(F.collect_set("entity_id")).alias("entity_ids"))


def anchors(questions: DataFrame, entities: DataFrame, default: int | None = None, *, key: str = "question_id", text: str = "question") -> DataFrame:
    """``key, entity_id, name`` of the organisations each question names, or a default where it names none."""
    ids = mentioned(questions, entities, key=key, text=text)
    named = ids.join(entities.select("entity_id", "name").dropDuplicates(["entity_id"]), "entity_id").select(key, "entity_id", "name")
    if default is None:
        return named
    rest = questions.join(ids, key, "left_anti").select(key, F.lit(default).cast("long").alias("entity_id"))
    return named.unionByName(rest.join(entities.select("entity_id", "name").dropDuplicates(["entity_id"]), "entity_id", "left").select(key, "entity_id", "name"))


def cooccurrences(exposures: DataFrame, rules: DataFrame, topics: dict[str, tuple[str, ...]]) -> DataFrame:
    """``cik, rule_id, topic``: companies and rules that share a topic, the first topic in order.

    A rule has a topic if its title holds the topic's name; a company if its ``text`` holds one of the
    topic's keywords. Both sides are reduced to their topics first, so companies and rules meet by topic.
    """
    has = lambda column, words: F.array_contains(F.transform(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(column), w)), True)
    listed = list(topics.items())
    side = lambda df, test: df.select("*", F.explode(F.filter(F.array(*[F.when(test(name, words), F.lit(i)) for i, (name, words) in enumerate(listed)]), lambda x: x.isNotNull())).alias("topic_no"))
    companies = side(exposures, lambda name, words: has(F.col("text"), words))
    tagged = side(rules, lambda name, words: has(F.col("title"), (name,)))
    label = F.element_at(F.array(*[F.lit(n) for n, _ in listed]), F.col("topic_no") + 1)
    met = companies.join(tagged.drop("text"), "topic_no").groupBy("cik", "rule_id").agg(F.min("topic_no").alias("topic_no"))
    return met.select("cik", "rule_id", label.alias("topic"))


#: Topics of rules and the keywords by which evidence has them, in order of precedence.
TOPICS = {
    "entity list": ("entity list",),
    "advanced computing": ("advanced computing", "ai chip", "accelerator"),
    "semiconductor manufacturing": ("manufacturing equipment", "semiconductor manufacturing"),
    "artificial intelligence": ("artificial intelligence", "ai diffusion"),
}


def exposure_text(risks: DataFrame, category: str = "Export Controls", texts: int = 5, length: int = 8000) -> DataFrame:
    """Per company its evidence ids and the first texts, by id, of its risks of a category, joined and cut.

    Each task keeps only the first few texts of a company, so none gathers them all.
    """
    from pyspark.sql import Window

    picked = risks.where(F.col("category") == category).select("cik", "chunk_id", "text").distinct()
    first = Window.partitionBy("cik").orderBy("chunk_id", "text")
    some = picked.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= texts)
    joined = some.groupBy("cik").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__r", F.concat(F.lit(" "), F.coalesce("text", F.lit(""))).alias("t")))), lambda x: x["t"]), "").alias("t"))
    counts = picked.groupBy("cik").agg(F.countDistinct("chunk_id").alias("n_chunks"))
    return joined.join(counts, "cik").select("cik", "n_chunks", F.left("t", F.lit(length)).alias("text"))


def compiled(names: list[str]) -> str:
    """One case-insensitive pattern for a list of names, for drivers that scan single strings."""
    if len(names) > ALIAS_BOUND:
        raise ValueError(f"{len(names)} names exceed the bound of {ALIAS_BOUND}")
    return r"(?i)\b(" + "|".join(re.escape(n) for n in sorted(names, key=len, reverse=True)) + r")\b"
