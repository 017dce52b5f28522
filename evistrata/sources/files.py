"""Readers and writers of the lake. Reading is lazy; nothing is collected."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from evistrata import schemas
from evistrata.functions.text import short_hash


def read_parquet(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def write_parquet(df: DataFrame, path: str, columns: Sequence[str] | None = None, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Overwrite ``path`` with the given columns in the given order."""
    (df.select(*columns) if columns else df).write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_if_absent(df: DataFrame, path: str) -> None:
    """Write only if nothing is there yet; a finished output is left alone."""
    df.write.mode("ignore").parquet(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are skipped, missing fields are null."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_json_report(df: DataFrame, path: str) -> None:
    """One JSON file of a small, aggregated result; nulls are written."""
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


_FACT = "struct<start:string,end:string,val:double,accn:string,fy:int,fp:string,form:string,filed:string,frame:string>"
_FACTS = f"cik long, facts map<string,map<string,struct<label:string,units:map<string,array<{_FACT}>>>>>"


def flatten_facts(documents: DataFrame, value: str = "value", taxonomies: Sequence[str] = ("us-gaap", "ifrs-full")) -> DataFrame:
    """Nested fact documents, whose taxonomy, concept and unit are keys, as one row per reported fact."""
    parsed = documents.select(F.from_json(value, _FACTS).alias("d"))
    per_taxonomy = parsed.select(F.col("d.cik").alias("cik"), F.explode("d.facts").alias("taxonomy", "concepts")).where(F.col("taxonomy").isin(*taxonomies))
    per_concept = per_taxonomy.select("cik", "taxonomy", F.explode("concepts").alias("concept", "c"))
    per_unit = per_concept.select("cik", "taxonomy", "concept", F.col("c.label").alias("label"), F.explode("c.units").alias("unit", "list"))
    return per_unit.select("cik", "taxonomy", "concept", "label", "unit", F.explode("list").alias("f")).select(
        "cik", "taxonomy", "concept", "label", "unit", F.col("f.start").alias("period_start"), F.col("f.end").alias("period_end"),
        "f.val", "f.accn", "f.fy", "f.fp", "f.form", "f.filed", "f.frame",
    )


def read_facts(spark: SparkSession, path: str, **options) -> DataFrame:
    return flatten_facts(spark.read.text(path, wholetext=True), **options)


def nest_facts(facts: DataFrame) -> DataFrame:
    """The opposite of ``flatten_facts``: one JSON document ``value`` per cik."""
    fact = F.struct(F.col("period_start").alias("start"), F.col("period_end").alias("end"), "val", "accn", "fy", "fp", "form", "filed", "frame")
    units = facts.groupBy("cik", "taxonomy", "concept", "unit").agg(F.collect_list(fact).alias("list"))
    concepts = units.groupBy("cik", "taxonomy", "concept").agg(F.map_from_entries(F.collect_list(F.struct("unit", "list"))).alias("units"))
    taxonomies = concepts.groupBy("cik", "taxonomy").agg(F.map_from_entries(F.collect_list(F.struct("concept", F.struct("units")))).alias("concepts"))
    whole = taxonomies.groupBy("cik").agg(F.map_from_entries(F.collect_list(F.struct("taxonomy", "concepts"))).alias("facts"))
    return whole.select("cik", F.to_json(F.struct("cik", "facts")).alias("value"))


def read_results(spark: SparkSession, path: str, schema: str = schemas.LAKE["rules"]) -> DataFrame:
    """Documents of the form ``{"results": [...]}``, one row per result."""
    row = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in schemas.fields(schema))
    return spark.read.schema(f"results array<struct<{row}>>").json(path, multiLine=True).select(F.explode("results").alias("r")).select("r.*")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON map from ticker to its filings as one row per filing."""
    kind = T.MapType(T.StringType(), T.ArrayType(schemas.fields(schemas.LAKE["manifest"])))
    parsed = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("key", "rows"))
    rows = parsed.select("key", F.explode("rows").alias("r")).select("key", "r.*")
    return rows.withColumn("ticker", F.coalesce("ticker", "key")).drop("key")


def write_manifest(manifest: DataFrame, path: str) -> None:
    """The manifest as a JSON map, one line per ticker, newest filings first."""
    row = F.struct(*[f.name for f in schemas.fields(schemas.LAKE["manifest"])])
    grouped = manifest.groupBy("ticker").agg(F.reverse(F.array_sort(F.collect_list(F.struct("filing_date", "accession_no", row.alias("row"))))).alias("rows"))
    entries = grouped.select(F.to_json(F.map_from_arrays(F.array("ticker"), F.array(F.transform("rows", lambda r: r["row"])))).alias("value"))
    entries.coalesce(1).write.mode("overwrite").text(path)


def merge_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """Known filings stay; filings of unknown accession are added."""
    return old.unionByName(new.join(old.select("accession_no"), "accession_no", "left_anti").select(*old.columns))


def read_pages(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """The HTML of every filing of the manifest, one row per filing, found by its local path.

    Folders differ between machines, so a filing's file is the one of its name whose path ends like the
    local path for the most parts; of equals the first by path. Only paths are compared, texts join last.
    """
    from pyspark.sql import Window

    files = spark.read.option("recursiveFileLookup", "true").format("binaryFile").load(folder)
    parts = lambda c: F.reverse(F.split(c, "/"))
    rows = manifest.select("accession_no", "local_path").distinct().withColumn("a", parts(F.col("local_path"))).withColumn("file", F.get("a", 0))
    met = rows.join(files.select("path").withColumn("b", parts(F.col("path"))).withColumn("file", F.get("b", 0)), "file")
    same = F.zip_with("a", "b", lambda x, y: F.coalesce(x == y, F.lit(False)))
    alike = F.when(F.array_contains(same, False), F.array_position(same, False) - 1).otherwise(F.size(same))
    best = Window.partitionBy("accession_no", "local_path").orderBy(F.desc("alike"), "path")
    found = met.withColumn("alike", alike).withColumn("r", F.row_number().over(best)).where("r = 1").select("accession_no", "local_path", "path")
    pages = manifest.join(found, ["accession_no", "local_path"])
    return pages.join(files.select("path", F.col("content").cast("string").alias("html")), "path").drop("path")


def select_filings(filings: DataFrame, *, annual_since: int, annual_forms: Sequence[str] = ("10-K", "20-F"), quarterly_forms: Sequence[str] = ("10-Q",)) -> DataFrame:
    """What is worth fetching: annual filings since a year, and the latest quarterly one per ticker."""
    from pyspark.sql import Window

    day = F.to_date("filing_date")
    annual = filings.where(F.col("form").isin(*annual_forms) & (F.year(day) >= annual_since))
    latest = Window.partitionBy("ticker").orderBy(F.desc(day), F.desc("accession_no"))
    quarterly = filings.where(F.col("form").isin(*quarterly_forms)).withColumn("__r", F.row_number().over(latest)).where("__r = 1").drop("__r")
    return annual.unionByName(quarterly)


def pending(todo: DataFrame, done: DataFrame, *key: str) -> DataFrame:
    """The rows of ``todo`` whose key is not among those of ``done``: what a resumed run has left."""
    return todo.join(done.select(*key).distinct(), list(key), "left_anti")


def with_cached_vectors(rows: DataFrame, cache: DataFrame, encode: Callable[[DataFrame], DataFrame], key: str = "chunk_id", text: str = "text") -> DataFrame:
    """``key`` and ``embedding`` of all rows; only what is missing from the cache is encoded.

    A cache with a ``text_hash`` (``short_hash`` of the text) holds only for texts that are unchanged, and the
    hash is given again for the next one.
    """
    on = [key]
    if "text_hash" in cache.columns:
        on, rows = [key, "text_hash"], rows.withColumn("text_hash", short_hash(F.col(text)))
    wanted = rows.select(*on).distinct()
    fresh = encode(pending(rows, cache, *on)).select(key, "embedding").join(wanted, key)
    return cache.join(wanted, on, "left_semi").select(*on, "embedding").unionByName(fresh.select(*on, "embedding"))


def retrying(fetch: Callable[..., object], waits: Sequence[float] = (5, 15, 45), sleep: Callable[[float], None] = time.sleep) -> Callable[..., object]:
    """``fetch`` with a pause before each further attempt; the last failure is raised. Connectors to
    remote archives take their ``fetch`` from the caller: this package opens no network connection."""

    def attempt(*args, **kwargs):
        for wait in waits:
            try:
                return fetch(*args, **kwargs)
            except OSError:
                sleep(wait)
        return fetch(*args, **kwargs)

    return attempt
