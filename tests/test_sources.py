import datetime
import json

from pyspark.sql import functions as F

from evistrata import schemas
from evistrata.functions.text import short_hash
from evistrata.sources import files
from evistrata.streaming import limits


def test_jsonl(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"chunk_id": "a", "products": [{"name": "n", "type": "t"}]}\n\n{"chunk_id": "b"}\n')
    rows = files.read_jsonl(spark, str(path), schemas.LAKE["extractions"]).orderBy("chunk_id").collect()
    assert [r.chunk_id for r in rows] == ["a", "b"] and rows[0].products[0].name == "n" and rows[1].relations is None
    out = str(tmp_path / "log")
    for key in "cd":
        files.append_jsonl(spark.createDataFrame([(key,)], "chunk_id string"), out)
    assert files.read_jsonl(spark, out, "chunk_id string").count() == 2
    todo = spark.createDataFrame([("c",), ("e",)], "chunk_id string")
    assert [r.chunk_id for r in files.pending(todo, files.read_jsonl(spark, out, "chunk_id string"), "chunk_id").collect()] == ["e"]


def test_facts(spark, tmp_path):
    fact = {"start": "2023-01-30", "end": "2024-01-28", "val": 60922000000, "accn": "a", "fy": 2024, "fp": "FY", "form": "10-K", "filed": "2024-02-21"}
    document = {"cik": 7, "facts": {"us-gaap": {"Revenues": {"label": "Revenues", "units": {"USD": [fact, {**fact, "accn": "b"}], "EUR": [fact]}}}, "dei": {"X": {"units": {"shares": [fact]}}}}}
    (tmp_path / "CIK7.json").write_text(json.dumps(document, indent=1))
    read = files.read_facts(spark, str(tmp_path / "CIK7.json"))
    rows = read.collect()
    assert sorted((r.unit, r.accn) for r in rows) == [("EUR", "a"), ("USD", "a"), ("USD", "b")]
    assert {r.val for r in rows} == {60922000000.0} and rows[0].cik == 7
    again = files.flatten_facts(files.nest_facts(read))
    assert again.count() == 3


def test_manifest_and_pages(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"T": [{"accession_no": "1", "form": "10-K", "filing_date": "2024-01-01", "local_path": "old/place/f.htm"}], "U": []}))
    manifest = files.read_manifest(spark, str(tmp_path / "m.json"))
    assert [(r.ticker, r.accession_no) for r in manifest.collect()] == [("T", "1")]
    (tmp_path / "html").mkdir()
    (tmp_path / "html" / "f.htm").write_text("<p>x</p>")
    assert [r.html for r in files.read_pages(spark, manifest, str(tmp_path / "html")).collect()] == ["<p>x</p>"]
    for folder in ("b", "place"):  # the same name in other folders
        (tmp_path / "html" / folder).mkdir()
        (tmp_path / "html" / folder / "f.htm").write_text(folder)
    assert [r.html for r in files.read_pages(spark, manifest, str(tmp_path / "html")).collect()] == ["place"]
    new = spark.createDataFrame([("T", "1"), ("T", "2")], "ticker string, accession_no string")
    merged = files.merge_manifest(manifest, schemas.conform(new, schemas.LAKE["manifest"]))
    files.write_manifest(merged, str(tmp_path / "out"))
    assert merged.count() == 2 and spark.read.text(str(tmp_path / "out")).count() == 1


def test_results_and_writers(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"results": [{"document_number": "1", "title": "t", "publication_date": "2024-01-01"}]}))
    rules = files.read_results(spark, str(tmp_path / "r.json"))
    assert rules.head().title == "t"
    files.write_parquet(rules, str(tmp_path / "p"), ["title", "document_number"])
    files.write_if_absent(rules.limit(0), str(tmp_path / "p"))
    assert files.read_parquet(spark, str(tmp_path / "p")).columns == ["title", "document_number"] and files.read_parquet(spark, str(tmp_path / "p")).count() == 1
    files.write_json_report(rules.select("title", "abstract"), str(tmp_path / "j"))
    assert json.loads(spark.read.text(str(tmp_path / "j")).head()[0]) == {"title": "t", "abstract": None}


def test_vector_cache_and_retries(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "chunk_id string")
    cache = spark.createDataFrame([("a", [1.0]), ("z", [2.0])], "chunk_id string, embedding array<float>")
    asked = []

    def encode(df):
        asked.append([r.chunk_id for r in df.collect()])
        return df.withColumn("embedding", F.array(F.lit(3.0).cast("float")))

    found = {r.chunk_id: r.embedding for r in files.with_cached_vectors(rows, cache, encode).collect()}
    assert found == {"a": [1.0], "b": [3.0]} and asked == [["b"]]
    texts = rows.withColumn("text", F.col("chunk_id"))
    held = texts.withColumns({"text_hash": short_hash(F.lit("a")), "embedding": F.array(F.lit(1.0).cast("float"))}).drop("text")
    found = files.with_cached_vectors(texts, held, encode)  # the text of b is another than was encoded
    assert {r.chunk_id: r.embedding for r in found.collect()} == {"a": [1.0], "b": [3.0]} and found.columns == ["chunk_id", "text_hash", "embedding"]
    calls, pauses = [], []

    def fetch():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert files.retrying(fetch, sleep=pauses.append)() == "ok" and pauses == [5, 15]


def test_selection(spark):
    rows = [("T", "10-K", "2017-01-01", "a"), ("T", "10-K", "2020-01-01", "b"), ("T", "10-Q", "2020-05-01", "c"), ("T", "10-Q", "2020-08-01", "d")]
    df = spark.createDataFrame(rows, "ticker string, form string, filing_date string, accession_no string")
    assert sorted(r.accession_no for r in files.select_filings(df, annual_since=2018).collect()) == ["b", "d"]


def test_streams(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    rows = [(str(i), f"u{i % 2}", base + datetime.timedelta(minutes=i), i) for i in range(20)]
    kind = "event string, user string, ts timestamp, value int"
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(kind).parquet(source)
    limited = limits.rate_limited_stream(stream, key="user", at="ts", event="event", most=3, window_seconds=600)
    q = limited.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.event: r.allowed for r in spark.table("limited").collect()}
    from evistrata.operators.limits import rate_limited

    batch = rate_limited(spark.createDataFrame(rows, kind), key="user", at="ts", most=3, window_seconds=600, order="event")
    assert got == {r.event: r.allowed for r in batch.collect()}
    out = str(tmp_path / "out")
    for _ in range(2):
        limits.append_once(stream, out, str(tmp_path / "c2"), key="event").awaitTermination(120)
    spark.createDataFrame(rows[:5], kind).coalesce(1).write.mode("append").parquet(source)
    limits.append_once(stream, out, str(tmp_path / "c2"), key="event").awaitTermination(120)
    assert spark.read.parquet(out).count() == 20
    days = limits.daily_counts_stream(stream, at="ts").writeStream.format("memory").queryName("days").outputMode("complete").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    days.awaitTermination(120)
    assert [r.n for r in spark.table("days").collect()] == [25]
