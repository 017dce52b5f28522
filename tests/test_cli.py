import pytest
from pyspark.sql import functions as F

from evistrata import cli


def test_stages(spark, data, tmp_path):
    base = lambda n: f"{data}/{n}.parquet"
    out = str(tmp_path)
    rows = [("d", "10-K", i, k, t) for i, (k, t) in enumerate([("TitleElement", "Item 1. Business"), ("TextElement", "we make chips"), ("TableElement", "| a |")])]
    spark.createDataFrame(rows, "accession_no string, form string, element_index int, element_type string, text string").write.parquet(f"{out}/elements")
    cli.main(["ingest", f"{out}/elements", "--out", out, "--kept"])
    assert spark.read.parquet(f"{out}/chunks").count() == 2
    cli.main(["curate", base("xbrl_facts"), "--concepts", base("concept_map"), "--out", out])
    cli.main(["build", base("extractions"), "--entities", base("canonical_entities"), "--chunks", base("chunks"), "--out", out])
    assert spark.read.parquet(f"{out}/edges").count() > 0 and spark.read.parquet(f"{out}/mentions").count() > 0
    risks = spark.createDataFrame([("r", 1, "2020-01-01", "a", [1.0, 0.0]), ("s", 1, "2021-01-01", "b", [0.0, 1.0])], "risk_id string, cik long, filing_date string, accession_no string, embedding array<float>")
    risks.write.parquet(f"{out}/risks")
    cli.main(["temporal", f"{out}/risks", "--out", out])
    assert spark.read.parquet(f"{out}/states").where(F.col("status") == "Deleted").count() == 1
    cli.main(["query", data, "--name", "metric_first_disclosure", "--out", f"{out}/q"])
    cli.main(["query", data, "--name", "paid_today"])
    with pytest.raises(SystemExit):
        cli.main(["query", data, "--name", "nothing"])
    spark.createDataFrame([("n", "s", "5 million", ["a"], ["a"])], "id string, system string, answer string, cited array<string>, hallucinated array<string>").write.parquet(f"{out}/runs")
    spark.createDataFrame([("n", "numeric", 5e6, None)], "id string, type string, value double, any_of array<string>").write.parquet(f"{out}/bench")
    cli.main(["eval", f"{out}/runs", "--benchmark", f"{out}/bench", "--out", out])
    assert spark.read.parquet(f"{out}/failures").head().label == "FORMAT_OR_CITATION"
