"""Every core query that has SQL gives the SQL's rows, on the smallest supplied tables."""

import pytest

from evistrata.plans import hybrid, knowledge, registry
from tests.oracle import connect, duck_rows, spark_rows

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, name):
    names, got = spark_rows(QUERIES[name](spark, data))
    wanted_names, want = duck_rows(connect(data), SQL[name])
    assert names == wanted_names
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    QUERIES[name](spark, data).collect()


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_reads_the_resolved_graph(spark, data, tmp_path):
    edges = hybrid.graph_tables(spark, data, hybrid.ANCHORS).edges
    assert edges.count() == knowledge.resolved_graph(spark, data).count() > knowledge.relation_graph(spark, data).count()
    relation = "source_entity:string,relation:string,target_entity:string,evidence_quote:string"
    tables = {
        "canonical_entities": ([(1, "Nvidia", "NVDA", ["nvidia corp"]), (2, "Taiwan Semiconductor Manufacturing", "TSM", [])], "entity_id long, name string, ticker string, aliases array<string>"),
        "chunks": ([("c", "2024-01-05")], "chunk_id string, filing_date string"),
        "extractions": ([(1, "c", "NVDA", [("We", "depends_on", "Taiwan Semiconductor Manufacturng, Ltd.", "q"), ("Intel", "DEPENDS_ON", "Nvidia", "q")])], f"record_no long, chunk_id string, ticker string, relations array<struct<{relation}>>"),
    }
    for name, (rows, kind) in tables.items():
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    assert [(r.src, r.rel, r.dst) for r in knowledge.resolved_graph(spark, str(tmp_path)).collect()] == [(1, "DEPENDS_ON", 2)]
    assert knowledge.relation_graph(spark, str(tmp_path)).count() == 0
