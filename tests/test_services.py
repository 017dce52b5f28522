import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from evistrata.operators import embedding, evaluation, ledger
from evistrata.plans import adhoc


class Lengths:
    """An encoder for tests: the number of letters and of blanks."""

    dims = 2

    def __call__(self, texts):
        return np.array([[len(t), t.count(" ") + 1] for t in texts])


def test_passages_and_questions(spark):
    chunks = spark.createDataFrame([("a", "H", "some text"), ("b", None, "x"), ("c", None, None)], "chunk_id string, sub_heading string, text string")
    found = {r.chunk_id: r.embedding for r in embedding.encode_passages(chunks, Lengths(), batch=2).collect()}
    want = np.array([len("H\nsome text"), 2.0])
    assert np.allclose(found["a"], want / np.linalg.norm(want)) and len(found) == 3
    assert np.allclose(embedding.encode_question("q", Lengths(), "find: "), np.array([7, 2]) / np.sqrt(53))
    wrong = Lengths()
    wrong.dims = 3
    with pytest.raises(Exception, match="shape"):
        embedding.encode_passages(chunks, wrong).collect()
    same = embedding.encode_passages(chunks, Lengths())
    assert embedding.fidelity(same, same).head().least == pytest.approx(1.0)


def test_pooling():
    states = np.arange(12).reshape(2, 3, 2)
    assert embedding.pooled(states, np.array([[1, 1, 0], [0, 1, 1]])).tolist() == [[2, 3], [10, 11]]


def test_open_runs_are_answered(spark):
    questions = spark.createDataFrame([("q1", "one"), ("q2", "two")], "id string, prompt string")
    done = spark.createDataFrame([("q1", "hybrid")], "id string, system string")
    left = evaluation.open_runs(questions, ["hybrid", "vector"], done)
    found = embedding.answered(left, {"hybrid": str.upper, "vector": lambda p: p}).collect()
    assert sorted((r.id, r.system, r.answer) for r in found) == [("q1", "vector", "one"), ("q2", "hybrid", "TWO"), ("q2", "vector", "two")]


def test_reading_queries(spark, data):
    adhoc.register(spark, data, ["nation", "region"])
    rows = adhoc.run(spark, "WITH r AS (SELECT * FROM region WHERE r_name = :name) SELECT count(*) AS n FROM nation JOIN r ON n_regionkey = r_regionkey", name="ASIA").collect()
    assert len(rows) == 1
    assert adhoc.is_reading("select ';drop table x' as a -- ; drop\n") and not adhoc.is_reading("select 1; drop table x") and not adhoc.is_reading("insert into x select 1")
    with pytest.raises(ValueError):
        adhoc.run(spark, "DROP TABLE nation")


def test_policy_cache_and_ledger(spark):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    table = spark.createDataFrame([("switch", "off", datetime.datetime(2024, 1, 1))], "key string, value string, updated_at timestamp")
    assert [r.value for r in ledger.policy_value(ledger.with_policy(table, "switch", "on", now), "switch").collect()] == ["on"]
    answers = spark.createDataFrame([("a", "x", "live", datetime.datetime(2024, 1, 1)), ("b", "y", "benchmark", datetime.datetime(2020, 1, 1)), ("c", "z", "live", datetime.datetime(2020, 1, 1))], "key string, answer string, source string, created_at timestamp")
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "key string")
    assert sorted((r.key, r.hit) for r in ledger.answer_lookup(asked, answers, now, 24).collect()) == [("a", False), ("b", True), ("c", False), ("d", False)]
    assert sorted((r.key, r.hit) for r in ledger.answer_lookup(asked, answers, now, 25).collect())[0] == ("a", True)
    rows = spark.createDataFrame([("1", "d", True, None), ("2", "d", False, 0.25), ("3", "e", False, None)], "id string, day string, cached boolean, cost_usd double")
    assert {r.scope: (r.paid, r.cached, r.cost_usd) for r in ledger.ledger_summary(rows, F.lit("d")).collect()} == {"today": (1, 1, 0.25), "all_time": (2, 1, 0.25)}
    assert {r.scope: r.paid for r in ledger.ledger_summary(rows.limit(0), F.lit("d")).collect()} == {"today": 0, "all_time": 0}
    ok = spark.createDataFrame([("  Who  supplies X? ",), ("short",), (None,), ("x" * 500,)], "q string").select(ledger.acceptable_question(F.col("q")).alias("q"))
    assert [r.q for r in ok.collect()] == ["Who supplies X?", None, None, None]
    times, calls = iter([0, 10, 31]), []
    memory = ledger.Remembered(lambda: calls.append(1) or len(calls), 30, lambda: next(times))
    assert [memory.get() for _ in range(3)] == [1, 1, 2]
