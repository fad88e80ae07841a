"""Streams against the same in batches, and JSON of attributes."""

import json

import pytest
from pyspark.sql import functions as F

from remembrix import plans
from remembrix.engine import MemoryEngine
from remembrix.functions import attrs, text
from remembrix.operators import evaluation
from remembrix.streaming import buffer

SF = "/root/testdata/sf0.001"


def test_verdicts_of_a_stream_are_those_of_its_batch(spark):
    rows = lambda name: sorted((r.id, r.verdict, r.neighbour or -1, r.salience) for r in plans.QUERIES[name](spark, SF).collect())
    assert rows("streaming_verdicts") == rows("consolidate")


def test_a_stream_fills_and_consolidates_the_engine(spark, tmp_path, monkeypatch):
    from remembrix import engine as module

    monkeypatch.setattr(module, "TRIGGER", 3)
    made = [(i, f"note {i} on {w}", ["a", "b"], "event", 100 + i) for i, w in enumerate("redis postgres kafka rust python docker".split())]
    df = spark.createDataFrame(made, "id bigint, text string, tags array<string>, kind string, created_s bigint")
    for k in range(2):
        df.filter(f"id % 2 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    clock = iter((1000, 2000))
    engine = MemoryEngine(spark)
    buffer.consolidate_batches(stream, buffer.into(engine, lambda: next(clock)), str(tmp_path / "state"), available_now=True).awaitTermination()
    assert engine.buffer.count() == 0 and engine.memories.count() == 6
    edges = {(r.src, r.dst, r.kind) for r in engine.edges.collect()}
    assert {e for e in edges if e[2] == "before"} == {(a, b, "before") for a in range(6) for b in range(6) if a < b}


def test_activation_fades_in_state_over_batches(spark, tmp_path):
    made = [(1, 1, 0, 0.5), (1, 2, 30, 0.25), (1, 3, 30, 0.9), (2, 4, 5, 0.1), (1, 5, 4000, 0.1)]
    df = spark.createDataFrame(made, "user_id bigint, event_id bigint, s bigint, rank double").withColumn("ts", F.timestamp_seconds("s"))
    for low, high in ((0, 2), (3, 5)):
        df.filter(f"event_id BETWEEN {low} AND {high}").coalesce(1).write.mode("append").parquet(str(tmp_path))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    got = {r.event_id: r.value for r in buffer.run_to_table(buffer.activation(stream)).collect()}
    after = 0.5 * 0.25 + 0.25
    second = min(1.0, after * 0.5 + 0.9)
    assert got == pytest.approx({1: 0.5, 2: after, 3: second, 4: 0.1, 5: second * 0.025 + 0.1})


def test_attributes_to_and_from_json(spark):
    held = {"price": 75.5, "city": 'Sea"ttle', "new": True, "tags": ["x", "y"], "n": -3}
    df = spark.createDataFrame([(json.dumps(held),), ("not json",), (None,), ("[1]",)], "t string").coalesce(1)
    rows = df.select(attrs.from_json(F.col("t")).alias("a")).select("a", attrs.plain_json(F.col("a")).alias("back"), attrs.outcome(F.col("a"), "price", attrs.Gt(60)).alias("o")).collect()
    assert json.loads(rows[0].back) == held and rows[0].o == attrs.MATCH
    assert [(r.back, r.o) for r in rows[1:]] == [("{}", attrs.NO_MATCH)] * 3


def test_answers_of_a_judge(spark):
    cases = {'x {"score": 0.8, "reason": "ok"} y': (1.0, "ok"), '{"score": 0.3}': (0.5, ""), '{"score": 0.1, "reason": "n"}': (0.0, "n"), "none": (None, ""), '{"score": "a"}': (None, ""), "} {": (None, "")}
    df = spark.createDataFrame([(k,) for k in cases], "a string").coalesce(1)
    assert [tuple(r.j) for r in df.select(text.judge_answer(F.col("a")).alias("j")).collect()] == list(cases.values())


def test_outcomes_without_picks(spark):
    picks = spark.createDataFrame([(1, 0, "the gold here", 5, "confident"), (1, 1, "x", 2, "confident"), (3, 0, "x", 2, "confident")], "query_id int, pick int, text string, token_count bigint, verdict string")
    cases = spark.createDataFrame([(1, "a", "Gold", False), (2, "a", "gold", False), (3, "b", "z", True), (4, "b", "z", True)], "query_id int, category string, gold string, expect_abstain boolean")
    rows = {r.category: tuple(r)[1:] for r in evaluation.outcome_report(evaluation.outcomes(picks, cases)).collect()}
    assert rows == {"a": (2, 1, 1, 0, 7, 7.0), "b": (2, 0, 0, 1, 2, None), "OVERALL": (2, 1, 1, 0, 7, 7.0)}
