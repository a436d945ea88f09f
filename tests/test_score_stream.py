"""The stream of scores against the same scores taken at once."""

import random

import pytest
from pyspark.sql import functions as F

from marlpit.operators import agents
from marlpit.streaming import scores

SCHEMA = "agent string, document_id string, score double"


def put(spark, source, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)


def run(spark, source, folder, checkpoint):
    scores.score_stream(spark.readStream.schema(SCHEMA).parquet(source), folder, checkpoint).awaitTermination()
    return {r.agent: (r.documents, r.confidence) for r in scores.agent_levels(spark, folder).collect()}


def at_once(spark, known):
    """Levels by the operators that take all documents of an agent as a table."""
    out = {}
    for agent in {a for a, _ in known}:
        docs = spark.createDataFrame([(d, "") for a, d in known if a == agent], "document_id string, content string")
        held = agents.add_knowledge(spark.createDataFrame([], agents.KNOWLEDGE), docs)
        after, _ = agents.update_scores(held, spark.createDataFrame([(d, s) for (a, d), s in known.items() if a == agent], "document_id string, score double"))
        out[agent] = (after.count(), agents.agent_level(after, "SPM Agent").first().confidence)
    return out


def test_stream_equals_all_at_once_after_restarts(spark, tmp_path):
    source, folder, checkpoint = (str(tmp_path / x) for x in ("in", "out", "c"))
    draw, known = random.Random(3), {}
    for turn in range(3):
        rows = [("hot" if draw.random() < 0.8 else f"a{draw.randrange(3)}", f"d{draw.randrange(25)}", round(draw.random() * (0.4 + 0.3 * turn), 3)) for _ in range(40)]
        batch = {}
        for agent, document, score in rows:
            batch[agent, document] = max(score, batch.get((agent, document), 0.0))
        known |= batch
        put(spark, source, rows + [(None, "d1", 1.0), ("hot", None, 1.0), ("hot", "d1", None), ("hot", "d2", float("nan"))][: 4 if turn == 1 else 0])
        got = run(spark, source, folder, checkpoint)  # a query of its own each time, from the checkpoint
        assert got == at_once(spark, known)
    assert run(spark, source, folder, checkpoint) == got


def test_a_failed_batch_comes_again_and_counts_once(spark, tmp_path, monkeypatch):
    source, folder, checkpoint = (str(tmp_path / x) for x in ("in", "out", "c"))
    put(spark, source, [("a", "d1", 0.5), ("b", "d1", 0.25)])
    run(spark, source, folder, checkpoint)
    put(spark, source, [("a", "d1", 0.9), ("a", "d2", 0.7)])
    own = scores.store

    def store_then_fail(*args):
        own(*args)
        raise RuntimeError("lost after the sums were stored")

    monkeypatch.setattr(scores, "store", store_then_fail)
    with pytest.raises(Exception, match="lost after"):
        run(spark, source, folder, checkpoint)
    monkeypatch.setattr(scores, "store", own)
    assert run(spark, source, folder, checkpoint) == {"a": (2, 8), "b": (1, 2)}


def test_no_input_gives_no_agents(spark, tmp_path):
    source, folder, checkpoint = (str(tmp_path / x) for x in ("in", "out", "c"))
    put(spark, source, [])
    assert run(spark, source, folder, checkpoint) == {}
    assert scores.agent_levels(spark, folder).filter(F.col("documents") > 0).count() == 0
