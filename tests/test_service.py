import pytest
from pyspark.sql import functions as F

from marlpit.operators import agents
from marlpit.plans.service import QueryRequest, health, query_documents


def test_requests(spark):
    rows = [(f"D{i}", "the plan " * i + "text", "a" if i % 2 else "b", "report") for i in range(1, 13)]
    docs = spark.createDataFrame(rows, "document_id string, text string, team_owner string, document_type string")
    for limit, n in ((3, 3), (5, 5), (10, 5)):
        found = query_documents(docs, QueryRequest("plan text", limit=limit))
        assert found.total_results == n == len(found.results) and found.execution_time_ms > 0
        assert [r["score"] for r in found.results] == sorted((r["score"] for r in found.results), reverse=True)
    only = query_documents(docs, QueryRequest("plan", team_id="b", limit=100))
    assert only.total_results == 5 and all(int(r["document_id"][1:]) % 2 == 0 for r in only.results)
    assert query_documents(docs, QueryRequest("plan", doc_type="policy")).results == []
    with pytest.raises(ValueError):
        QueryRequest("x", limit=0)
    assert health()["status"] == "healthy"


def test_agents(spark):
    known = agents.add_knowledge(spark.createDataFrame([("a", "old", 0.9, 9)], agents.KNOWLEDGE), spark.createDataFrame([("a", "new"), ("b", "b")], "document_id string, content string"))
    assert sorted(map(tuple, known.collect())) == [("a", "new", 0.0, 0), ("b", "b", 0.0, 0)]
    after, said = agents.update_scores(known, spark.createDataFrame([("a", 1.25), ("a", 0.5), ("z", 0.5)], "document_id string, score double"))
    assert sorted(map(tuple, after.collect())) == [("a", "new", 1.25, 12), ("b", "b", 0.0, 0)]
    assert sorted(map(tuple, said.collect())) == [("a", 12), ("z", 0)]
    assert agents.agent_level(after, "SPM Agent").first().confidence == 6 and agents.agent_level(after, "Other").first().confidence == 0
    assert agents.agent_level(after.limit(0), "SPM Agent").first().confidence == 0


def test_repeated_keys_fail(spark):
    teams = spark.createDataFrame([("t1", "a"), ("t2", "b")], "id string, name string")
    assert agents.without_repeats(teams, ["id"], "team").count() == 2
    with pytest.raises(Exception, match="team exists already: t1"):
        agents.without_repeats(teams.unionByName(teams.filter(F.col("id") == "t1")), ["id"], "team").collect()
