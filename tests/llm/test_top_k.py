import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlpit.llm import top_k
from marlpit.llm.top_k import top_inner_products


def brute(rows, k):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v in kept), default=0)
    kept = [(i, v + [0] * (width - len(v))) for i, v in kept]
    out = []
    for a, (i, q) in enumerate(kept):
        if i is not None and i % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(q, v)), math.inf if j is None else j) for b, (j, v) in enumerate(kept) if a != b)
            out += [(i, r + 1, None if j == math.inf else j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("shape", ["even", "skewed"])
def test_matches_brute_force(spark, monkeypatch, shape):
    for name, n in {"SHARD": 150 * 16, "GROUP": 5 * 16, "PILOT": 20 * 16, "BLOCK": 32}.items():
        monkeypatch.setattr(top_k, name, n)
    data = np.random.default_rng(3)
    x = data.normal(size=(700, 16))
    if shape == "skewed":
        x = x * np.geomspace(1, 0.01, 16) * data.gamma(1.0, size=(700, 1))
    rows = [(i, [float(v) for v in np.float32(row)]) for i, row in enumerate(x)]
    rows += [(50, rows[50][1]), (50, rows[3][1]), (1000, None), (1050, [1.0, None]), (1100, [float("nan")] * 16), (1150, [float("inf")] * 16), (1200, [0.0] * 16), (1250, [1.0, -1.0]), (None, rows[7][1]), (1300, [])]
    rows += [(2000 + k, rows[100][1]) for k in range(8)]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = top_inner_products(table, F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 5)


def test_few_rows(spark):
    table = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in top_inner_products(table, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 256 * 512)]
    assert top_inner_products(table.filter("vec_id = 1"), F.col("vec_id") % 50 == 0).count() == 0
    assert top_inner_products(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_wide_vectors_have_smaller_shards(spark, monkeypatch):
    """1,024 columns: shards are bounded by their components, not by rows."""
    made = []
    kept = top_k.packed
    monkeypatch.setattr(top_k, "packed", lambda rows, by, more="": (made.append((by, rows.select(by).distinct().count())), kept(rows, by, more))[1])
    data = np.random.default_rng(5).normal(size=(1200, 1024))
    rows = [(i, [float(v) for v in np.float32(row)]) for i, row in enumerate(data)]
    got = top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()
    assert dict(made)["shard"] == math.ceil(1200 * 1024 / top_k.SHARD) > 1
    whole = np.floor(256 * np.float32(data).astype(float)).astype(np.int64)
    scores = whole[::50] @ whole.T
    for r in got:
        assert scores[r.query_id // 50, r.vec_id] == r.score
    for q in range(24):
        scores[q, 50 * q] = np.iinfo(np.int64).min
    assert sorted((r.query_id, -r.rank, r.score) for r in got) == sorted((50 * q, -k - 1, s) for q in range(24) for k, s in enumerate(np.sort(scores[q])[::-1][:5].tolist()))


def test_cells_are_not_broadcast(spark, monkeypatch):
    """The queries of all cells grow with queries times shards: they are dealt out, and not sent through the driver."""
    for name, n in {"SHARD": 150 * 16, "GROUP": 5 * 16}.items():
        monkeypatch.setattr(top_k, name, n)
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(np.random.default_rng(7).normal(size=(400, 16)))]
    got = top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0)
    assert len(got.collect()) == 40
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
