import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlpit.operators import vector_index as vi
from marlpit.sources import tables

rng = np.random.default_rng(4)


def made(n, width=8, groups=6):
    """Vectors around some directions, of any length."""
    middle = rng.normal(size=(groups, width))
    own = middle[rng.integers(0, groups, n)] + 0.3 * rng.normal(size=(n, width))
    return own * rng.gamma(2.0, size=(n, 1))


def brute(held, queries, top):
    out = []
    for q, x in queries.items():
        length = math.sqrt(sum(a * a for a in x)) if x else 0
        if not length:
            continue
        scored = sorted((-round(sum(a * b for a, b in zip(x, v)) / length / math.sqrt(sum(b * b for b in v)), 6), k) for k, v in held.items() if any(v))
        out += [(q, r + 1, k, -s) for r, (s, k) in enumerate(scored[:top])]
    return sorted(out)


def check(spark, folder, held, queries, top=5):
    asked = spark.createDataFrame(list(queries.items()), "item int, v array<double>")
    got = sorted((r.item, r["rank"], r.chunk_id, r.score) for r in vi.search_vectors(spark, folder, asked, "item", "v", top).collect())
    want = brute(held, queries, top)
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], atol=2e-6)


@pytest.fixture
def small(monkeypatch):
    for name, value in (("CELL", 40), ("RING", 8), ("TOGETHER", 16), ("PILOT", 30), ("SAMPLE", 300)):
        monkeypatch.setattr(vi, name, value)


def frame(spark, held):
    return spark.createDataFrame(list(held.items()), "chunk_id string, embedding array<double>")


def test_many_queries_equal_brute_force_after_updates(spark, tmp_path, small, monkeypatch):
    monkeypatch.setattr(tables, "VERSIONS_MOST", 3)
    folder = str(tmp_path)
    held = {f"c{k:04d}": v.tolist() for k, v in enumerate(made(600))}
    held |= {f"same{k}": held["c0007"] for k in range(12)} | {"zero": [0.0] * 8}
    queries = {k: v.tolist() for k, v in enumerate(made(200))} | {300: held["c0007"], 301: [0.0] * 8}
    vi.update_vectors(spark, folder, frame(spark, held))
    check(spark, folder, held, queries)
    for step in range(3):
        late = {f"c{k:04d}": v.tolist() for k, v in zip(random.Random(step).sample(range(700), 60), made(60), strict=True)}
        vi.update_vectors(spark, folder, frame(spark, late))
        held |= late
        if step:
            check(spark, folder, held, queries)
    before = len(vi._found(spark, folder))
    monkeypatch.setattr(tables, "mark_complete", lambda *x: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        vi.update_vectors(spark, folder, frame(spark, {"c0001": held["c0002"]}))
    monkeypatch.undo()
    assert len(vi._found(spark, folder)) == before
    vi.compact_vectors(spark, folder)
    assert len(vi._found(spark, folder)) == 1
    check(spark, folder, held, queries)


def test_rings_that_cannot_reach_the_floor_are_left_out(spark, tmp_path, small):
    """Vectors in narrow groups: a query of one group reads little of the others."""
    held = {f"c{k:04d}": v.tolist() for k, v in enumerate(made(900, 16, 30))}
    vi.update_vectors(spark, str(tmp_path), frame(spark, held))
    asked = spark.createDataFrame([(k, held[f"c{k:04d}"]) for k in range(0, 900, 30)], "item int, v array<double>")
    share = vi.share_read(spark, str(tmp_path), asked, "item", "v")
    assert 0 < share < 0.5


def test_without_vectors(spark, tmp_path):
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "item int, v array<double>")
    assert vi.search_vectors(spark, str(tmp_path), asked, "item", "v").count() == 0
    vi.update_vectors(spark, str(tmp_path), frame(spark, {}))
    vi.update_vectors(spark, str(tmp_path), frame(spark, {"a": [0.0, 0.0]}))
    assert vi.search_vectors(spark, str(tmp_path), asked, "item", "v").count() == 0
    vi.update_vectors(spark, str(tmp_path), frame(spark, {"a": [2.0, 0.0], "b": [float("nan"), 1.0]}).unionByName(frame(spark, {"c": [0.0, 1.0]})))
    got = vi.search_vectors(spark, str(tmp_path), asked.union(asked.withColumn("v", F.lit(None).cast("array<double>")).withColumn("item", F.lit(2))), "item", "v").collect()
    assert [(r.item, r.chunk_id, r.score) for r in got] == [(1, "a", 1.0), (1, "c", 0.0)]


def test_queries_choose_cells_in_pieces():
    """A query makes a row for each cell: what a task holds at once doesn't grow with queries times cells."""
    batch = pa.RecordBatch.from_pydict({"q": list(range(40))})
    found = list(vi.pieces(iter([batch, batch.slice(0, 0)]), vi.CHOOSING))
    assert [x.num_rows for x in found] == [16, 16, 8]
    assert [q for x in found for q in x.column("q").to_pylist()] == list(range(40))
