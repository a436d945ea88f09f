import hashlib
import math
import random

import numpy as np

from marlpit.llm.sort_means import nearest, sort_means


def plain_means(rows, k, rounds, width, scale, seed):
    """Every vector against every centroid, in Python's whole numbers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    drawn = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in drawn[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(centroids)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = {}
    for _, c, d in found:
        inertia[c] = inertia.get(c, 0) + d
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), digests[c]) for i, c, d in found), key=str)


def rows_of(spark, rows, element="float"):
    return spark.createDataFrame([(i, v, 9, 9) for i, v in rows], f"vec_id long, embedding array<{element}>, cluster int, whole int")


def test_against_all_distances(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(3 * (i % 4), 1) for _ in range(3)]) for i in range(300)]
    rows += [(i, [float(rng.randint(0, 1)) for _ in range(3)]) for i in range(300, 400)]  # ties
    rows += [(7, [0.5, 0.5, 0.5])] * 40 + [(None, [1.0, 1.0, 1.0]), (None, [2.0, 1.0, 1.0])]
    rows += [(500, None), (501, []), (502, [1.0, 2.0]), (503, [1.0, None, 1.0]), (504, [1.0, float("nan"), 1.0]), (505, [float("inf"), 0.0, 0.0]), (506, [0.0] * 4)]
    docs = rows_of(spark, rows, "double")
    for rounds in (0, 1, 4, 7):
        got = sort_means(docs.repartition(3), k=5, rounds=rounds, width=3, scale=4.0, seed=3).collect()
        assert sorted((tuple(r) for r in got), key=str) == plain_means(rows, 5, rounds, 3, 4.0, 3)
    assert sort_means(docs.limit(0), width=3).count() == 0
    assert sort_means(docs.filter("vec_id = 500"), width=3).count() == 0


def test_few_vectors_and_equal_ones(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0])]
    got = sorted(tuple(r) for r in sort_means(rows_of(spark, rows), k=8, width=2).collect())
    assert [r[:5] for r in got] == [(1, 0, 0, 0, 0), (2, 0, 0, 0, 0)]


def test_large_components_are_exact(spark):
    rows = [(1, [2.0**28, 0.0]), (2, [-(2.0**28), 1.0]), (3, [2.0**28 - 1, 0.0]), (4, [3.0, 4.0]), (5, [1e300, 0.0]), (6, [-1e300, 0.0])]
    got = {r.vec_id: r for r in sort_means(rows_of(spark, rows, "double"), k=2, rounds=2, width=2, scale=1.0).collect()}
    assert len(got) == 6 and all(0 <= r.distance <= 2**63 - 1 for r in got.values())
    small = rows[:4]
    got = sorted(tuple(r) for r in sort_means(rows_of(spark, small, "double"), k=2, rounds=2, width=2, scale=1.0).collect())
    assert got == plain_means(small, 2, 2, 2, 1.0, 3)


def test_far_centroids_are_not_looked_at():
    rng = np.random.default_rng(1)
    centroids = rng.integers(-5000, 5000, (8, 16))
    previous = rng.integers(0, 8, 2000)
    vectors = centroids[previous] + rng.integers(-50, 50, (2000, 16))
    cluster, distance, looked = nearest(vectors, previous, centroids)
    every = ((vectors[:, None] - centroids[None]) ** 2).sum(2)
    assert (cluster == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert looked < 3000
