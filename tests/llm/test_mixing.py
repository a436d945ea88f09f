import itertools
import random
import re

import pytest

from marlpit.llm.mixing import closest_subset, fit, mix


def test_knapsack_matches_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        sizes = rng.sample(range(1, 30), 4)
        counts = [rng.randrange(4) for _ in sizes]
        budget = rng.randrange(sum(s * n for s, n in zip(sizes, counts)) + 1)
        taken = closest_subset(sizes, counts, budget)
        assert all(0 <= k <= n for k, n in zip(taken, counts))
        best = min(abs(budget - sum(s * k for s, k in zip(sizes, ks))) for ks in itertools.product(*[range(n + 1) for n in counts]))
        assert abs(budget - sum(s * k for s, k in zip(sizes, taken))) == best


def test_fit_reaches_large_budgets():
    rng = random.Random(2)
    sizes = list(range(1, 3000))
    counts = [rng.randrange(50) for _ in sizes]
    total = sum(s * n for s, n in zip(sizes, counts))
    for target in (0.0, 0.3 * total, 1.0 * total, 1.77 * total, 2.0 * total):
        passes, extra = fit(sizes, counts, target, 2)
        assert all(0 <= k <= n for k, n in zip(extra, counts))
        assert abs(passes * total + sum(s * k for s, k in zip(sizes, extra)) - target) <= 1


def brute_targets(sizes, share, weights):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, got = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not full:
            return got | {s: level * weight[s] for s in open_}
        got |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2.0 * sizes[s] for s in full)
        open_ -= full
    return got


def test_mix(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        source = rng.choice(["a", "a", "a", "a", "B", "é", "\U0001f600", "￮", "", None])
        rows.append((i, " \t".join(["w x"] * rng.choice([0, 1, 5, 5, 17, rng.randrange(200)])), source, 0))
    rows += [(5, "x y", "a", 0)] * 3 + [(None, None, None, None), (9, "only", "one", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mix(docs, carry=["source"]).select("*", "carried.source").collect()
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for i, text, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = brute_targets(sizes, 1.5, (3, 1, 2))
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for source in sizes:
        assert abs(taken[source] - want[source]) <= 1, source
    again = mix(docs.repartition(7)).collect()
    assert sorted(map(str, ((r.doc_id, r.size, r.taken) for r in again))) == sorted(map(str, ((r.doc_id, r.size, r.taken) for r in got)))
    assert mix(docs.limit(0)).count() == 0
