import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlpit.llm import near_dedup
from marlpit.llm.near_dedup import VALUES, components, crowded, going_on, joined_up, least_hits, near_duplicates, one_of_each, open_pairs, open_places, shingles, signature

rng = random.Random(11)
WORDS = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(900)]


def brute_set(text, width):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1)))


def brute(rows, width):
    sets = [brute_set(t, width) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        least[g] = min(i, least.get(g, i))
    return sorted((i, len(s), least[g], i == least[g]) for (i, _), s, g in zip(rows, sets, group, strict=True))


def changed(words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return words


def corpus():
    rows, i = [], 100
    for _ in range(25):
        base = [rng.choice(WORDS) for _ in range(rng.choice([3, 8, 40, 120]))]
        for _ in range(rng.randrange(1, 9)):
            rows.append((i, " ".join(changed(base, rng.randrange(4)) if len(base) > 8 else base)))
            i += 1
    chain = [rng.choice(WORDS) for _ in range(80)]  # neighbours are linked, ends are not
    for _ in range(30):
        chain = changed(chain, 1)
        rows.append((i, " ".join(chain)))
        i += 1
    passage = " ".join(rng.choice(WORDS) for _ in range(60))  # shared, but no link
    for _ in range(40):
        rows.append((i, passage + " " + " ".join(rng.choice(WORDS) for _ in range(rng.randrange(8, 30)))))
        i += 1
    rows += [(i + k, t) for k, t in enumerate(["", None, " \n\t", "one two", "ONE  two", "one two three", "é É", "É É", "a b c d", "A b\x0bc D", "one two\x1cthree", "k a b c"])]
    return rows


def test_sets():
    for text in ["", " ", "a", "a b c", "A b C d e", "a b a b a b a b", "x\x1cy z\x0bq r", "É é " * 4]:
        assert len(shingles(text, 4)) == len(brute_set(text, 4))
    assert (shingles("A B c D e", 4) == shingles("a  b\tC d\ne", 4)).all()


def test_bounds_keep_pairs_at_the_threshold():
    assert all(a < b for a, b in zip(least_hits(0.8), least_hits(0.8)[1:], strict=False))
    data = np.random.default_rng(2)
    base = data.integers(0, 2**32, (4000, VALUES), np.uint32)
    alike = np.where(data.random((4000, VALUES)) < 0.8, base, base + np.uint32(1))
    apart = np.where(data.random((4000, VALUES)) < 0.3, base, base + np.uint32(1))
    assert len(going_on(base, alike, 0.8)) >= 3999 and len(going_on(base, apart, 0.8)) <= 1


def test_signature_estimates_similarity():
    one, other = np.arange(0, 900, dtype=np.uint64) * np.uint64(2**40 + 7), np.arange(100, 1000, dtype=np.uint64) * np.uint64(2**40 + 7)
    assert abs((signature(one) == signature(other)).mean() - 0.8) < 0.12


@pytest.mark.parametrize("width", [4, 2])
def test_components_match_brute_force(spark, width):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, bucket string, k int")
    got = near_duplicates(docs, width).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute(rows, width)


def originals():
    """Copies of one text with few and with many changes: many pairs are just below the threshold, few above it."""
    base, rows = [rng.choice(WORDS) for _ in range(120)], []
    for i in range(220):
        words = changed(base, rng.choice([0, 1, 2, 3, 4, 5, 6, 8]))
        rows.append((i, " ".join(words[: len(words) - rng.randrange(12)])))
    return rows


@pytest.mark.parametrize("threshold", [80, 90])
def test_copies_of_one_original_match_brute_force(spark, threshold):
    rows = originals()
    sets = [brute_set(t, 4) for _, t in rows]
    want = {i: {i} for i, _ in rows}
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) and want[i] is not want[j]:
                want[i] |= want[j]
                for x in want[j]:
                    want[x] = want[i]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, threshold).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: min(x) for i, x in want.items()}


def test_open_pairs_hold_every_link(spark):
    """Of sets that all stand in different components, each pair at the threshold is found, by the definition."""
    random_sets = [frozenset(rng.sample(range(60), rng.randrange(1, 40))) for _ in range(30)]
    sets = random_sets + [frozenset(x ^ {next(iter(x))}) | {70 + k} for k, x in enumerate(random_sets)]
    number = {s: sum(s in x for x in sets) for s in set().union(*sets)}
    rows = []
    for k, members in enumerate(sets):
        order = sorted(members, key=lambda s: (number[s], s))
        last = len(order) - -(-80 * len(order) // 100)
        rows += [(k, s, len(order), at, k) for at, s in enumerate(order) if at <= last and number[s] > 1]
    places = spark.createDataFrame(rows, "k long, shingle long, n long, at long, component long")
    large, small = open_places(places, 80)
    crowds = crowded(large, small)
    got = {(r.a, r.b) for r in open_pairs(large, small, crowds, 80).collect()}
    assert crowds is None
    linked = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert linked <= got and len(got) < len(sets) * (len(sets) - 1) // 8


def test_more_links_join_components(spark):
    edge = "a long, b long"
    labels = components(spark.createDataFrame([(1, 2), (2, 3), (7, 8)], edge))
    after = joined_up(labels, spark.createDataFrame([(3, 8), (20, 21), (1, 3)], edge))
    assert {r.k: r.component for r in after.collect()} == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 20: 20, 21: 20}


@pytest.mark.parametrize("doc_id", [None, 7])
def test_null_and_repeated_ids_stay_linear(spark, doc_id):
    """2,000 rows of one id and 500 texts, each with near copies: what classes' texts are read by meets each row once."""
    texts = [" ".join(f"w{k // 4}x{j}" for j in range(30)) + (f" tail{k}" if k % 4 else "") for k in range(2_000)]
    docs = spark.createDataFrame([(doc_id, t) for t in texts], "doc_id long, text string")
    got = near_duplicates(docs)
    assert got.filter(F.col("component_id").eqNullSafe(F.lit(doc_id))).count() == 2_000 and got.filter("kept").count() == 2_000
    assert one_of_each(docs).count() == 500  # texts tell rows of one id apart


def test_one_of_each_keeps_columns_of_any_name(spark):
    rows = [("b", "one two three four five six", 1, "p"), ("a", "one two three four five six", 2, "q"), ("c", "other words stand here now", 3, None), (None, "", 4, "r"), (None, None, 5, "s"), ("c", "other words stand here now", 3, None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, row int, key string").withColumnRenamed("key", "marlpit_id")
    got = one_of_each(docs)
    assert got.columns == ["doc_id", "text", "row", "marlpit_id"]
    assert sorted((r.doc_id or "", r.text or "", r.row, r.marlpit_id or "") for r in got.collect() if r.doc_id) == [("a", "one two three four five six", 2, "q"), ("c", "other words stand here now", 3, "")]
    assert got.filter("doc_id is null").count() == 1  # null and empty texts of one id are repeats


def test_repeats_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(5, "a b c d e"), (5, "a b c d e"), (4, "A B c d e"), (None, "a b c d e"), (None, "other words stand here"), (5, "x y z w")], "doc_id long, text string")
    got = sorted(map(tuple, near_duplicates(docs, width=2).collect()), key=str)
    want = [(5, 4, 4, False), (5, 4, 4, False), (4, 4, 4, True), (None, 4, 4, False), (None, 3, None, True), (5, 3, 5, True)]
    assert got == sorted(want, key=str)
    assert near_duplicates(docs.limit(0)).count() == 0


def pages(n, words=8, seed=1):
    """Pages of one template: 33 of its 40 lines each. Most pairs are alike, but not enough; few are linked."""
    own = random.Random(seed)
    lines = [" ".join(f"l{i}w{k}" for k in range(words)) for i in range(40)]
    return [(i, "\n".join(lines[k] for k in sorted(own.sample(range(40), 33)))) for i in range(n)]


@pytest.mark.parametrize("words,block", [(8, 4 << 20), (8, 100_000), (20, 200_000)])
def test_pages_of_a_template_match_brute_force(spark, monkeypatch, words, block):
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", block)
    rows = pages(260, words) + [(1000 + i, t) for i, t in corpus()[:60]]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute(rows, 4)


def test_pages_of_a_template_form_few_pairs(spark, monkeypatch):
    formed = []
    kept = near_dedup.survivors
    monkeypatch.setattr(near_dedup, "survivors", lambda pairs, *more: (formed.append(pairs.count()), kept(pairs, *more))[1])
    for n in (200, 800):
        near_duplicates(spark.createDataFrame(pages(n), "doc_id long, text string"), 4)
    assert sum(formed[3:]) < 6 * sum(formed[:3]), formed


def test_one_of_each_follows_no_order_of_rows(spark):
    text = "one text of more than five words"
    rows = [(1, text, f"s{k:02d}", k) for k in range(40)] + [(1, text, "s05", 5)] * 3 + [(2, "", "x", 1), (2, None, "y", 2), (2, None, "y", 2)]
    found = set()
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long").repartition(seed + 1)
        got = sorted(map(tuple, one_of_each(docs).collect()), key=str)
        assert len(got) == 2
        found.add(str(got))
    assert len(found) == 1
    equal = spark.createDataFrame([(1, text, "s", 1)] * 5, "doc_id long, text string, source string, n long")
    assert one_of_each(equal).count() == 1
