import math
import random
import re
import zlib

import numpy as np
import xxhash

from marlpit.llm.quality import DIMENSIONS, Model, dual_coordinate_descent, features, fit, fit_rows, form, log_count_ratios, score_quality, sigmoid_fit

rng = random.Random(8)
WORDS = ["".join(rng.choice("aeiounrst") for _ in range(rng.randint(2, 7))) for _ in range(400)]


def good_text():
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(5, 60))).capitalize() + "."


def bad_text():
    return " ".join([rng.choice(WORDS).upper() + "!!" for _ in range(8)]) if rng.random() < 0.5 else " ".join([rng.choice(WORDS)] * 20)


def test_forms_and_features():
    assert form("Word!!") == "Aa!+" and form("ABC-12") == "A-0"
    assert features("").tolist() == [0]
    found = features("a b a b")
    assert found.tolist() == sorted(set(found.tolist())) and set(features("a b")) <= set(found)


def plain_features(text):
    """Numbers of n-grams by their definition, one word at a time, in whole numbers modulo 2 ** 64."""
    a, b, c, most = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 1 << 64
    number = lambda x: xxhash.xxh3_64_intdigest(x.encode())
    words = text.split()
    names = [number(w.lower()) >> 16 for w in words]
    shapes = []
    for k, word in enumerate(words):
        shape = re.sub(r"(.)\1+", r"\1+", re.sub("[0-9]+", "0", re.sub("[a-zß-öø-ÿ]+", "a", re.sub("[A-ZÀ-ÖØ-Þ]+", "A", word))), flags=re.DOTALL)
        mixed = (((number(shape) & 0xFFFF) * 2 + (k > 0 and names[k] == names[k - 1]) + 1) * a) % most
        shapes.append(mixed ^ mixed >> 31)
    grams = [x * a for x in names] + [x * b + y * c for x, y in zip(names, names[1:])]
    for n in (1, 2, 3):
        grams += [sum(x * f for x, f in zip(shapes[k : k + n], (a, b, c))) + n for k in range(len(words) - n + 1)]
    found = {0}
    for x in grams:
        x %= most
        found.add(((x ^ x >> 29) * b % most) >> 44)
    return sorted(found)


def test_features_match_their_definition():
    texts = ["", "x", "a b", "Again again AGAIN!!", "ABC-12 12 é É Straße 1234567", "a a a a b", good_text(), bad_text()]
    for text in texts:
        assert features(text).tolist() == plain_features(text), text


def test_ratios_and_scores_match_a_plain_version():
    texts = [good_text() for _ in range(30)] + [bad_text() for _ in range(20)]
    good = np.array([True] * 30 + [False] * 20)
    rows = [features(x) for x in texts]
    ratios = log_count_ratios(rows, good)
    sets, seen = [set(plain_features(x)) for x in texts], set().union(*map(set, rows))
    counts = {f: [1 + sum(f in s for s, g in zip(sets, good, strict=True) if g == side) for side in (False, True)] for f in seen}
    totals = [sum(n[side] for n in counts.values()) for side in (0, 1)]
    want = {f: 1.0 if f == 0 else math.log(n[1] / totals[1]) - math.log(n[0] / totals[0]) for f, n in counts.items()}
    assert set(np.flatnonzero(ratios)) <= seen and all(abs(ratios[f] - x) < 1e-9 for f, x in want.items())

    model = fit_rows(rows, good)
    for text in (*texts[:3], "", "never seen words"):
        found = plain_features(text)
        length = math.sqrt(sum(want.get(f, 0.0) ** 2 for f in found) + 1e-12)
        margin = sum(float(model.weights[f]) for f in found) / length
        assert abs(model.score(text) - 1 / (1 + math.exp(-(model.slope * margin + model.intercept)))) < 1e-5
    dense = np.zeros((50, DIMENSIONS), np.float32)
    for k, found in enumerate(rows):
        dense[k, found] = ratios[found] / np.sqrt((ratios[found] ** 2).sum())
    w = np.divide(model.weights, ratios, out=np.zeros(DIMENSIONS), where=ratios != 0)
    cost = np.where(good, 0.5 / good.mean(), 0.5 / (1 - good.mean()))
    loss = lambda w: w @ w / 2 + (cost * np.maximum(0, 1 - np.where(good, 1, -1) * (dense @ w))).sum()
    data = np.random.default_rng(4)
    near = [w + 0.05 * np.where(w != 0, data.normal(size=DIMENSIONS), 0) for _ in range(30)]
    assert all(loss(w) <= 1.001 * loss(x) for x in [*near, np.zeros(DIMENSIONS)])


def test_sigmoid_is_the_likeliest():
    data = np.random.default_rng(3)
    margins = data.normal(size=400)
    good = data.random(400) < 1 / (1 + np.exp(-(2 * margins - 0.5)))
    want = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))

    def cross(a, b):
        p = 1 / (1 + np.exp(-(a * margins + b)))
        return -(want * np.log(p) + (1 - want) * np.log(1 - p)).sum()

    a, b = sigmoid_fit(margins, good)
    assert all(cross(a, b) <= cross(a + x, b + y) + 1e-6 for x in (-0.05, 0, 0.05) for y in (-0.05, 0, 0.05))
    assert Model(np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), a, b).score("x") == 1 / (1 + math.exp(-b))


def test_dual_coordinate_descent_reaches_the_minimum():
    data = np.random.default_rng(1)
    x = data.normal(size=(60, 3))
    good = x @ [1.0, -2.0, 0.5] + 0.3 * data.normal(size=60) > 0
    rows = [np.array([0, 1, 2])] * 60
    w = dual_coordinate_descent(rows, list(x), good, rounds=2000)[:3]
    sign, cost = np.where(good, 1, -1), np.where(good, 0.5 / good.mean(), 0.5 / (1 - good.mean()))
    loss = lambda w: w @ w / 2 + (cost * np.maximum(0, 1 - sign * (x @ w))).sum()
    assert all(loss(w) <= loss(w + 0.01 * data.normal(size=3)) + 1e-6 for _ in range(200))


def test_model_without_both_labels():
    model = fit_rows([features("a b")] * 20, np.ones(20, bool))
    assert abs(model.score("x") - 21 / 22) < 1e-9 and model.score("") == model.score("x")


def test_held_out_accuracy_and_edge_rows(spark):
    rows = [(i, good_text() if i % 3 else bad_text(), i % 3) for i in range(1500)]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(3, None, 0.0), (2000, "", 0.0), (None, "x", 0.0)], "doc_id long, text string, score double")
    marks = [(i, int(q > 0)) for i, _, q in rows if i % 10] + [(1, 0), (1, None), (None, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    got = score_quality(docs, labels).collect()
    assert len(got) == 1503
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = {r.doc_id: r.predicted for r in got if r.held_out and r.doc_id < 1500}
    assert np.mean([held[i] == int(q > 0) for i, _, q in rows if i in held]) > 0.95
    flipped = spark.createDataFrame([(i, 1 - q if i is not None and q is not None and zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in marks], "doc_id long, quality int")
    same = score_quality(docs, flipped).collect()
    assert sorted(map(str, same)) == sorted(map(str, got))
    assert {r.score for r in score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert score_quality(docs.limit(0), labels).count() == 0


def test_unusable_labels_do_not_thin_the_sample(spark):
    docs = spark.createDataFrame([(i, good_text() if i % 3 else bad_text()) for i in range(300)], "doc_id long, text string")
    usable = [(i, int(i % 3 > 0)) for i in range(200)]
    unusable = [(i, None) for i in range(1000)] + [(i, q) for i in range(200, 300) for q in (0, 1)] + [(i, 1) for i in range(5000, 9000)] + usable * 3
    want = fit(docs, spark.createDataFrame(usable, "doc_id long, quality int"), sample=200)
    got = fit(docs, spark.createDataFrame(usable + unusable, "doc_id long, quality int"), sample=200)
    assert np.array_equal(got.weights, want.weights) and np.count_nonzero(got.weights) and (got.slope, got.intercept) == (want.slope, want.intercept)
