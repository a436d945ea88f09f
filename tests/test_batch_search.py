import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlpit.operators import index, lexical

CHUNK = "chunk_id string, document_id string, sequence int, text string"
WORDS = ["the"] * 30 + ["Of"] * 12 + ["plan"] * 4 + [f"w{k}" for k in range(40)] + ["ÉTÉ", "x\x1cy"]
GAPS = [" "] * 8 + ["\n", "\u00a0", "\u0085", "\u3000", " \t "]
ASKED = [("a", "the of"), ("b", "the the plan w3"), ("c", "w1 w2 of the"), ("d", "zz"), ("e", ""), ("f", "The OF plan " + " ".join(f"w{k}" for k in range(20))), ("g", None), ("h", "été x\x1cy"), ("i", "x y"), ("j", "the")]


def state(spark, number, seed=3):
    """Chunks with copies, of which the best of a query are tied, texts without words, and a null text."""
    rng = random.Random(seed)
    rows = [(f"D{i:03d}-{k}", f"D{i:03d}", k, "".join(rng.choice(WORDS) + rng.choice(GAPS) for _ in range(rng.randrange(30)))) for i in range(number) for k in (1, 2)]
    rows += [(f"E{i:03d}-1", f"E{i:03d}", 1, "the plan of the") for i in range(number)] + [("F-1", "F", 1, None), ("F-2", "F", 2, " ")]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, CHUNK).repartition(3)


def wanted(chunks, top):
    """What a scan for each query alone gives. A control that isn't white space is a letter there."""
    texts = chunks.withColumn("text", F.translate(F.coalesce("text", F.lit("")), "\x1c", "q"))
    return [(q, k + 1, r.chunk_id, r.document_id, r.score) for q, text in ASKED if text for k, r in enumerate(lexical.search(texts, text.replace("\x1c", "q"), top).collect())]


@pytest.mark.parametrize("limits", [{}, {"PIECE": 7, "HELD": 20}, {"PIECE": 50, "HELD": 1, "PASS": 30}])
def test_many_queries_equal_a_scan_for_each(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(lexical, name, value)
    chunks = state(spark, 60)
    got = index.batch_search(chunks, spark.createDataFrame(ASKED, "q string, text string"), "q", "text", 7)
    assert got.columns == ["q", "rank", "chunk_id", "document_id", "score"]
    assert sorted(map(tuple, got.collect())) == wanted(chunks, 7)


def test_no_index_is_made(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    assert index.batch_search(state(spark, 20), spark.createDataFrame(ASKED, "q string, text string"), "q", "text").count()
    assert set(os.listdir(folder)) == before


def test_few_rows_are_exchanged(spark, monkeypatch):
    """What goes to the ranking grows with queries, pieces and tasks, not with postings or copies."""
    monkeypatch.setattr(lexical, "PIECE", 500)
    chunks = spark.range(0, 4000, 1, 2).select(F.format_string("D%05d", "id").alias("chunk_id"), F.format_string("D%05d", "id").alias("document_id"), F.lit(1).alias("sequence"), F.lit("the plan").alias("text"))
    rows = spark.createDataFrame([(q, w, 1.0) for q in range(20) for w in ("the", "plan")], "q int, term string, times double").toArrow()
    asked, mean = lexical._weighed(chunks, rows)
    assert mean == 2.0 and lexical._candidates(chunks, asked, mean, 5, "int").count() <= 20 * 5 * 4000 / 500


def test_no_queries(spark):
    chunks = state(spark, 2)
    for rows in ([], [(1, None), (2, " ")]):
        got = index.batch_search(chunks, spark.createDataFrame(rows, "n long, text string"), "n", "text")
        assert got.count() == 0 and got.dtypes[:2] == [("n", "bigint"), ("rank", "int")]
    assert index.batch_search(chunks.limit(0), spark.createDataFrame([(1, "the")], "n long, text string"), "n", "text").count() == 0


def test_cuts_hold_few_parts():
    rng = np.random.default_rng(4)
    for queries, held in ((1, 50), (10, 50), (100, 50)):
        parts = rng.integers(0, 60, 200)
        found = list(lexical.cuts(parts, queries, held))
        assert [a for a, _ in found] == [0, *[b for _, b in found[:-1]]] and found[-1][1] == 200
        assert all(b - a == 1 or (b - a) * queries <= held and parts[a:b].sum() <= held for a, b in found)
