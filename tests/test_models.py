import os
import uuid

import numpy as np
from pyspark.sql import functions as F

from marlpit.operators import ingest, models, retrieval


def test_a_model_is_loaded_once_a_worker_and_fed_batches(spark, tmp_path):
    loads, sizes = str(tmp_path / "loads"), str(tmp_path / "sizes")
    os.makedirs(loads)
    os.makedirs(sizes)

    def load():
        open(os.path.join(loads, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()

        def predict(texts):
            open(os.path.join(sizes, f"{len(texts)}-{uuid.uuid4().hex}"), "w").close()
            return np.array([[float(len(t)), float(t.count("a"))] for t in texts])

        return predict

    texts = [("c%03d" % k, "a" * (k % 7) + "é") for k in range(500)] + [("empty", ""), ("none", None)]
    chunks = spark.createDataFrame(texts, "chunk_id string, text string").repartition(6)
    vectors = spark.createDataFrame([("c000", [0.0])], "chunk_id string, embedding array<double>")
    got = {r.chunk_id: r.embedding for r in ingest.index_vectors(chunks, vectors, models.embedder(load, 16)).collect()}
    assert got == {k: None if t is None else [float(len(t)), float(t.count("a"))] for k, t in texts if k != "c000"}
    own = [name.split("-")[0] for name in os.listdir(loads)]
    assert 1 <= len(own) == len(set(own)) <= 8  # no worker twice
    fed = [int(name.split("-")[0]) for name in os.listdir(sizes)]
    assert sum(fed) == 501 and max(fed) == 16


def test_pairs_are_scored_by_a_model(spark):
    def load():
        return lambda queries, texts: np.array([float(len(set(q.split()) & set(t.split()))) for q, t in zip(queries, texts, strict=True)])

    results = spark.createDataFrame([("a", "the plan"), ("b", "the plan of the day"), ("c", "none")], "chunk_id string, text string").withColumn("score", F.lit(0.0))
    best = retrieval.rerank(results, models.scorer(load, "plan of day"), 2).collect()
    assert [(r.chunk_id, r.score) for r in best] == [("b", 3.0), ("a", 1.0)]
