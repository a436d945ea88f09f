"""Centroid clustering by sort-means, in whole numbers.

Each round orders, for every centroid, the other centroids by their distance from it. A vector looks at its previous
centroid first and then at the others in that order. It stops at one that lies strictly more than twice as far from the
previous centroid as the vector does: by the triangle inequality neither this one nor any behind it is as near. Strictly,
as an equally near centroid of a smaller number wins.

Rounds read the vectors and give sums by centroid, added up by Spark; nothing is shuffled but these. Assignments are
written with the vectors once in a few rounds. In between a task goes through the rounds since then again, which takes
less than writing would.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlpit.llm.common import discard, in_pieces, written

#: Rounds after which assignments are written.
REMEMBERED = 5
MOST = 2**63 - 1
SUM = pa.decimal128(38, 0)


def whole_vector(column: str, width: int, scale: float) -> Column:
    """A vector's components times scale, rounded down, or null if it isn't one of so many finite numbers."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform(column, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    return F.when((F.size(column) == width) & ~bad, scaled)


def exact(numbers: np.ndarray) -> np.ndarray:
    """Vectors whose squared distances may be worked out four times over: of Python's numbers where 64 bits wouldn't do."""
    small = math.isqrt(MOST // (16 * numbers.shape[1]))
    return numbers if numbers.dtype == object or np.abs(numbers.astype(float)).max(initial=0) < small else numbers.astype(object)


def squared(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    return ((vectors - centroid) ** 2).sum(1)


def neighbours(centroids: np.ndarray) -> list[list[tuple[int, int]]]:
    """Of each centroid the other ones as (squared distance, number), nearest first."""
    found = [squared(centroids, c).tolist() for c in centroids]
    return [sorted((d, other) for other, d in enumerate(row) if other != own) for own, row in enumerate(found)]


def nearest(vectors: np.ndarray, previous: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(centroid, squared distance) of each vector, ties to the smaller number, and how many distances were worked out."""
    best, distance, looked = previous.copy(), np.zeros(len(vectors), vectors.dtype), len(vectors)
    for own, order in enumerate(neighbours(centroids)):
        at = np.flatnonzero(previous == own)
        if not len(at):
            continue
        mine = vectors[at]
        start = squared(mine, centroids[own])
        found, near = np.full(len(at), own), start.copy()
        reach, open_ = 4 * start, np.arange(len(at))
        for apart, other in order:
            open_ = open_[apart <= reach[open_]]
            if not len(open_):
                break
            looked += len(open_)
            d = squared(mine[open_], centroids[other])
            closer = (d < near[open_]) | ((d == near[open_]) & (other < found[open_]))
            won = open_[closer]
            found[won], near[won] = other, d[closer]
        best[at], distance[at] = found, near
    return best, distance, looked


def assigned(vectors: np.ndarray, previous: np.ndarray, rounds: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Assignments and squared distances after rounds with these centroids, one after the other."""
    distance = np.zeros(len(vectors), np.int64)
    both = exact(vectors)
    for centroids in rounds:
        other = exact(centroids)
        if object in (both.dtype, other.dtype):
            both, other = both.astype(object), other.astype(object)
        previous, distance, _ = nearest(both, previous, other)
    return previous, distance


def batch_vectors(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    vectors = np.frombuffer(b"".join(batch.column("whole").to_pylist()), np.int64).reshape(-1, width)
    return vectors, batch.column("cluster").to_numpy().astype(np.int64)


def sums(rows: DataFrame, rounds: list[np.ndarray], width: int) -> dict[int, tuple[int, list[int]]]:
    """By centroid the number of its vectors and their componentwise sum; a row for each number, so a bounded collect."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total = [0] * len(rounds[-1]), [[0] * width for _ in rounds[-1]]
        for batch in in_pieces(batches, 4096):
            vectors, previous = batch_vectors(batch, width)
            cluster, _ = assigned(vectors, previous, rounds)
            for c in np.unique(cluster).tolist():
                mine = vectors[cluster == c]
                number[c] += len(mine)
                total[c] = [a + int(b) for a, b in zip(total[c], exact(mine).sum(0), strict=True)]
        there = [c for c, n in enumerate(number) if n]
        yield pa.RecordBatch.from_pydict(
            {
                "cluster": pa.array([c for c in there for _ in range(width + 1)], pa.int32()),
                "at": pa.array([k for _ in there for k in range(-1, width)], pa.int32()),
                "x": pa.array([Decimal(x) for c in there for x in (number[c], *total[c])], SUM),
            }
        )

    found: dict[int, list[int]] = {}
    added = rows.mapInArrow(add, "cluster int, at int, x decimal(38,0)").groupBy("cluster", "at").agg(F.sum("x").alias("x"))
    for row in added.collect():
        found.setdefault(row.cluster, [0] * (width + 1))[row.at + 1] = int(row.x)
    return {c: (n, total) for c, (n, *total) in found.items()}


def moved(centroids: np.ndarray, found: dict[int, tuple[int, list[int]]]) -> np.ndarray:
    """Each centroid that has vectors becomes their mean, rounded down by component."""
    out = centroids.copy()
    for c, (n, total) in found.items():
        out[c] = [x // n for x in total]
    return out


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def sort_means(rows: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, scale: float = 1024.0, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of `width` finite numbers.

    Components are scaled and rounded down; distances are squared and exact. Centroids start as the k vectors with the
    smallest SHA-256 of `seed:id`, a null id being written as nothing, ties by the vector. A centroid without vectors
    stays. Vectors that are null, of another length, or hold a null or non-finite component take no part. Repeated rows
    count each. Fewer vectors than k are so many centroids; equal centroids leave all but the first empty. Other
    columns are ignored, whatever their names. An empty table gives an empty result. A distance beyond 64 bits is shown
    as 2^63 - 1, an inertia beyond them as null.
    """
    spark = rows.sparkSession
    taken = rows.select(F.col(id_col).alias("id"), whole_vector(vector_col, width, scale).alias("whole")).filter("whole is not null")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    kind = rows.schema[id_col].dataType.simpleString()

    def to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, 4096):
            whole = batch.column("whole").flatten().to_numpy().astype(np.int64).tobytes()
            packed = [whole[at : at + 8 * width] for at in range(0, len(whole), 8 * width)]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "cluster": pa.array(np.zeros(batch.num_rows, np.int32)), "whole": pa.array(packed, pa.binary())})

    schema = f"id {kind}, cluster int, whole binary"
    vectors = written(taken.mapInArrow(to_bytes, schema))
    first = vectors.select(drawn.alias("drawn"), "whole").orderBy("drawn", "whole").limit(k).collect()
    if not first:
        return spark.createDataFrame([], f"{id_col} {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    since = [np.stack([np.frombuffer(row.whole, np.int64) for row in first])]  # centroids of the rounds since the last written one

    def remember(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, 4096):
            cluster, _ = assigned(*batch_vectors(batch, width), since)
            yield batch.set_column(1, "cluster", pa.array(cluster, pa.int32()))

    for number in range(1, rounds + 1):
        after = moved(since[-1], sums(vectors, since, width))
        if number % REMEMBERED == 0 and number < rounds:
            before, vectors = vectors, written(vectors.mapInArrow(remember, schema))
            discard(before)
            since = []
        since = [*since, after]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, 4096):
            cluster, distance = assigned(*batch_vectors(batch, width), since)
            capped = pa.array([min(x, MOST) for x in distance.tolist()], pa.int64())
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "cluster": pa.array(cluster, pa.int32()), "distance": capped})

    last = since[-1]
    found = written(vectors.mapInArrow(finish, f"id {kind}, cluster int, distance long"))
    discard(vectors)
    by_cluster = found.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))  # a row for each centroid
    names = spark.createDataFrame([(c, digest(x)) for c, x in enumerate(last)], "cluster int, centroid_sha256 string")
    all_of_them = found.agg(F.try_sum("distance").alias("inertia"))
    said = by_cluster.join(F.broadcast(names), "cluster").crossJoin(F.broadcast(all_of_them))
    return found.join(F.broadcast(said), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
