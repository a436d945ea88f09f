"""A stored inverted file of vectors: cells around trained centroids, rings within cells, and exact search by angles.

Vectors count by their direction. Each is in the cell of its nearest centroid, and a cell's vectors are cut into rings by
their angle to the centroid. The angle between a query and a vector is at least the difference of their angles to one
centroid: so a ring says how near its vectors can be to a query at most. A search looks into each query's nearest cells
first, for a floor that its best results reach, and then into all rings that can reach it. The result is exact; how much
of the file is read depends on how the vectors lie.

Centroids are trained once, on SAMPLE vectors at most; that decides what is read, never what is found. The file grows by
versions, as the stored tables do: new vectors go to the cells that are there and withdraw those that they replace.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlpit.operators.lexical import DIGITS, MARGIN
from marlpit.sources import tables
from marlpit.sources.scratch import delete, written

NAME = "vector_index"
#: Vectors that centroids are trained on at most, rounds of training, most cells, and vectors of a cell, about.
SAMPLE, ROUNDS, CELLS_MOST, CELL = 65_536, 8, 4096, 512
#: Vectors of a ring, queries that meet a ring together, and vectors by which a query's floor is found, about.
RING, TOGETHER, PILOT = 128, 256, 512
#: Vectors that are assigned at once, and queries that choose their cells at once: each of these makes a row for a cell.
ASSIGNED, CHOOSING = 512, 16
#: What bounds on cosines give way to rounding of angles.
SLACK = 1e-7

CENTROIDS = "cell int, centroid array<double>"
RINGS = "version int, cell int, ring int, n int, low double, high double, chunk_ids array<string>, directions binary"
WITHDRAWN = "version int, chunk_id string"
IDS = "version int, chunk_id string"


def directions(vectors: DataFrame) -> DataFrame:
    """(chunk_id, direction): vectors of length 1; those that are null, of no length or not finite go."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, out = [], []
            for row, x in enumerate(batch.column("embedding").to_pylist()):
                v = np.array(x, np.float64) if x is not None and None not in x else np.zeros(0)
                length = math.sqrt(float(v @ v)) if np.isfinite(v).all() else 0.0
                if 0 < length < math.inf:
                    kept.append(row)
                    out.append((v / length).tobytes())
            yield pa.RecordBatch.from_pydict({"chunk_id": batch.column("chunk_id").take(pa.array(kept, pa.int64())), "direction": pa.array(out, pa.binary())})

    own = vectors.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return own.mapInArrow(turn, "chunk_id string, direction binary")


def pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of so many rows at most, as each row meets all cells."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def matrix(rows: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.float64).reshape(-1, width)


def trained(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centroids of length 1 by rounds of assignment and mean, from evenly taken rows; cells without rows stay."""
    centroids = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)].copy()
    for _ in range(ROUNDS):
        nearest = (sample @ centroids.T).argmax(1)
        for c in np.unique(nearest):
            mean = sample[nearest == c].mean(0)
            length = math.sqrt(float(mean @ mean))
            if length > 0:
                centroids[c] = mean / length
    return centroids


def angle(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def _found(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    return tables.versions_of(spark, folder, NAME)


def _read(spark: SparkSession, found: list[tuple[int, str]], part: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(*[f"{path}/{part}" for _, path in found]) if found else spark.createDataFrame([], schema)


def _centroids(spark: SparkSession, found: list[tuple[int, str]]) -> np.ndarray:
    rows = _read(spark, found[:1], "centroids", CENTROIDS).orderBy("cell").collect()  # CELLS_MOST at most
    return np.array([row.centroid for row in rows])


def _write(spark: SparkSession, folder: str, kind: str, vectors: DataFrame, centroids: np.ndarray, gone: DataFrame | None) -> None:
    """A version of vectors (chunk_id, direction) that withdraws others (WITHDRAWN)."""
    found = _found(spark, folder)
    number = found[-1][0] + 1 if found else 1
    path, width = f"{folder}/{NAME}/{number:08d}-{kind}", centroids.shape[1] if len(centroids) else 0
    delete(spark, path)
    if kind == "full":
        spark.createDataFrame([(c, x.tolist()) for c, x in enumerate(centroids)], CENTROIDS).coalesce(1).write.parquet(f"{path}/centroids")
    shared = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, ASSIGNED):
            cosines = matrix(batch.column("direction").to_pylist(), width) @ shared.value.T
            cells = cosines.argmax(1)
            yield pa.RecordBatch.from_pydict({"chunk_id": batch.column("chunk_id"), "direction": batch.column("direction"), "cell": pa.array(cells, pa.int32()), "angle": pa.array(angle(cosines[np.arange(len(cells)), cells]))})

    placed = written(vectors.mapInArrow(assign, "chunk_id string, direction binary, cell int, angle double"))
    # a cell is cut into slices by quantiles of the angle, so that no task sees more of a crowded one than its share
    share = F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(64 * RING)))
    slices = placed.groupBy("cell").agg(share.alias("slices"), F.percentile_approx("angle", [k / 64 for k in range(1, 64)], 1000).alias("marks"))
    at = F.size(F.filter("marks", lambda m: m < F.col("angle")))
    sliced = placed.join(slices, "cell").withColumn("slice", F.floor(at * F.least("slices", F.lit(64)) / F.lit(64)).cast("int"))
    ranked = sliced.withColumn("rank", F.row_number().over(Window.partitionBy("cell", "slice").orderBy("angle", "chunk_id")))
    ring = (F.col("slice") * F.lit(1 << 20) + F.floor((F.col("rank") - 1) / F.lit(RING))).cast("int")
    held = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "direction")))
    grouped = ranked.withColumn("ring", ring).groupBy("cell", "slice", "ring").agg(F.count("*").cast("int").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"), held.alias("held"))
    joined = F.aggregate("held.direction", F.lit(b""), lambda a, b: F.concat(a, b))
    rows = grouped.select(F.lit(number).alias("version"), "cell", "ring", "n", "low", "high", F.col("held.chunk_id").alias("chunk_ids"), joined.alias("directions"))
    rows.sortWithinPartitions("cell", "ring").write.option("parquet.page.row.count.limit", 64).parquet(f"{path}/rings")
    placed.select(F.lit(number).alias("version"), "chunk_id").write.parquet(f"{path}/ids")
    (gone if gone is not None else spark.createDataFrame([], WITHDRAWN)).write.parquet(f"{path}/withdrawn")
    tables.mark_complete(spark, path)


def _live(rows: DataFrame, spark: SparkSession, found: list[tuple[int, str]]) -> DataFrame:
    return rows.join(_read(spark, found, "withdrawn", WITHDRAWN), ["version", "chunk_id"], "left_anti") if len(found) > 1 else rows


def update_vectors(spark: SparkSession, folder: str, vectors: DataFrame) -> None:
    """Vectors (chunk_id, embedding), ids unique and of one width, come in or replace those of their ids.

    The first ones train the centroids. By one writer at a time.
    """
    found, own = _found(spark, folder), written(directions(vectors))
    if not found:
        number = own.count()
        sample = own.orderBy(F.xxhash64("chunk_id")).limit(SAMPLE).collect()
        width = len(sample[0].direction) // 8 if sample else 0
        centroids = trained(matrix([r.direction for r in sample], width), max(1, min(CELLS_MOST, math.ceil(number / CELL)))) if sample else np.zeros((0, 0))
        if len(centroids):
            _write(spark, folder, "full", own, centroids, None)
        return
    replaced = _live(_read(spark, found, "ids", IDS), spark, found).join(vectors.select(F.col("chunk_id").cast("string").alias("chunk_id")), "chunk_id", "left_semi").select("version", "chunk_id")
    _write(spark, folder, "part", own, _centroids(spark, found), replaced)
    if len(found) + 1 > tables.VERSIONS_MOST:
        compact_vectors(spark, folder)


def compact_vectors(spark: SparkSession, folder: str) -> None:
    """All vectors as one version, around the same centroids; those before it go when it is complete."""
    found = _found(spark, folder)
    if len(found) < 2:
        return
    width = 8 * _centroids(spark, found).shape[1]
    each = _read(spark, found, "rings", RINGS).select("version", F.posexplode("chunk_ids").alias("at", "chunk_id"), "directions")
    own = each.select("version", "chunk_id", F.substring("directions", F.col("at") * width + 1, F.lit(width)).alias("direction"))
    _write(spark, folder, "full", _live(own, spark, found).select("chunk_id", "direction"), _centroids(spark, found), None)
    for _, path in found:
        delete(spark, path)


def _cell_bounds(rings: DataFrame) -> dict[int, tuple[int, float, float]]:
    """By cell its vectors' number and least and largest angle: CELLS_MOST rows at most."""
    rows = rings.groupBy("cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect()
    return {r.cell: (r.n, r.low, r.high) for r in rows}


def nearest_angle(own: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least angle to a query that vectors with angles from low to high can have, by the query's own angles."""
    return np.maximum(0.0, np.maximum(low - own, own - high))


class Search:
    """What a search of many queries (query_id, vector) goes through: pairs of queries and cells, and the rings that they meet."""

    def __init__(self, spark: SparkSession, found: list[tuple[int, str]], queries: DataFrame, query_id: str, vector: str, top: int):
        self.spark, self.found, self.top = spark, found, top
        self.rings, centroids = _read(spark, found, "rings", RINGS), _centroids(spark, found)
        self.width = centroids.shape[1]
        self.shared = spark.sparkContext.broadcast((centroids, _cell_bounds(self.rings)))
        named = queries.select(F.col(query_id).cast("string").alias("chunk_id"), F.col(vector).alias("embedding"))
        self.asked = written(directions(named.distinct()).filter(F.length("direction") == 8 * self.width).withColumnRenamed("chunk_id", "q"))

    def looked_into(self, asked: DataFrame, pilot: bool) -> DataFrame:
        """(cell, q, direction, floor, own): the cells that a query (q, direction, floor) looks into, with its angle to
        their centroids. For a pilot these are the nearest ones, else all that can reach its floor."""
        shared, width = self.shared, self.width

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            middle, held = shared.value
            known = np.array(sorted(held))
            n, low, high = (np.array([held[c][k] for c in known.tolist()]) for k in range(3))
            for batch in pieces(batches, CHOOSING):
                own = angle(matrix(batch.column("direction").to_pylist(), width) @ middle[known].T)
                best = np.cos(nearest_angle(own, low, high)) + SLACK
                rows, chosen = [], []
                for row, floor in enumerate(batch.column("floor").to_pylist()):
                    if pilot:
                        order = np.argsort(own[row], kind="stable")
                        at = order[: int(np.searchsorted(np.cumsum(n[order]), PILOT)) + 1]
                    else:
                        at = np.flatnonzero(best[row] >= floor) if floor is not None else np.arange(len(known))
                    rows += [row] * len(at)
                    chosen += at.tolist()
                taken = batch.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_pydict({"cell": pa.array(known[chosen], pa.int32())} | {c: taken.column(c) for c in ("q", "direction", "floor")} | {"own": pa.array(own[rows, chosen], pa.float64())})

        return asked.select("q", "direction", "floor").mapInArrow(choose, "cell int, q string, direction binary, floor double, own double")

    def met(self, wanted: DataFrame) -> DataFrame:
        """Rings with the queries that look into their cells, so many together at most."""
        together = F.pmod(F.xxhash64("q"), F.greatest(F.lit(1), F.ceil(F.col("askers") / F.lit(TOGETHER))))
        askers = wanted.groupBy("cell").agg(F.count("*").alias("askers"))  # a row for each cell
        packed = wanted.join(F.broadcast(askers), "cell").groupBy("cell", together.alias("together")).agg(F.collect_list(F.struct("q", "direction", "floor", "own")).alias("asked"))
        return self.rings.join(packed, "cell")

    def scores(self, wanted: DataFrame) -> DataFrame:
        """(q, version, chunk_id, score) of the vectors in a query's cells that reach its floor."""
        width = self.width

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(batch.num_rows):
                    row = batch.slice(at, 1).to_pylist()[0]
                    asked, floors, open_ = open_queries(row)
                    if len(open_):
                        cosines = matrix([asked[k]["direction"] for k in open_], width) @ matrix([row["directions"]], width).T
                        k, x = np.nonzero(cosines >= floors[open_, None])
                        ids = pa.array(row["chunk_ids"], pa.string()).take(pa.array(x, pa.int64()))
                        yield pa.RecordBatch.from_pydict({"q": pa.array([asked[i]["q"] for i in open_[k]], pa.string()), "version": pa.array([row["version"]] * len(k), pa.int32()), "chunk_id": ids, "score": pa.array(cosines[k, x])})

        rows = self.met(wanted).select("version", "low", "high", "chunk_ids", "directions", "asked")
        return _live(rows.mapInArrow(score, "q string, version int, chunk_id string, score double"), self.spark, self.found)

    def with_floors(self) -> DataFrame:
        """Queries with the score that their best results reach at least, by their nearest cells; null if too few are near."""
        unknown = self.asked.withColumn("floor", F.lit(None).cast("double"))
        best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
        first = self.scores(self.looked_into(unknown, True)).withColumn("rank", best).filter(F.col("rank") == self.top)
        return self.asked.join(written(first.select("q", (F.col("score") - MARGIN).alias("floor"))), "q", "left")


def open_queries(row: dict) -> tuple[list[dict], np.ndarray, np.ndarray]:
    """Of a ring with its queries: these, their floors, and the indices of those whose floors its vectors can reach."""
    asked = row["asked"]
    floors = np.array([-2.0 if x["floor"] is None else x["floor"] for x in asked])
    near = nearest_angle(np.array([x["own"] for x in asked]), row["low"], row["high"])
    return asked, floors, np.flatnonzero(np.cos(near) + SLACK >= floors)


def search_vectors(spark: SparkSession, folder: str, queries: DataFrame, query_id: str, vector: str, top: int = 5) -> DataFrame:
    """(query_id, rank, chunk_id, score) of the vectors that are nearest to each query (query_id, vector) by cosine.

    Scores are rounded before they are compared; ties go by chunk. Queries without a length have no rows.
    """
    kind = queries.schema[query_id].dataType.simpleString()
    found = _found(spark, folder)
    if not found:
        return spark.createDataFrame([], f"{query_id} {kind}, rank int, chunk_id string, score double")
    search = Search(spark, found, queries, query_id, vector, top)
    ranked = search.scores(search.looked_into(search.with_floors(), False)).withColumn("score", F.round("score", DIGITS))
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "chunk_id"))
    return ranked.withColumn("rank", best).filter(F.col("rank") <= top).select(F.col("q").cast(kind).alias(query_id), "rank", "chunk_id", "score")


def share_read(spark: SparkSession, folder: str, queries: DataFrame, query_id: str, vector: str, top: int = 5) -> float:
    """The share of pairs of queries and vectors that a search works out, after its floors are known."""
    search = Search(spark, _found(spark, folder), queries, query_id, vector, top)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [row["n"] * len(open_queries(row)[2]) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_pydict({"pairs": pa.array(numbers, pa.int64())})

    rows = search.met(search.looked_into(search.with_floors(), False)).select("n", "low", "high", "asked")
    pairs = rows.mapInArrow(count, "pairs long").agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]
    return pairs / max(1, search.asked.count() * search.rings.agg(F.sum("n")).first()[0])
