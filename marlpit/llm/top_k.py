"""Exact top-k inner products: norm-sorted blocks, rotated partial sums and Cauchy-Schwarz bounds.

Vectors are dealt to shards by a hash, so that every shard holds long and short ones, and queries to groups. A cell is
a shard with a group of queries, both of bounded size. In it vectors come by falling length. All are rotated by the
right singular vectors of the whole table, which come from the sum of outer products, so that the first coordinates
hold most of the inner product. After each part of the coordinates the rest adds at most the product of the two rests'
lengths; pairs that can't reach the query's k-th best score go. A block whose longest vector times the query's length
can't reach it ends the query's search in the shard. What stays is scored in whole numbers. Queries start with the k-th
best score over a fixed number of the longest vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlpit.llm.common import written

#: Components of all vectors of a shard, of a group of queries and of the pilot, about; vectors that are scored at once.
SHARD, GROUP, PILOT, BLOCK = 8192 * 64, 4096 * 64, 2048 * 64, 1024
#: Shares of the coordinates after which pairs are judged.
PARTS = (0.5, 0.75)


def whole_numbers(column: str, scale: float) -> Column:
    """A vector's components times scale, rounded down; null for vectors that are null or hold a null or non-finite one."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform(column, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    return F.when(~bad, scaled)


def matrix(rows: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.int64) for x in rows]) if rows else np.zeros((0, 0), np.int64)


def exact(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of all rows as whole numbers; doubles hold them if they are below 2^53."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * queries.shape[1]
    if most < 2**53:
        return (queries.astype(float) @ vectors.T.astype(float)).astype(np.int64)
    return queries @ vectors.T


class Side:
    """Vectors of one side of a cell: whole, rotated, and the lengths of what is left after each part."""

    def __init__(self, whole: np.ndarray, rotation: np.ndarray):
        self.whole, self.turned = whole, whole.astype(float) @ rotation
        self.cuts = sorted({max(1, int(share * whole.shape[1])) for share in PARTS})
        self.length = np.sqrt((self.turned**2).sum(1))
        self.rest = [np.sqrt((self.turned[:, cut:] ** 2).sum(1)) for cut in self.cuts]


def search(queries: np.ndarray, own: np.ndarray, least: np.ndarray, vectors: np.ndarray, uids: np.ndarray, ids: np.ndarray, k: int, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's index, vector's index, score) of each query's k best among vectors, ties to smaller ids.

    own: the queries' uids. least: scores that k vectors elsewhere are known to reach; lower ones may be left out.
    """
    order = np.lexsort((ids, -np.sqrt((vectors.astype(float) ** 2).sum(1))))
    left, right = Side(queries, rotation), Side(vectors[order], rotation)
    least, open_ = least.astype(float).copy(), np.arange(len(queries))
    best = [np.zeros(0, np.int64) for _ in range(3)]
    slack = 1e-9 * (left.length.max(initial=0) + 1) * (right.length.max(initial=0) + 1)
    for start in range(0, len(order), BLOCK):
        block = slice(start, start + BLOCK)
        open_ = open_[left.length[open_] * right.length[start] + slack >= least[open_]]
        if not len(open_):
            break
        q, v, done, sums = np.repeat(open_, len(right.length[block])), np.tile(np.arange(start, start + len(right.length[block])), len(open_)), 0, None
        for cut, rest_q, rest_v in zip(left.cuts, left.rest, right.rest, strict=True):
            if sums is None:
                sums = (left.turned[open_, :cut] @ right.turned[block, :cut].T).ravel()
            else:
                sums = sums + np.einsum("ij,ij->i", left.turned[q, done:cut], right.turned[v, done:cut])
            on = sums + rest_q[q] * rest_v[v] + slack >= least[q]
            q, v, sums, done = q[on], v[on], sums[on], cut
        if len(q) * 4 > len(open_) * BLOCK:  # most are left: all at once is faster
            place = np.full(len(queries), -1)
            place[open_] = np.arange(len(open_))
            scores = exact(queries[open_], right.whole[block])[place[q], v - start]
        else:
            scores = np.concatenate([np.einsum("ij,ij->i", queries[q[i : i + 65536]], right.whole[v[i : i + 65536]]) for i in range(0, len(q), 65536)]) if len(q) else np.zeros(0, np.int64)
        v = order[v]
        on = (scores >= least[q]) & (uids[v] != own[q])
        best = [np.concatenate(x) for x in zip(best, (q[on], v[on], scores[on]), strict=True)]
        by = np.lexsort((uids[best[1]], ids[best[1]], -best[2], best[0]))
        best = [x[by] for x in best]
        first = np.searchsorted(best[0], best[0], "left")
        rank = np.arange(len(first)) - first
        best = [x[rank < k] for x in best]
        last = rank[rank < k] == k - 1
        least[best[0][last]] = np.maximum(least[best[0][last]], best[2][last])
    return best[0], best[1], best[2]


def outer_sums(vectors: DataFrame, width: int) -> np.ndarray:
    """The sum of outer products of all vectors: width x width numbers, summed by Spark over the tasks' sums."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            part = matrix(batch.column("whole").to_pylist()).astype(float)
            if len(part):
                total += part.T @ part
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(width * width)), "x": pa.array(total.ravel())})

    sums = vectors.select("whole").mapInArrow(add, "at long, x double").groupBy("at").agg(F.sum("x").alias("x"))
    total = np.zeros(width * width)
    for row in sums.collect():
        total[row.at] = row.x
    return total.reshape(width, width)


def packed(rows: DataFrame, by: str, more: str = "") -> DataFrame:
    """One row of binary columns for each value of a column: uids, ids, whole and, if named, one more column."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):  # one by one: each holds the vectors of a shard or group
                row = batch.slice(at, 1).to_pylist()[0]
                items = row["items"]
                out = {by: [row[by]], "uids": [np.array([x["uid"] for x in items], np.int64).tobytes()], "ids": [np.array([x["id"] for x in items], np.int64).tobytes()], "whole": [b"".join(x["whole"] for x in items)]}
                if more:
                    out[more] = [np.array([x[more] for x in items], np.float64).tobytes()]
                yield pa.RecordBatch.from_pydict(out)

    fields = ["uid", "id", "whole", *([more] if more else [])]
    grouped = rows.groupBy(by).agg(F.collect_list(F.struct(*fields)).alias("items"))
    return grouped.mapInArrow(pack, f"{by} long, uids binary, ids binary, whole binary" + (f", {more} binary" if more else ""))


def top_inner_products(rows: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k vectors with the largest inner products with each query row.

    Components are scaled and rounded down, scores are whole numbers and exact while they are below 2^63. Vectors that
    are null or hold a null or non-finite component take no part; a shorter vector counts as if zeros followed. A
    query's own row is no candidate, a repeated row is; ties go to the smaller id, null ids last. Fewer than k
    candidates give fewer ranks. Other columns are ignored, whatever their names. An empty table, or one without
    queries, gives an empty result. Queries meet all rows, in cells of bounded size.
    """
    spark = rows.sparkSession
    taken = rows.select(F.col(id_col).cast("long").alias("id"), whole_numbers(vector_col, scale).alias("whole"), F.coalesce(is_query, F.lit(False)).alias("asks")).filter("whole is not null")
    taken = written(taken.select(F.monotonically_increasing_id().alias("uid"), "*"))
    width, number, asking = taken.agg(F.coalesce(F.max(F.size("whole")), F.lit(0)), F.count("*"), F.count_if("asks")).first()
    width = max(1, width)

    def to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = [np.array(x + [0] * (width - len(x)), np.int64) for x in batch.column("whole").to_pylist()]
            length = pa.array([float((x.astype(float) ** 2).sum()) for x in whole], pa.float64())
            ids = batch.column("id").fill_null(2**63 - 1)
            yield pa.RecordBatch.from_pydict({"uid": batch.column("uid"), "id": ids, "asks": batch.column("asks"), "whole": pa.array([x.tobytes() for x in whole], pa.binary()), "length": length})

    vectors = written(taken.mapInArrow(to_bytes, "uid long, id long, asks boolean, whole binary, length double"))
    values, axes = np.linalg.eigh(outer_sums(vectors, width))
    rotation = axes[:, np.argsort(-values)]
    # each task sends its longest to the driver: names alone, the vectors of those that are chosen follow
    names = vectors.select("length", "uid").orderBy(F.desc("length"), "uid").limit(max(k + 1, PILOT // width)).collect()
    chosen = spark.createDataFrame([(x.uid,) for x in names], "uid long")
    longest = vectors.select("uid", "id", "whole").join(F.broadcast(chosen), "uid", "left_semi").collect()
    pilot = spark.sparkContext.broadcast((matrix([x.whole for x in longest]), np.array([x.uid for x in longest], np.int64), np.array([x.id for x in longest], np.int64)))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long, uids, ids = pilot.value
        for batch in batches:
            queries, own = matrix(batch.column("whole").to_pylist()), batch.column("uid").to_numpy()
            least = np.full(len(own), -np.inf)
            for at in range(0, len(own), BLOCK):
                part = slice(at, at + BLOCK)
                q, _, scores = search(queries[part], own[part], least[part], long, uids, ids, k, rotation)
                full = np.flatnonzero(np.bincount(q, minlength=len(own[part])) == k)
                for i in full:
                    least[at + i] = scores[q == i].min()
            yield pa.RecordBatch.from_pydict({"uid": batch.column("uid"), "id": batch.column("id"), "whole": batch.column("whole"), "least": pa.array(least)})

    asks = vectors.filter("asks").select("uid", "id", "whole").mapInArrow(start, "uid long, id long, whole binary, least double")
    shards, groups = max(1, math.ceil(number * width / SHARD)), max(1, math.ceil(asking * width / GROUP))
    place = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    held = packed(vectors.withColumn("shard", place(shards)), "shard").withColumn("group", every(groups))
    asked = packed(asks.withColumn("group", place(groups)), "group", "least").select("group", "least", *[F.col(c).alias(f"q_{c}") for c in ("uids", "ids", "whole")])
    # estimates don't know how large a packed row is: without the hint all cells' queries would pass through the driver
    cells = held.join(asked.withColumn("shard", every(shards)).hint("merge"), ["shard", "group"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cell = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                number = {name: np.frombuffer(cell[name], np.int64) for name in ("uids", "ids", "whole", "q_uids", "q_ids", "q_whole")}
                least = np.frombuffer(cell["least"], np.float64)
                vectors, queries = number["whole"].reshape(-1, width), number["q_whole"].reshape(-1, width)
                for at in range(0, len(queries), BLOCK):
                    part = slice(at, at + BLOCK)
                    q, v, scores = search(queries[part], number["q_uids"][part], least[part], vectors, number["uids"], number["ids"], k, rotation)
                    yield pa.RecordBatch.from_pydict({"query": number["q_uids"][part][q], "query_id": number["q_ids"][part][q], "uid": number["uids"][v], "id": number["ids"][v], "score": scores.astype(np.int64)})

    found = cells.mapInArrow(answer, "query long, query_id long, uid long, id long, score long")
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id", "uid"))
    ranked = found.withColumn("rank", best).filter(F.col("rank") <= k)
    known = lambda c: F.when(F.col(c) != F.lit(2**63 - 1), F.col(c))
    return ranked.select(known("query_id").alias("query_id"), "rank", known("id").alias(id_col), "score")
