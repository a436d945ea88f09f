"""Content identity: registration of new documents, known ones by their hash."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlpit.functions.text import document_id
from marlpit.sources.scratch import written

#: Rows that are ranked in one task, about; most slices; sampled values for each slice.
SLICE_ROWS, SLICES_MOST, SAMPLED = 100_000, 16_384, 16


def register(files: DataFrame, registry: DataFrame, hash_col: str = "sha256", order_col: str = "path", counted: DataFrame | None = None) -> DataFrame:
    """(order, sha256, document_id, known) of every file.

    A hash that the registry holds keeps its document id. New hashes are numbered on from the registry's count, in the
    order of the first file that has them. Numbers come from counts by slices of the order, so no task sees all files.
    A file without a hash has no document id and isn't known; it takes no number. If the registry is given by those of its
    rows alone that the files can have, `counted` has all of them.
    """
    own = written(files.select(F.col(order_col), F.col(hash_col).alias("sha256")))
    first = own.filter("sha256 is not null").groupBy("sha256").agg(F.min(order_col).alias("first"))
    fresh = written(first.join(registry.select("sha256").distinct(), "sha256", "left_anti"))
    numbered = positions(fresh, "first").crossJoin(F.broadcast((registry if counted is None else counted).agg(F.count("*").alias("count"))))
    ids = numbered.select("sha256", document_id(F.col("count") + F.col("position")).alias("document_id"), F.lit(False).alias("known"))
    old = registry.join(own.select("sha256"), "sha256", "left_semi").groupBy("sha256").agg(F.min("document_id").alias("document_id")).withColumn("known", F.lit(True))
    unread = own.filter("sha256 is null").select("sha256", order_col, F.lit(None).cast("string").alias("document_id"), F.lit(False).alias("known"))
    return own.join(ids.unionByName(old), "sha256").unionByName(unread)


def slice_of(column: Column, bounds: list) -> Column:
    """How many of the sorted bounds a value reaches, by two searches of about the root of their number."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    held = lambda xs: F.array(*[F.lit(x) for x in xs])
    first = F.greatest(F.size(F.filter(held(bounds[::step]), lambda b: b <= column)) - 1, F.lit(0)) * step
    return first + F.size(F.filter(F.slice(held(bounds), first + 1, F.lit(step)), lambda b: b <= column))


def positions(rows: DataFrame, by: str) -> DataFrame:
    """Rows with their position, from 1, in the order of a column without repeats or nulls, of any type with an order.

    Sampled values, drawn by hash, cut the rows into slices of about equal size, as many as the rows' number asks for.
    A slice's rows are ranked in one task, and the slices' counts are summed up.
    """
    slices = min(SLICES_MOST, math.ceil(rows.count() / SLICE_ROWS))
    bounds: list = []
    if slices > 1:
        drawn = rows.select(F.col(by).alias("x")).orderBy(F.xxhash64(by)).limit(slices * SAMPLED)
        values = sorted(r.x for r in drawn.collect())
        bounds = sorted({values[k * len(values) // slices] for k in range(1, slices)})
    sliced = rows.select(F.struct(*rows.columns).alias("row"), F.col(by).alias("by"), slice_of(F.col(by), bounds).alias("slice"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = sliced.groupBy("slice").agg(F.count("*").alias("n")).select("slice", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("slice").orderBy("by"))
    return sliced.withColumn("rank", rank).join(F.broadcast(counts), "slice").select("row.*", (F.col("before") + F.col("rank")).alias("position"))
