"""Mixing sources to target weights by subset-sum budget fitting.

Sources share a budget by weight, none beyond a multiple of its own size. Within a source, documents are counted by
exact size. Whole passes over the source come first; of the rest of its budget each size gets its part, from the
smallest size up, so that what rounding leaves goes on to the next size. Less than the largest document is left then,
and a bounded knapsack over sizes closes it. Which documents of a size are taken follows from a seeded hash of their ids and texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlpit.llm.common import text_or_empty, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: Rows of a size and source are ranked in buckets of about so many, 16 at least.
BUCKET_ROWS = 100_000


def reachable(sizes: Sequence[int], counts: Sequence[int], goal: int, limit: int) -> tuple[int, list[tuple[int, int, int]]]:
    """Sums up to a limit, as bits, and the steps (size's index, how many at once, sums before), until a goal is met."""
    mask, sums, steps = (1 << (limit + 1)) - 1, 1, []
    for k in sorted(range(len(sizes)), key=lambda k: sizes[k]):
        left, chunk = min(counts[k], limit // sizes[k]) if sizes[k] else 0, 1
        while left and not sums >> goal & 1:
            chunk = min(chunk, left)
            steps.append((k, chunk, sums))
            sums = (sums | sums << sizes[k] * chunk) & mask
            left, chunk = left - chunk, 2 * chunk
    return sums, steps


def closest_subset(sizes: Sequence[int], counts: Sequence[int], budget: int) -> list[int]:
    """How many of each size to take so that their sum is next to the budget; the smaller sum of equals."""
    sums, steps = reachable(sizes, counts, budget, budget)
    at = sums.bit_length() - 1
    if at < budget:  # a sum beyond the budget is better only if it is nearer
        sums, steps = reachable(sizes, counts, budget, 2 * budget - at)
        above = sums >> budget
        if above and (over := (above & -above).bit_length() - 1) < budget - at:
            at = budget + over
    taken = [0] * len(sizes)
    for k, chunk, before in reversed(steps):
        if not before >> at & 1:
            taken[k] += chunk
            at -= sizes[k] * chunk
    return taken


def fit(sizes: Sequence[int], counts: Sequence[int], target: float, most: int) -> tuple[int, list[int]]:
    """Whole passes over a source, and how many documents of each size, in rising order, are taken once more."""
    total = sum(s * n for s, n in zip(sizes, counts, strict=True))
    goal = math.floor(target + 0.5)
    if not total:
        return 0, [0] * len(sizes)
    passes = min(goal // total, most)
    budget = goal - passes * total if passes < most else 0
    taken, due, done = [], 0, 0
    for size, n in zip(sizes, counts, strict=True):
        due += size * n
        taken.append(min(n, (budget * due // total - done) // size) if size else 0)
        done += size * taken[-1]
    more = closest_subset(sizes, [n - k for n, k in zip(counts, taken, strict=True)], budget - done)
    return passes, [a + b for a, b in zip(taken, more, strict=True)]


def targets(sources: DataFrame, share: float, weights: Sequence[float], most: float) -> DataFrame:
    """Of (key, source, source_size) the column target: shares by weight, none above most times its size.

    Sources fill up in the order of their limits over their weights, so the level of the others follows from running
    sums. The table has a row for each source.
    """
    by_code_point = Window.orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("weight", F.element_at(kinds, ((F.row_number().over(by_code_point) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(float(most))).withColumn("full_at", F.col("most") / F.col("weight"))
    filling = Window.orderBy("full_at", "key")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(F.desc("full_at"), F.desc("key")).rowsBetween(Window.unboundedPreceding, 0)  # a running sum from the end
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    leveled = ranked.withColumn("level", level)
    final = F.min(F.when(F.col("full_at") > F.col("level"), F.struct("full_at", "key", "level"))).over(everything)
    return leveled.withColumn("target", F.least("most", F.coalesce(final["level"], F.lit(math.inf)) * F.col("weight")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, weights: Sequence[float] = WEIGHTS, most: int = 2, seed: int = 17, carry: Sequence[str] = ()) -> DataFrame:
    """(id, size, source_size, target, taken, copies): what the mix takes of each document.

    Columns to carry come along in a struct, carried.
    A null text has size 0; null is a source of its own, the last. Documents without words are never counted. No
    document is taken more than `most` times. Null ids are hashed like any, with the text; repeated rows are taken each
    by itself;
    other columns are ignored, whatever their names. An empty table gives an empty result. Rows of one size and source
    are ranked in buckets, so no task holds a hot source; one task holds the distinct sizes of a source.
    """
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("="), source_col), F.lit("")).alias("key"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.crc32(text)).alias("draw"),
        F.crc32(text).alias("crc"),
        *([F.struct(*carry).alias("carried")] if carry else []),
    )
    buckets = max(16, math.ceil(docs.count() / BUCKET_ROWS))
    rows = rows.withColumn("bucket", F.pmod(F.shiftright("draw", 8), F.lit(buckets)))
    small = rows if carry else (rows := written(rows))
    counts = written(small.groupBy("key", "source", "size", "bucket").agg(F.count("*").alias("n")))
    by_source = counts.groupBy("key", "source", "size").agg(F.sum("n").alias("n")).groupBy("key", "source")
    by_source = by_source.agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.collect_list(F.struct("size", "n")).alias("sizes"))
    by_source = written(by_source)
    aims = targets(by_source.select("key", "source", "source_size"), share, weights, most).select("key", "target")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pairs = sorted((x["size"], x["n"]) for x in row["sizes"])
                sizes = [s for s, _ in pairs]
                passes, extra = fit(sizes, [n for _, n in pairs], row["target"], most)
                same = {k: [row[k]] * len(sizes) for k in ("key", "source_size", "target")}
                found = same | {"size": sizes, "passes": [passes] * len(sizes), "extra": extra}
                yield pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) for f in fitted_schema], schema=fitted_schema)

    fitted_schema = pa.schema([("key", pa.string()), ("source_size", pa.int64()), ("target", pa.float64()), ("size", pa.int64()), ("passes", pa.int64()), ("extra", pa.int64())])
    fitted = by_source.join(aims, "key").mapInArrow(solve, "key string, source_size long, target double, size long, passes long, extra long")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    due = counts.select("key", "size", "bucket", before.alias("before"), "n").join(fitted, ["key", "size"])
    due = due.withColumn("due", F.least("n", F.greatest(F.col("extra") - F.col("before"), F.lit(0)))).drop("n", "before", "extra")
    rank = F.row_number().over(Window.partitionBy("key", "size", "bucket").orderBy("draw", "id", "crc"))
    taken = rows.drop("source").withColumn("rank", rank).join(due, ["key", "size", "bucket"])
    copies = F.when(F.col("size") > 0, F.col("passes") + (F.col("rank") <= F.col("due")).cast("long")).otherwise(F.lit(0))
    taken = taken.withColumn("copies", copies)
    return taken.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", *(["carried"] if carry else []))
