"""How filters interact: what each removes in every order, from one product of a histogram with incidence matrices.

A document's failures are a mask of one bit a filter. Spark counts the masks of each part of the documents, once for all
and once for each label: rows of 32 numbers with five filters. Outcomes don't depend on documents but on masks: for each
order and step a mask is kept, removed here, failing but removed earlier, or failing this filter alone. These are integer
matrices of 32 rows and 600 columns, and the counts of all orders are products of the stacked histograms with them.

Copies are told by a digest of the text. Which of them has the smallest id is a join by digest and id, so that a group
of copies, whatever its size, is spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlpit.llm.common import text_or_empty, written

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
#: Of each mask: documents, those labelled good, those labelled toxic.
COUNTED = ("n", "good", "toxic")


def text_failures(text: Column) -> Column:
    """The bits of the filters that look at a text alone: few words, few distinct ones, capitals, signs."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    number, distinct = F.size(words), F.size(F.array_distinct(words))
    failed = (
        number < 200,
        100 * distinct < 50 * number,
        100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.char_length(text),
        text.rlike("[#$%&*|]"),
    )
    return sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(failed)), F.lit(0)).cast("int")


@lru_cache(maxsize=1)
def outcomes() -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """(order, step) of each column, and a matrix of masks by columns for kept, removed, redundant, unique and shapley."""
    columns = [("".join(order), step) for order in permutations(FILTERS) for step in range(1, len(FILTERS) + 1)]
    bit = lambda letters: sum(1 << FILTERS.index(x) for x in letters)
    own = np.array([bit(order[step - 1]) for order, step in columns])
    earlier = np.array([bit(order[: step - 1]) for order, step in columns])
    masks = np.arange(MASKS)[:, None]
    fails, gone = (masks & own) > 0, (masks & earlier) > 0
    found = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": masks == own}
    found = {k: x.astype(np.int64) for k, x in found.items()}
    found["shapley"] = np.stack([found["removed"][:, own == x].sum(1) for x in own], 1)
    return columns, found


def histograms(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(part, masks): of each part the counts of each mask that occurs, 32 at most."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(part_col).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text_failures(text).alias("failed"))
    rows = written(rows.groupBy("id", "digest", "part", "failed").agg(F.count("*").alias("n")))
    first = rows.groupBy(F.col("digest").alias("its")).agg(F.min("id").alias("first"))
    copies = rows.join(first, (rows["digest"] == first["its"]) & (rows["id"] == first["first"]), "left")
    copied = F.when(F.col("first").isNull() & F.col("id").isNotNull(), 1 << FILTERS.index("E")).otherwise(0)
    masked = copies.groupBy("id", "part", (F.col("failed") + copied).alias("mask")).agg(F.sum("n").alias("n"))  # a hot or null id is a few rows
    said = labels.select(F.col(id_col).alias("about"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("good"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"))
    said = said.filter("good or toxic").groupBy("about").agg(F.max(F.col("good").cast("int")).alias("good"), F.max(F.col("toxic").cast("int")).alias("toxic"))
    labelled = masked.join(said, masked["id"] == said["about"], "left")
    amount = lambda c: F.coalesce(F.sum(F.col("n") * F.col(c)), F.lit(0)).alias(c)
    counts = labelled.groupBy("part", "mask").agg(F.sum("n").alias("n"), amount("good"), amount("toxic"))
    return counts.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTED)).alias("masks"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows a part.

    A null text counts as empty, a null part as an empty name. Repeated rows count each. A document fails E if a smaller
    id has the same text; a null id is smaller or larger than none and has no labels. Of several label rows of an id one
    that says 1 is enough; labels other than 1, and of unknown ids, say nothing. Other columns are ignored, whatever
    their names. An empty table gives an empty result. Ids may be of any type that has an order.
    """

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, matrices = outcomes()
        orders, steps = pa.array([order for order, _ in columns]), pa.array([step for _, step in columns], pa.int32())
        for batch in batches:
            for part, masks in zip(batch.column("part").to_pylist(), batch.column("masks").to_pylist(), strict=True):
                stacked = np.zeros((len(COUNTED), MASKS), np.int64)
                for found in masks:
                    stacked[:, found["mask"]] = [found[c] for c in COUNTED]
                product = {name: stacked @ matrix for name, matrix in matrices.items()}
                lost = dict(zip(COUNTED, product["removed"], strict=True))
                out = {"part": pa.array([part] * len(columns)), "filter_order": orders, "step": steps}
                out |= {name: pa.array(product[name][0]) for name in ("kept", "removed", "redundant", "unique_fails")}
                out |= {"good_lost": pa.array(lost["good"]), "toxic_lost": pa.array(lost["toxic"]), "shapley": pa.array(product["shapley"][0])}
                yield pa.RecordBatch.from_pydict(out)

    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return histograms(docs, labels, id_col, text_col, part_col).mapInArrow(multiply, schema)
