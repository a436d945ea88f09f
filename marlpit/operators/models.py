"""Models as seams: loaded once in each worker, fed with batches of a fixed size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

BATCH = 64

#: Gives a function from texts (and of pairs, their partners) to an array with a row or a number for each.
Load = Callable[[], Callable[..., np.ndarray]]


def embedder(load: Load, batch: int = BATCH) -> Callable[[Column], Column]:
    """A column function that gives a text its vector by a model; a null text has none.

    `load` is run once in each worker that has rows, whatever their number, and what it gives is run on batches of at
    most so many texts.
    """
    model = predict_batch_udf(load, return_type=ArrayType(DoubleType()), batch_size=batch)
    return lambda text: F.when(text.isNotNull(), model(F.coalesce(text, F.lit(""))))


def scorer(load: Load, query: str, batch: int = BATCH) -> Callable[[Column], Column]:
    """A column function that scores a text for a query by a model of pairs, as `rerank` takes one; a null text scores null."""
    model = predict_batch_udf(load, return_type=DoubleType(), batch_size=batch)
    return lambda text: F.when(text.isNotNull(), model(F.lit(query), F.coalesce(text, F.lit(""))))
