"""Scores of agents' documents as a stream: state by document, running sums by agent, levels read at any time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marlpit.functions.scoring import confidence_level
from marlpit.sources.tables import store, stored

#: Sums are kept in whole millionths of millionths, so that they don't depend on the order of updates.
EXACT = "decimal(38,12)"


def difference(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """What a document's new score changes in its agent's sums: documents more, score gained and lost.

    Of several scores in a batch the highest counts.
    """
    old = state.get[0] if state.exists else None
    new = max(float(frame["score"].max()) for frame in frames)
    state.update((new,))
    if new != old:
        yield pd.DataFrame({"agent": [key[0]], "n": [int(old is None)], "gained": [new], "lost": [old or 0.0]})


def score_differences(updates: DataFrame) -> DataFrame:
    """(agent, n, gained, lost) by updates (agent, document_id, score), a stream. Rows with a null or NaN change nothing.

    State is one number for each document of an agent, dealt out by both, so that an agent with most documents is no
    task of its own. It has no time to live: what a document scored last stays in the mean, as in a table.
    """
    whole = updates.select(F.col("agent").cast("string"), F.col("document_id").cast("string"), F.col("score").cast("double")).dropna()
    return whole.groupBy("agent", "document_id").applyInPandasWithState(difference, "agent string, n long, gained double, lost double", "score double", "append", GroupStateTimeout.NoTimeout)


def fold(folder: str) -> Callable[[DataFrame, int], None]:
    """Adds a batch of differences to the stored sums. A batch that comes again after a failure changes nothing."""

    def add(batch: DataFrame, number: int) -> None:
        total = F.sum(F.col("gained").cast(EXACT) - F.col("lost").cast(EXACT)).cast(EXACT)
        change = batch.groupBy("agent").agg(F.sum("n").alias("more"), total.alias("change"))
        held = stored(batch.sparkSession, folder, "agent_scores")
        sums = change.join(held, "agent", "left").filter(F.col("batch").isNull() | (F.col("batch") < number))
        n, whole = F.coalesce("n", F.lit(0)) + F.col("more"), F.coalesce("total", F.lit(0)) + F.col("change")
        store(batch.sparkSession, folder, "agent_scores", sums.select("agent", n.alias("n"), whole.cast(EXACT).alias("total"), F.lit(number).cast("long").alias("batch")))

    return add


def score_stream(updates: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keeps sums of scores by agent in a folder, which belongs to this checkpoint, up to the end of what is there now.

    Started again it goes on from its checkpoint, also after a failure anywhere.
    """
    return score_differences(updates).writeStream.foreachBatch(fold(folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def agent_levels(spark: SparkSession, folder: str) -> DataFrame:
    """(agent, documents, confidence): the level of the mean score of each agent's documents; 0 without documents."""
    mean = F.when(F.col("n") > 0, F.col("total").cast("double") / F.col("n")).otherwise(0.0)
    return stored(spark, folder, "agent_scores").select("agent", F.col("n").alias("documents"), confidence_level(F.round(mean, 9)).alias("confidence"))
