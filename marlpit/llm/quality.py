"""Quality classifier: naive Bayes support vectors.

Indicators of n-grams are scaled by the log of the ratio between their smoothed counts in good and bad documents. A
linear model with hinge loss is then fitted to the scaled vectors by dual coordinate descent. n-grams are words, pairs
of words, and up to three of the forms of words (runs of capitals, small letters, digits and other characters), with a
mark where a word repeats the one before. A sigmoid fitted to margins held back turns margins into probabilities.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from marlpit.llm.common import in_pieces, text_or_empty

#: n-grams are hashed to so many numbers.
DIMENSIONS = 1 << 20
#: Most labelled documents, on average, that the model is fitted to. They are drawn by a hash of their ids.
SAMPLE = 16_000
WORDS_KEPT = 100_000
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
UPPER, LOWER, DIGITS, RUN = re.compile(r"[A-ZÀ-ÖØ-Þ]+"), re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), re.compile(r"\d+"), re.compile(r"(.)\1+", re.DOTALL)


def form(word: str) -> str:
    """A word with its letters, digits and repeats run together: Word!! gives Aa!+."""
    return RUN.sub(r"\1+", DIGITS.sub("0", LOWER.sub("a", UPPER.sub("A", word))))


class Words(dict):
    """A word's hash with its form's in the low 16 bits; beyond a number of words it starts anew."""

    def __missing__(self, word: str) -> int:
        if len(self) > WORDS_KEPT:
            self.clear()
        low = xxhash.xxh3_64_intdigest(form(word).encode()) & 0xFFFF
        found = self[word] = xxhash.xxh3_64_intdigest(word.lower().encode()) & ~0xFFFF | low
        return found


@lru_cache(maxsize=1)
def known_words() -> Words:
    return Words()


def features(text: str) -> np.ndarray:
    """The distinct n-grams of a text as sorted numbers. The first, 0, every text has."""
    words = text.split()
    both = np.fromiter(map(known_words().__getitem__, words), np.uint64, len(words))
    word, shape = both >> np.uint64(16), both & np.uint64(0xFFFF)
    shape = shape * np.uint64(2)
    shape[1:] += word[1:] == word[:-1]
    grams = [word * MIX[0], word[:-1] * MIX[1] + word[1:] * MIX[2]]
    shape = (shape + np.uint64(1)) * MIX[0]
    shape ^= shape >> np.uint64(31)
    for n in (1, 2, 3):
        if len(words) >= n:
            grams.append(sum(shape[k : len(shape) - n + 1 + k] * MIX[k] for k in range(n)) + np.uint64(n))
    mixed = np.concatenate(grams)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * MIX[1]
    return np.unique(np.concatenate([[0], mixed >> np.uint64(64 - 20)]).astype(np.int32))


@dataclass
class Model:
    weights: np.ndarray  # of indicators: their log-count ratio times their weight
    squares: np.ndarray  # of their log-count ratios
    slope: float
    intercept: float

    def margin(self, found: np.ndarray) -> float:
        return float(self.weights[found].sum()) / math.sqrt(float(self.squares[found].sum()) + 1e-12)

    def score(self, text: str) -> float:
        return 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, self.slope * self.margin(features(text)) + self.intercept))))


def log_count_ratios(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    counts = [np.ones(DIMENSIONS), np.ones(DIMENSIONS)]
    for found, label in zip(rows, good, strict=True):
        counts[int(label)][found] += 1
    seen = (counts[0] + counts[1]) > 2
    ratios = np.where(seen, np.log(counts[1] / counts[1][seen].sum()) - np.log(counts[0] / counts[0][seen].sum()), 0.0)
    ratios[0] = 1.0  # what every text has stands for the constant
    return ratios


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], good: np.ndarray, cost: float = 1.0, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Weights that minimize |w|^2 / 2 + sum of cost * max(0, 1 - y w x), rarer labels at a higher cost."""
    sign = np.where(good, 1.0, -1.0)
    costs = np.where(good, 0.5 / max(good.mean(), 1e-9), 0.5 / max(1 - good.mean(), 1e-9)) * cost
    squares = np.array([float(x @ x) for x in values])
    alpha, weights, rng = np.zeros(len(rows)), np.zeros(DIMENSIONS), np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            slope = sign[i] * float(weights[rows[i]] @ values[i]) - 1.0
            after = min(max(alpha[i] - slope / squares[i], 0.0), costs[i])
            if after != alpha[i]:
                weights[rows[i]] += (after - alpha[i]) * sign[i] * values[i]
                moved, alpha[i] = max(moved, abs(after - alpha[i])), after
        if moved < 1e-3:
            break
    return weights


def sigmoid_fit(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the probability of a good label by Newton's steps on slightly smoothed labels."""
    want = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
    x, at = np.stack([margins, np.ones(len(margins))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - want))
        at = at - np.clip(step, -5, 5)
    return float(at[0]), float(at[1])


def fit_rows(rows: list[np.ndarray], good: np.ndarray) -> Model:
    """The model of labelled rows. Without both labels every margin is 0, and the score the smoothed share of good ones."""
    share = (good.sum() + 1) / (len(good) + 2)
    if len(rows) < 10 or min(good.sum(), (~good).sum()) < 2:
        return Model(np.zeros(DIMENSIONS, np.float32), np.zeros(DIMENSIONS, np.float32), 0.0, math.log(share / (1 - share)))

    def trained(part: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        own, labels = [rows[i] for i in part], good[part]
        ratios = log_count_ratios(own, labels)
        norms = [math.sqrt(float((ratios[x] ** 2).sum())) for x in own]
        weights = dual_coordinate_descent(own, [(ratios[x] / n).astype(np.float32) for x, n in zip(own, norms, strict=True)], labels)
        return (weights * ratios).astype(np.float32), (ratios**2).astype(np.float32)

    turn = np.where(good, np.cumsum(good), np.cumsum(~good)) - 1  # a quarter of each label stays out for the sigmoid
    rest, back = np.flatnonzero(turn % 4).tolist(), np.flatnonzero(turn % 4 == 0).tolist()
    held = Model(*trained(rest), 1.0, 0.0)
    slope, intercept = sigmoid_fit(np.array([held.margin(rows[i]) for i in back]), good[back])
    return Model(*trained(list(range(len(rows)))), slope, intercept)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Fits the model to about `sample` labelled documents at most, in one task, which the sample bounds.

    An id whose labels differ, or are null, teaches nothing; of an id's repeated texts the smallest counts. Only ids
    that teach and have a document count for the share that is drawn.
    """
    taught = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).dropna().groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("high"))
    taught = taught.filter("label = high and label in (0, 1)").drop("high")
    known = taught.join(docs.select(F.col(id_col).alias("id")).distinct(), "id").count()
    drawn = F.pmod(F.xxhash64(F.lit("sample"), F.col("id")), F.lit(1 << 30)) < F.lit(int(min(1.0, sample / max(known, 1)) * (1 << 30)))
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).filter(drawn)
    rows = texts.join(taught.filter(drawn), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label"))

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            found = [features(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "good": pa.array([x == 1 for x in batch.column("label").to_pylist()], pa.bool_()), "found": pa.array([x.tobytes() for x in found], pa.binary())})

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", kind="stable")
        model = fit_rows([np.frombuffer(x, np.int32) for x in group["found"]], group["good"].to_numpy(bool))
        return pd.DataFrame({"weights": [model.weights.tobytes()], "squares": [model.squares.tobytes()], "slope": [model.slope], "intercept": [model.intercept]})

    kind = docs.schema[id_col].dataType.simpleString()
    vectors = rows.mapInArrow(numbers, f"id {kind}, good boolean, found binary")
    row = vectors.groupBy(F.lit("sample")).applyInPandas(learn, "weights binary, squares binary, slope double, intercept double").first()
    if row is None:
        return fit_rows([], np.zeros(0, bool))
    return Model(np.frombuffer(row.weights, np.float32), np.frombuffer(row.squares, np.float32), row.slope, row.intercept)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, folds: int = 5) -> DataFrame:
    """(id, held_out, score, predicted) for every whole text.

    Labels of ids whose CRC-32, as text, is a multiple of `folds` are never learned from: held_out. Null and empty
    texts get the score of the constant alone; a null id is not held out. Repeated rows give repeated rows; other
    columns are ignored, whatever their names. Without labels of both kinds all scores are equal. An empty table gives
    an empty result. The model, of a fixed size, is broadcast.
    """
    aside = F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels.filter(~aside), id_col, text_col, label_col))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            found = pa.array([model.value.score(x) for x in batch.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "held_out": batch.column("held_out"), "score": found})

    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), aside.alias("held_out"))
    scored = own.mapInArrow(score, f"id {kind}, held_out boolean, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """The documents, with all their columns, that score the threshold or more by a model of all labels.

    Null texts are scored as empty ones. Repeated rows share their fate. An empty table stays empty.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col))

    @F.arrow_udf(DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        return pa.array((model.value.score(x.as_py()) for x in texts), pa.float64())

    return docs.filter(score(text_or_empty(text_col)) >= threshold)
