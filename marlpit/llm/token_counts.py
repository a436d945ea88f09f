"""Token counts: dynamic programming over prefixes of a text.

In byte-pair encoding the encoding of a prefix is the encoding of a shorter prefix plus one token that is compatible
with the token before it. A pair of tokens is compatible if encoding their concatenation gives the pair back. So the
last token of each prefix follows from the last tokens of the shorter ones, and the exact count at every prefix from
one addition; truncation and budget questions read the counts and encode nothing again.

No piece of the vocabulary holds the space mark after another character, so the program runs over each run of space
marks with the word behind it, once for each distinct one, and a text's counts are running sums over its words.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlpit.llm.common import map_arrow, text_or_empty

#: The character that stands for a space inside pieces.
MARK = "▁"
DEFAULT_MODEL = "piece_bpe_32k.model"
#: Distinct words, pairs and word beginnings that a worker remembers; beyond it that memory starts anew.
WORDS_KEPT, PAIRS_KEPT, STEMS_KEPT = 1_000_000, 600_000, 100_000
#: Lengths of the word beginnings whose program is remembered, the longest first.
STEMS = (12, 9, 7, 5)


class PrefixCounter:
    """Exact token counts at all prefixes for one sentencepiece BPE model with byte fallback."""

    def __init__(self, model_path: str):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.score = {
            processor.id_to_piece(i): processor.get_score(i)
            for i in range(processor.get_piece_size())
            if not (processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i))
        }
        if any(MARK in piece.lstrip(MARK) for piece in self.score):
            raise ValueError("pieces with an inner space mark: words of this model aren't independent")
        #: Every end of a piece, with the piece that it is itself, if any.
        self.tails = {piece[k:]: "" for piece in self.score for k in range(1, len(piece))} | {piece: piece for piece in self.score}
        #: No merge joins two characters that stand in no piece side by side.
        self.joined = {piece[k : k + 2] for piece in self.score for k in range(len(piece) - 1)}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.steps: dict[str, bytes] = {}
        self.stems: dict[str, tuple[list[str], list[int]]] = {}
        #: Merges in the order of their scores; a single character is there from the start.
        order = sorted(self.score, key=self.score.get, reverse=True)
        self.rank = {piece: k for k, piece in enumerate(order) if len(piece) > 1}
        self.halves: dict[str, tuple[str, str]] = {}
        for piece in self.rank:
            parts = self.merged(piece, 2)
            if len(parts) == 2 and max(self.rank.get(x, -1) for x in parts) < self.rank[piece]:
                self.halves[piece] = (parts[0], parts[1])

    def merged(self, text: str, least: int = 1) -> list[str]:
        """Pieces of a short text by merging the best pair again and again, the leftmost of equals first, down to least."""
        parts = list(text)
        while len(parts) > least:
            scores = [self.score.get(a + b, -np.inf) for a, b in zip(parts, parts[1:], strict=False)]
            best = max(scores)
            if best == -np.inf:
                break
            k = scores.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def meet(self, left: str, right: str) -> bool:
        """True if no merge ever crosses the border of two pieces.

        Undoes their merges from the last to the first. The parts at the border would have merged if their joint rank
        came before that of the merge that ended their time there; of equal ranks the left one comes first.
        """
        rank, before = self.rank, np.inf
        while True:
            if rank.get(left + right, np.inf) < before:
                return False
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                before, left = a, self.halves[left][1]
            else:
                before, right = b + 1, self.halves[right][0]

    def compatible(self, left: str, right: str) -> bool:
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > PAIRS_KEPT:
                self.pairs.clear()
            plain = all(len(x) < 2 or x in self.halves for x in key)
            known = self.meet(left, right) if left and plain else self.merged(left + right) == [x for x in key if x]
            self.pairs[key] = known
        return known

    def word_steps(self, word: str) -> bytes:
        """For each character of a word, what it adds to the count of tokens, as signed bytes.

        Prefixes that an earlier word shares are not worked out again.
        """
        tails, pairs = self.tails, self.pairs
        last, counts = [""], [0]
        for length in STEMS:
            if length < len(word) and (known := self.stems.get(word[:length])):
                last, counts = known[0][:], known[1][:]
                break
        for end in range(len(last), len(word) + 1):
            pieces, start = [], end - 1
            while start >= 0:
                piece = tails.get(word[start:end])
                if piece is None:
                    break
                if piece:
                    pieces.append(piece)
                start -= 1
            tokens = 1
            for piece in reversed(pieces):
                left = last[end - len(piece)]
                fits = pairs.get((left, piece))
                if fits or fits is None and self.compatible(left, piece):
                    break
            else:  # no vocabulary entry for this character: its bytes
                piece = word[end - 1]
                tokens = len(piece.encode())
            last.append(piece)
            counts.append(counts[end - len(piece)] + tokens)
            if end in STEMS:
                if len(self.stems) > STEMS_KEPT:
                    self.stems.clear()
                self.stems[word[:end]] = last[:], counts[:]
        return bytes([(b - a) & 255 for a, b in zip(counts, counts[1:], strict=False)])

    def step(self, word: str) -> bytes:
        known = self.steps.get(word)
        if known is None:
            if len(self.steps) > WORDS_KEPT:
                self.steps.clear()
            bare = word.lstrip(" ")
            marked = MARK * (len(word) - len(bare)) + bare
            cuts = [k for k in range(1, len(marked)) if marked[k - 1 : k + 1] not in self.joined]
            if cuts:
                known = b"".join([self.step(word[a:b]) for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)])
            else:
                known = self.word_steps(marked)
            self.steps[word] = known
        return known

    def counts(self, text: str) -> np.ndarray:
        """Tokens of text[:i] for i from 0 to len(text)."""
        if not text:
            return np.zeros(1, np.int32)
        text = " " + text.replace(MARK, " ")
        steps = b"".join(map(self.step, re.findall(" +[^ ]*", text)))
        found = np.frombuffer(steps, np.int8).cumsum(dtype=np.int32)
        found[0] = 0  # the mark before a text belongs to its first character
        return found


@lru_cache(maxsize=2)
def prefix_counter(model_path: str) -> PrefixCounter:
    """One counter for each worker process, with what it has learned from earlier batches."""
    return PrefixCounter(model_path)


def longest_within(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most budget tokens; counts may fall as a prefix grows."""
    return len(counts) - 1 - int(np.argmax(counts[::-1] <= budget))


def prefix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """(id, prefix_counts): the exact token count at every prefix of every text, len(text) + 1 numbers.

    A null text counts as empty: one number, 0. Null ids stay null; repeated rows give repeated rows; other columns
    are ignored, whatever their names. An empty table gives an empty result.
    """
    path = model_path or public_tokenizers.path(DEFAULT_MODEL)

    def count(batch: pa.RecordBatch) -> dict:
        counter = prefix_counter(path)
        found = [counter.counts(text) for text in batch.column("text").to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
        return {"id": batch.column("id"), "prefix_counts": pa.ListArray.from_arrays(offsets, np.concatenate(found))}

    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return map_arrow(own, count, f"id {kind}, prefix_counts array<int>").withColumnRenamed("id", id_col)


def token_counts(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, chars_within): answers read from each text's prefix counts.

    chars_within is the length of the longest prefix of at most limit tokens. Edge cases as in prefix_counts; the
    arrays themselves stay in the batch, so memory is bounded by a batch and its longest text.
    """
    path = model_path or public_tokenizers.path(DEFAULT_MODEL)

    def answer(batch: pa.RecordBatch) -> dict:
        counter, total, within = prefix_counter(path), [], []
        for text in batch.column("text").to_pylist():
            counts = counter.counts(text)
            total.append(int(counts[-1]))
            within.append(len(text) if total[-1] <= limit else longest_within(counts, limit))
        return {
            "id": batch.column("id"),
            "n_bytes": batch.column("n_bytes"),
            "n_tokens": pa.array(total, pa.int64()),
            "over_limit": pa.array([n > limit for n in total], pa.bool_()),
            "chars_within": pa.array(within, pa.int64()),
        }

    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    own = own.withColumn("n_bytes", F.octet_length("text").cast("long"))
    schema = f"id {kind}, n_bytes long, n_tokens long, over_limit boolean, chars_within long"
    return map_arrow(own, answer, schema).withColumnRenamed("id", id_col)
