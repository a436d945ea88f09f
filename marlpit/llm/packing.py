"""Best-fit packing, certified by lower bounds.

Documents are dealt to partitions and packed there by best-fit decreasing. Dual-feasible functions map lengths so that
no bin's sum can pass 1: the sum over a partition, rounded up, is a number of bins that no packing can beat. A partition
that reaches it is certified. Documents in the partly filled sequences of the others, and in the two emptiest sequences
of certified ones, are exchanged: dealt anew to fewer partitions and packed again, round by round.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlpit.llm.byte_bpe import byte_bpe
from marlpit.llm.common import in_pieces, text_or_empty, written

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
#: Most sequences' worth of tokens, and most pieces, that are dealt to one partition.
SEQUENCES_A_PART, PIECES_A_PART = 4096, 100_000
END_ID = 0


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole ones, the first shorter where n isn't a multiple."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *[(start, capacity) for start in range(first, n, capacity)]]


def pieces_of(docs: DataFrame, capacity: int, id_col: str, text_col: str, tokenizer_path: str) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every piece of every document; a null text counts as empty."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(tokenizer_path)
        end = np.uint32(END_ID).tobytes()
        for batch in in_pieces(batches):
            rows, out = [], {"piece": [], "start": [], "length": [], "ids_crc32": []}
            for row, text in enumerate(batch.column("text").to_pylist()):
                ids = encoder.ids(text) + end
                for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append(row)
                    for name, x in zip(out, (piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])), strict=True):
                        out[name].append(x)
            arrays = {"piece": pa.array(out.pop("piece"), pa.int32())} | {k: pa.array(v, pa.int64()) for k, v in out.items()}
            yield pa.RecordBatch.from_pydict({"id": batch.column("id").take(pa.array(rows, pa.int64()))} | arrays)
        encoder.known.clear()  # workers outlive tasks, and other stages need their memory

    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return own.mapInArrow(encode, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that no packing of these lengths can do without, by two families of dual-feasible functions.

    For a threshold e up to half a bin: lengths over capacity - e count as a bin, lengths below e as nothing, others as
    they are. For k from 1: x (k + 1) / capacity rounded down, over k; exact multiples stay as they are.
    """
    count = np.bincount(lengths, minlength=capacity + 1)
    number = np.concatenate([[0], np.cumsum(count)])  # of lengths below an index
    total = np.concatenate([[0], np.cumsum(count * np.arange(capacity + 1))])
    e = np.arange(capacity // 2 + 1)
    large = number[-1] - number[capacity - e + 1]
    middle = total[capacity - e + 1] - total[e]
    best = int(np.max(large + -(-middle // capacity)))
    x = np.arange(capacity + 1)
    for k in range(1, 33):
        scaled = x * (k + 1)
        # in units of 1 / (k * capacity), so that sums are exact
        value = np.where(scaled % capacity == 0, x * k, scaled // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(bin, offset) of each length, and the room left in each bin. Each goes where it leaves the least room."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[int] = []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r: a bin has room r
    for item in order.tolist():
        length = int(lengths[item])
        fits = some >> length
        if fits:
            left = length + (fits & -fits).bit_length() - 1
            at = with_room[left].pop()
            if not with_room[left]:
                some &= ~(1 << left)
        else:
            at, left = len(room), capacity
            room.append(capacity)
        bins[item], offsets[item] = at, capacity - left
        room[at] = left - length
        with_room[left - length].append(at)
        some |= 1 << (left - length)
    return bins, offsets, room


def packed(items: DataFrame, number: int, parts: int, capacity: int) -> DataFrame:
    """One round: items with sequence_id, offset, certified and open (to be exchanged in the next round)."""

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("item")
        lengths = group.column("length").to_numpy()
        bins, offsets, room = best_fit_decreasing(lengths, capacity)
        certified = len(room) == lower_bound(lengths, capacity)
        gaps = sorted((b for b in range(len(room)) if room[b]), key=lambda b: (-room[b], b))
        opened = np.zeros(len(room), bool)
        opened[gaps[:2] if certified else gaps] = True
        part = group.column("part")[0].as_py()
        more = {"sequence_id": (number << 56 | part << 24) + bins, "offset": offsets, "certified": np.full(len(bins), certified), "open": opened[bins]}
        group = group.drop_columns("part")
        for name, values in more.items():
            group = group.append_column(name, pa.array(values))
        return group

    kind = items.schema["id"].dataType.simpleString()
    schema = f"item long, id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, certified boolean, open boolean"
    dealt = items.withColumn("part", F.pmod(F.xxhash64("item", F.lit(number)), F.lit(parts)))
    return dealt.groupBy("part").applyInArrow(pack, schema)


def pack_documents(docs: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset, certified): every piece's place in a sequence.

    A null or empty text is one piece with the end id alone. Null ids stay null; repeated rows are packed each by
    itself; other columns are ignored, whatever their names. An empty table gives an empty result. certified says that
    the sequence's partition met its lower bound. A partition holds a bounded number of pieces, whatever the input.
    """
    pieces = pieces_of(docs, capacity, id_col, text_col, tokenizer_path or public_tokenizers.path(DEFAULT_TOKENIZER))
    pool = written(pieces.select(F.monotonically_increasing_id().alias("item"), "*"))
    done: list[DataFrame] = []
    before = math.inf
    while True:
        tokens, rows = pool.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
        parts = max(1, math.ceil(tokens / (capacity * SEQUENCES_A_PART)), math.ceil(rows / PIECES_A_PART))
        result = written(packed(pool, len(done), parts, capacity))
        last = parts == 1 or parts > 0.8 * before  # nothing is left to exchange with, or rounds gain no more
        done.append(result if last else result.filter(~F.col("open")))
        if last:
            break
        pool, before = result.filter("open").select(pool.columns), parts
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("item", "open").withColumnRenamed("id", id_col)
