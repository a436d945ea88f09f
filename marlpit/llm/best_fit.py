"""Best-fit decreasing packing with a segment tree over the room in open windows.

Documents longer than a window are first cut into full windows; what is left of each is shorter than one. Such rests are
packed in blocks, longest first. A segment tree has a leaf for each amount of room and says of every range of amounts
whether a window with so much room is open, so that the window with the least room that is enough is found by a short
climb and descent.

Windows that are then neither full nor of a power of two would be padded. The emptiest of them give their pieces, cut
where needed, to fill the others. At most one is left in a block, and it becomes windows of powers of two, one for each
binary digit of its length. So nothing is padded at all.

A block holds a fixed number of windows' worth of ids of one input partition. There is no shuffle, memory is bounded by a
block, and a task that runs again packs the same blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlpit.llm.byte_bpe import byte_bpe
from marlpit.llm.common import in_pieces, text_or_empty
from marlpit.llm.packing import DEFAULT_TOKENIZER

#: Windows' worth of ids, and documents, that are packed together.
WINDOWS_A_BLOCK, DOCUMENTS_A_BLOCK = 4096, 65_536
END_ID = 1

#: A piece: the document's number in its block, the ids before it in the document, and its length.
Piece = tuple[int, int, int]


class Rooms:
    """Open windows by their room: a segment tree of flags over amounts of room, and a stack of windows at each leaf."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.some = [False] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        node = room + self.leaves
        while node and not self.some[node]:
            self.some[node] = True
            node >>= 1

    def tightest(self, length: int) -> int | None:
        """The least room of length or more that an open window has."""
        some, node = self.some, length + self.leaves
        while not some[node]:
            while node & 1:  # nothing lies to the right below this parent
                node >>= 1
                if not node:
                    return None
            node += 1  # the range to the right
            if node & (node - 1) == 0:  # of the next level: the right end was reached
                return None
        while node < self.leaves:
            node = 2 * node if some[2 * node] else 2 * node + 1
        return node - self.leaves

    def take(self, room: int) -> int:
        window = self.windows[room].pop()
        node = room + self.leaves
        if not self.windows[room]:
            self.some[node] = False
            while node > 1 and not self.some[node ^ 1]:
                node >>= 1
                self.some[node] = False
        return window


def best_fit_decreasing(pieces: list[Piece], capacity: int) -> list[list[Piece]]:
    """Windows of pieces, each put, longest first, where it leaves the least room."""
    rooms, windows = Rooms(capacity), []
    for piece in sorted(pieces, key=lambda p: -p[2]):
        room = rooms.tightest(piece[2])
        if room is None:
            room, at = capacity, len(windows)
            windows.append([piece])
        else:
            at = rooms.take(room)
            windows[at].append(piece)
        if room > piece[2]:
            rooms.put(room - piece[2], at)
    return windows


def in_powers(pieces: list[Piece]) -> list[list[Piece]]:
    """Windows of these pieces, in order, cut so that each has a power of two of ids, the largest first."""
    total, windows, left = sum(p[2] for p in pieces), [], pieces[::-1]
    for bit in reversed(range(total.bit_length())):
        room, window = total & 1 << bit, []
        while room:
            doc, start, length = left.pop()
            part = min(length, room)
            window.append((doc, start, part))
            room -= part
            if part < length:
                left.append((doc, start + part, length - part))
        if window:
            windows.append(window)
    return windows


def filled(windows: list[list[Piece]], capacity: int) -> list[list[Piece]]:
    """The windows without any that would be padded: the emptiest of those fill the fullest."""
    totals = [sum(p[2] for p in w) for w in windows]
    whole = [w for w, n in zip(windows, totals, strict=True) if n & (n - 1) == 0 or n == capacity]
    padded = sorted(((n, w) for w, n in zip(windows, totals, strict=True) if n & (n - 1) and n < capacity), key=lambda x: -x[0])
    first, last = 0, len(padded) - 1
    while first < last:
        total, window = padded[first]
        room = capacity - total
        donor = padded[last][1]
        while room and donor:
            doc, start, length = donor.pop()
            part = min(length, room)
            window.append((doc, start, part))
            room -= part
            if part < length:
                donor.append((doc, start + part, length - part))
        padded[first] = capacity - room, window
        first += not room
        last -= not donor
    done = [w for _, w in padded[:first]]
    rest = padded[first][1] if first == last else []
    return whole + done + in_powers(rest)


def pack(lengths: list[int], capacity: int) -> list[list[Piece]]:
    """Windows of the pieces of documents of these lengths: all full or of a power of two."""
    full, rests = [], []
    for doc, length in enumerate(lengths):
        rest = length % capacity
        full += [[(doc, start, capacity)] for start in range(0, length - rest, capacity)]
        if rest:
            rests.append((doc, length - rest, rest))
    return full + filled(best_fit_decreasing(rests, capacity), capacity)


def pack_windows(docs: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece of every document.

    A document is its ids and the end id; a null or empty text is the end id alone. No window is padded: each is full or
    has a power of two of ids. Null ids stay null; repeated rows are packed each by itself; other columns are ignored,
    whatever their names. An empty table gives an empty result. A text longer than a block is a block of its own.
    """
    path = tokenizer_path or public_tokenizers.path(DEFAULT_TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = byte_bpe(path), np.uint32(end_id).tobytes()
        names: list[pa.Array] = []  # ids of the block's documents
        held: list[bytes] = []
        size, sequence = 0, TaskContext.get().partitionId() << 40

        def block() -> Iterator[pa.RecordBatch]:
            nonlocal size, sequence
            rows, out = [], {name: [] for name in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
            for window in pack([len(x) // 4 for x in held], capacity):
                offset = 0
                for doc, start, length in window:
                    rows.append(doc)
                    crc = zlib.crc32(memoryview(held[doc])[4 * start : 4 * (start + length)])
                    for column, x in zip(out.values(), (start, length, crc, len(held[doc]) // 4, sequence, offset), strict=True):
                        column.append(x)
                    offset += length
                sequence += 1
            if rows:
                ids = pa.concat_arrays(names).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_pydict({"id": ids} | {k: pa.array(v, pa.int64()) for k, v in out.items()})
            names.clear()
            held.clear()
            size = 0

        for batch in in_pieces(batches):
            first = 0
            for row, text in enumerate(batch.column("text").to_pylist()):
                held.append(encoder.ids(text) + end)
                size += len(held[-1])
                if size >= 4 * capacity * WINDOWS_A_BLOCK or len(held) >= DOCUMENTS_A_BLOCK:
                    names.append(batch.column("id").slice(first, row + 1 - first))
                    first = row + 1
                    yield from block()
            names.append(batch.column("id").slice(first))
        yield from block()
        encoder.known.clear()  # workers outlive tasks, and other stages need their memory

    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return own.mapInArrow(run, schema).withColumnRenamed("id", id_col)
