"""Document fingerprints: a Merkle tree over paragraphs and sections, with marks of each paragraph's runs.

Lines are paragraphs, the leaves of the tree; their digests are hashes of their texts. A section ends before a blank line
or a heading, and after a paragraph whose digest ends in three zero bits, so that text without any of these has sections
too and an edit moves no other section. Digests of sections and of the root are hashes of their parts' digests; each
level has a sign of its own in front. So equal roots mean equal texts, as surely as the hash keeps texts apart.

Below a paragraph are runs of characters, by which likeness sees edits inside of a paragraph. Runs of level j end where
a hash of the last four characters has j zero bits, after 2 ** j characters on average, and at the paragraph's end. A
text is marked from the level of about AIM runs on up to the highest one. Two texts are compared at the two levels next
to the longer one's, which both are marked at, and each counts by its nearness: whatever the lengths, likeness changes
little where a length does.

A fingerprint is root:characters:sections, with sections apart by semicolons. A section is its digest, a slash, and its
paragraphs apart by commas; a paragraph is its digest and, of each level at which it has several runs, a mark for each.
Higher levels have fewer runs, so that these marks cost little.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlpit.llm.common import text_or_empty

#: Runs that a text has about, the highest level, and how many times the average a run's length may be.
AIM, HIGHEST, LONGEST = 44, 7, 2
#: Letters, of six bits each, and how many of them a digest of a paragraph or section has in a fingerprint.
DIGEST = 4
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
ODD = np.uint64(0x9E3779B97F4A7C15)
POWERS_KEPT = 1 << 18
#: Rows that are sorted and compared in one range of ids, and most ranges, about.
RANGE_ROWS, RANGES_MOST = 2_000, 16_384


def made_powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """ODD to the powers from 1 on, and to those from 0 on downwards, modulo 2 ** 64."""
    back = np.full(size, pow(int(ODD), -1, 1 << 64), np.uint64)
    back[0] = 1
    return np.cumprod(np.full(size, ODD, np.uint64)), np.cumprod(back)


@lru_cache(maxsize=1)
def kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return made_powers(POWERS_KEPT)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n of them; a worker keeps those that all but the longest texts need."""
    return kept_powers() if n <= POWERS_KEPT else made_powers(n)


def cut_long(stops: np.ndarray, longest: int) -> np.ndarray:
    """Ends of runs, of which none is longer than that."""
    sizes = stops.copy()
    sizes[1:] -= stops[:-1]
    long = np.flatnonzero(sizes > longest)
    if not len(long):
        return stops
    number = (sizes[long] - 1) // longest
    before = np.cumsum(number) - number
    within = np.arange(1, before[-1] + number[-1] + 1)
    stops = np.concatenate([stops, np.repeat(stops[long] - sizes[long] - before * longest, number) + within * longest])
    stops.sort()
    return stops


def digest(parts: bytes) -> bytes:
    return hashlib.blake2b(parts, digest_size=16).digest()


def levels(n: int) -> dict[int, float]:
    """The levels at which a text of n characters is compared with shorter ones, with their shares of the likeness."""
    at = min(max(math.log2((n + 1) / AIM), 0.0), float(HIGHEST))
    low = int(at)
    return {low: 1 - at + low} | ({low + 1: at - low} if at > low else {})


def marked(n: int) -> range:
    """The levels at which a text of n characters is marked: its own and all that longer texts have."""
    return range(min(levels(n)), HIGHEST + 1)


def letters(n: int) -> int:
    """Letters of a mark: so many that an eightieth of a text's runs, about, are like another run by chance."""
    return min(DIGEST, math.ceil(math.log(80 * max(AIM, n >> HIGHEST), len(LETTERS))))


def spelled(marks: np.ndarray, width: int) -> str:
    """Marks as letters, so many each."""
    codes = np.frombuffer(LETTERS.encode(), np.uint8)
    return codes[marks[:, None] >> np.arange(6 * width - 6, -1, -6, np.uint32) & np.uint32(63)].tobytes().decode()


def names_of(digests: list[bytes]) -> np.ndarray:
    """The first bits of digests, as many as they have in a fingerprint."""
    return np.frombuffer(b"".join(x[:4] for x in digests), ">u4").astype(np.uint32) >> np.uint32(32 - 6 * DIGEST)


def number_of(mark: str) -> int:
    found = 0
    for letter in mark:
        found = found << 6 | LETTERS.index(letter)
    return found


def signs(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each character and the three before it in its paragraph."""
    own = codes * np.uint32(0x9E3779B1)
    found = own.copy()
    for k, factor in ((1, 0x85EBCA6B), (2, 0xC2B2AE35), (3, 0x27D4EB2F)):
        before = np.zeros_like(own)
        before[k:] = own[:-k]
        starts = ends[:-1] + 1
        for first in range(k):
            before[np.minimum(starts + first, len(own) - 1)] = 0
        found += before * np.uint32(factor)
    found ^= found >> np.uint32(15)
    found *= np.uint32(0x2C1B3C6D)
    return found ^ (found >> np.uint32(13))


class Tree:
    """The tree of one text. paragraphs: digests; sections: (digest, first paragraph, end); marks: numbers by level."""

    def __init__(self, text: str):
        self.n, self.bits = len(text), 6 * letters(len(text))
        self.paragraphs = [digest(b"\0" + line.encode()) for line in text.split("\n")]
        starts = [0]
        for k, line in enumerate(text.split("\n")):
            if k and (not line or line[0] == "#" or self.paragraphs[k - 1][-1] & 7 == 0):
                starts.append(k)
        self.sections = [(digest(b"\1" + b"".join(self.paragraphs[a:b])), a, b) for a, b in zip(starts, [*starts[1:], len(self.paragraphs)], strict=True)]
        self.root = digest(b"\2" + b"".join(name for name, *_ in self.sections))
        codes = np.frombuffer((text + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.flatnonzero(codes == 10)
        names = names_of(self.paragraphs) >> np.uint32(6 * DIGEST - self.bits)
        mixed = (codes + np.uint64(1)) * ODD
        mixed ^= mixed >> np.uint64(29)
        mixed[ends] = 0  # of no weight: a run at a paragraph's end is marked like one inside
        signed = signs(codes, ends)
        up, down = powers(len(codes))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * up[: len(codes)])])  # a run's hash is a difference of two
        self.marks: dict[int, np.ndarray] = {}
        self.borders: dict[int, np.ndarray] = {}  # of paragraphs, as numbers of runs
        for level in marked(self.n):
            last = (signed & np.uint32((1 << level) - 1)) == 0
            last[np.maximum(ends - 1, 0)] = False  # a paragraph's end alone is no run
            last[ends] = True
            stops = cut_long(np.flatnonzero(last) + 1, LONGEST << level)
            starts = np.concatenate([[0], stops[:-1]])
            runs = (sums[stops] - sums[starts]) * down[starts]
            marks = ((runs ^ (runs >> np.uint64(32))) * ODD >> np.uint64(64 - self.bits)).astype(np.uint32)
            borders = np.concatenate([[0], np.searchsorted(stops, ends + 1) + 1])
            alone = borders[1:] - borders[:-1] == 1
            marks[borders[:-1][alone]] = names[alone]  # the paragraph's digest is the mark of its only run
            self.marks[level], self.borders[level] = marks, borders

    def fingerprint(self) -> str:
        width, names = self.bits // 6, []
        kept = [(spelled(self.marks[k], width), self.borders[k].tolist()) for k in self.marks]
        own, sections = spelled(names_of(self.paragraphs), DIGEST), spelled(names_of([x[0] for x in self.sections]), DIGEST)
        for p in range(len(self.paragraphs)):
            runs = [marks[width * at[p] : width * at[p + 1]] for marks, at in kept if at[p + 1] - at[p] > 1]
            names.append("=".join([own[DIGEST * p : DIGEST * p + DIGEST], *runs]))
        return f"{self.root.hex()}:{self.n}:" + ";".join(f"{sections[DIGEST * k : DIGEST * k + DIGEST]}/{','.join(names[a:b])}" for k, (_, a, b) in enumerate(self.sections))


def equal_share(a: np.ndarray, b: np.ndarray) -> float:
    """Twice the marks that both hold, as often as both hold them, over the marks of both."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return 2.0 * float(np.minimum(n[i], m[j]).sum()) / (len(a) + len(b))


def alike(n: int, m: int, one: dict[int, np.ndarray], other: dict[int, np.ndarray]) -> float:
    """The mean share of equal marks, of the letters that both have, over the levels of the longer of two texts of n and
    of m characters."""
    less = min(letters(n), letters(m))
    shares = (w * equal_share(one[k] >> 6 * (letters(n) - less), other[k] >> 6 * (letters(m) - less)) for k, w in levels(max(n, m)).items())
    return sum(shares)


def tree_likeness(one: Tree, other: Tree) -> float:
    return 1.0 if one.root == other.root else alike(one.n, other.n, one.marks, other.marks)


def parsed(fingerprint: str) -> tuple[str, int, list[tuple[str, list[list[str]]]]]:
    """The root, the number of characters, and of each section its digest and its paragraphs as digest and marks."""
    root, n, body = fingerprint.split(":")
    sections = [x.partition("/") for x in body.split(";")]
    return root, int(n), [(name, [p.split("=") for p in paragraphs.split(",")]) for name, _, paragraphs in sections]


def marks_of(paragraphs: list[list[str]], n: int) -> dict[int, np.ndarray]:
    """The marks of a fingerprint by level."""
    width, out = letters(n), {}
    for place, level in enumerate(marked(n), 1):
        found = "".join(p[place] if len(p) > place else p[0][:width] for p in paragraphs)
        out[level] = np.array([number_of(found[k : k + width]) for k in range(0, len(found), width)])
    return out


def likeness(one: str, other: str) -> float:
    """How alike two fingerprints are, from 0 to 1: the share of equal marks, 1 for equal roots."""
    (root, n, a), (other_root, m, b) = parsed(one), parsed(other)
    if root == other_root:
        return 1.0
    a, b = ([p for _, section in x for p in section] for x in (a, b))
    return alike(n, m, marks_of(a, n), marks_of(b, m))


def unmatched(own: list, other: list) -> list[int]:
    """Places of what other doesn't hold as often."""
    left, found = Counter(other), []
    for k, x in enumerate(own):
        if left[x] > 0:
            left[x] -= 1
        else:
            found.append(k)
    return found


def differing(own: list[tuple[object, list]], other: list[tuple[object, list]]) -> list[tuple[int, int]]:
    """(section, paragraph) of what the other tree doesn't hold: sections with a partner are passed over on both sides,
    and only the other ones' paragraphs are compared."""
    one, two = [name for name, _ in own], [name for name, _ in other]
    mine, theirs = unmatched(one, two), unmatched(two, one)
    places = [(s, p) for s in mine for p in range(len(own[s][1]))]
    odd = unmatched([own[s][1][p] for s, p in places], [x for s in theirs for x in other[s][1]])
    return [places[k] for k in odd]


def edits(one: str, other: str) -> list[tuple[int, int]]:
    """(section, paragraph) of each paragraph of one fingerprint, counted from 0, that the other doesn't hold."""
    (root, _, a), (other_root, _, b) = parsed(one), parsed(other)
    if root == other_root:
        return []
    return differing(*([(name, [p[0] for p in section]) for name, section in x] for x in (a, b)))


def number_of_edits(tree: Tree, edited: Tree) -> int:
    if tree.root == edited.root:
        return 0
    return len(differing(*([(name, x.paragraphs[a:b]) for name, a, b in x.sections] for x in (edited, tree))))


def held(values: list[int]) -> Column:
    """A constant array; as text it stays short in plans."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def range_of(column: str, bounds: list[int]) -> Column:
    """How many of the sorted bounds a number reaches, by two linear searches of about the root of their number."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    coarse = F.size(F.filter(held(bounds[::step]), lambda b: b <= F.col(column)))
    first = F.greatest(coarse - 1, F.lit(0)) * step
    fine = F.size(F.filter(F.slice(held(bounds), first + 1, F.lit(step)), lambda b: b <= F.col(column)))
    return F.when(F.col(column).isNull(), 0).otherwise(first + fine)


def place_of(rows: int, nulls: int, cuts: list[int], ranges: int) -> tuple[Column, int]:
    """The number of a row's range, in the order of rows, by id and key, and how many ranges there are.

    cuts are quantiles of ids. An id that is several of them is hot: it has as many ranges to itself, and one more, by
    the key. So have null ids, by their number.
    """
    hot = {x: n + 1 for x, n in Counter(cuts).items() if n > 1}
    bounds = sorted({*cuts, *(x + 1 for x in hot)})
    parts = [1] + [hot.get(x, 1) for x in bounds]
    starts = [sum(parts[k + 1 :]) for k in range(len(parts))]
    of_null = max(1, math.ceil(nulls * ranges / max(rows, 1)))
    share = F.col("key").cast("double") / float(2**64) + 0.5

    def spread(start: Column, number: Column) -> Column:
        return (start + F.least(F.floor(share * number), number - 1)).cast("long")

    at = range_of("id", bounds) + 1
    known = spread(F.element_at(held(starts), at), F.element_at(held(parts), at))
    return F.when(F.col("id").isNull(), spread(F.lit(sum(parts)), F.lit(of_null))).otherwise(known), sum(parts) + of_null


def with_next(docs: DataFrame) -> DataFrame:
    """Of (id, text): rows in ranges of the order, each range followed by the first row of the next one (edge).

    The order is by falling id, then by a hash of the text, then by the text. The result is dealt out by range and
    sorted, so that in each task a row's next document is the next row.
    """
    rows, known = docs.agg(F.count("*"), F.count("id")).first()
    ranges = min(RANGES_MOST, max(1, math.ceil(rows / RANGE_ROWS)))
    shares = [k / ranges for k in range(1, ranges)]
    cuts = docs.agg(F.percentile_approx(F.col("id").cast("long"), shares, 4 * ranges)).first()[0] if shares and known else []
    place, number = place_of(rows, rows - known, cuts, ranges)
    dealt = docs.withColumn("key", F.xxhash64("text")).withColumn("range", place).withColumn("edge", F.lit(0))
    tops = dealt.groupBy("range").agg(F.max(F.struct("id", F.bitwise_not("key").alias("key"))).alias("top"))  # a row for each range
    around = Window.orderBy("range")
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = tops.select(F.col("range").alias("its"), F.col("top.id").alias("top_id"), F.bitwise_not("top.key").alias("top_key"), F.coalesce(F.lag("range").over(around), F.last("range").over(whole)).alias("goal"))
    first = (F.col("range") == F.col("its")) & F.col("id").eqNullSafe(F.col("top_id")) & (F.col("key") == F.col("top_key"))
    edges = dealt.join(F.broadcast(tops), first).groupBy("goal").agg(F.min("text").alias("text"))
    edges = edges.select(F.lit(None).cast(docs.schema["id"].dataType).alias("id"), "text", F.lit(None).cast("long").alias("key"), F.col("goal").alias("range"), F.lit(1).alias("edge"))
    return dealt.unionByName(edges).repartitionById(number, F.col("range").cast("int")).sortWithinPartitions("range", "edge", F.col("id").desc_nulls_last(), "key", "text")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_edits).

    Each text is compared with itself after an edit, its last third replaced by the beginning of the next document, and
    with that document. Order is by falling id, then by a hash of the text, null ids last; after the last comes the
    first. n_edits is the number of paragraphs of the edited text that the text doesn't hold. A null text counts as
    empty: one empty paragraph. Repeated rows follow each other, each with a row of its own; other columns are ignored,
    whatever their names. An empty table gives an empty result; a single row is its own next one. Ids must be integers.
    Memory is bounded by a batch of rows and the longest text. An id that a third of all rows have, or null, is split.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waits: tuple | None = None  # id, text and tree of the row that awaits its next one
        for batch in batches:
            out: dict[str, list] = {name: [] for name in ("id", *kinds)}
            for i, text, edge in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), batch.column("edge").to_pylist(), strict=True):
                tree = Tree(text)
                if waits:
                    held_id, own, own_tree = waits
                    part = len(own) // 3
                    edited = own[: len(own) - part] + text[:part]
                    edited_tree = Tree(edited) if edited != own else own_tree
                    near = [tree_likeness(own_tree, x) for x in (edited_tree, tree)]
                    row = (held_id, len(own), hashlib.sha256(edited.encode()).hexdigest(), own_tree.fingerprint(), edited_tree.fingerprint(), *near, number_of_edits(own_tree, edited_tree))
                    for column, x in zip(out.values(), row, strict=True):
                        column.append(x)
                waits = None if edge else (i, text, tree)
            if out["id"]:
                yield pa.RecordBatch.from_arrays([pa.array(out["id"], batch.schema.field("id").type), *[pa.array(out[k], t) for k, t in kinds.items()]], names=list(out))

    kinds = {"n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64(), "n_edits": pa.int64()}
    own = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_edits long"
    return with_next(own).select("id", "text", "edge").mapInArrow(run, schema).withColumnRenamed("id", id_col)
