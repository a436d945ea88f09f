"""MinHash near-duplicates with sequential Bayesian verification.

A document's set holds its distinct shingles. Documents with equal sets form a class, and classes are compared. Each
class has a MinHash signature; classes that agree in a band of it share a bucket. Comparing goes through a signature
batch by batch: with m of n values equal, and any similarity as likely as another beforehand, the posterior chance of a
similarity of the threshold or more is that of at most m hits in n + 1 draws at the threshold. A pair whose chance falls
below the miss probability is dropped. Survivors are verified on their whole sets. Links make components.

A bucket's pairs aren't all formed, as a bucket may hold a third of all classes. Three rounds look at them:

1. Each class of a bucket is compared with the bucket's first class. Buckets that then hold one component are done.
2. Classes of the other buckets, the open ones, order their shingles from the rarest among them. Sets as alike as the
   threshold share a shingle within the first few of either (a prefix, an exact bound), and these few are rare. Each
   class is compared with one pivot of each such shingle: the class with the fewest rarer shingles, which the copies of
   one original are most alike to.
3. Of what is left, pairs of different components share a prefix shingle, and sizes and places in the two orders leave
   room for enough common shingles. Summaries by shingle and size say first which classes can have a partner at all, so
   that pairs are formed of these alone. A shingle that would still form many pairs, such as one of a template's pages,
   forms none: its classes meet in cells, each a pair of blocks of bounded bytes, where signatures and sets are compared
   in place and components grow as links are found. Only links leave a cell.

Rows are linear in the classes' places in rounds 1 and 2, and pairs in round 3 too. No pair at the threshold that shares
a bucket is left out: a pair that no round looks at either lies in one component by then or can't reach the threshold.

With 32 bands of 4 values two sets at the threshold of 0.8 meet in no bucket with a chance of 5e-8.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlpit.llm.common import discard, in_pieces, text_or_empty, written

BANDS, BAND_ROWS = 32, 4
VALUES = BANDS * BAND_ROWS
#: Values of a signature that are compared at once, and the chance at which a pair is dropped.
BATCH, MISS = 16, 1e-6
#: Most rows of classes' names, of buckets or of a shingle's summaries that are broadcast, of 60 bytes at most each.
BROADCAST_ROWS = 200_000
#: Sizes of one bin of the third round differ by this factor at most.
BIN = 1.05
#: A shingle forms pairs of its classes up to so many for each of them.
PAIRS_EACH = 16
#: Bytes of sets and signatures of one block of a cell, about.
BLOCK_BYTES = 4 << 20
WORDS_KEPT = 200_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    """64-bit hashes of words; beyond a number of words it starts anew."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS_KEPT:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


@lru_cache(maxsize=1)
def word_hashes() -> Hashes:
    return Hashes()


@lru_cache(maxsize=1)
def permutations() -> tuple[np.ndarray, np.ndarray]:
    drawn = np.random.default_rng(20240229).integers(0, 2**63, (2, VALUES), np.uint64)
    return drawn[0] * np.uint64(2) + np.uint64(1), drawn[1]


def shingles(text: str, width: int) -> np.ndarray:
    """The set of a text as sorted 64-bit hashes of its runs of words, A to Z in lower case; of all words if fewer."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space separates
    hashes = np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words))
    if not words:
        return hashes
    run = min(width, len(words))
    found = np.full(len(words) - run + 1, run, np.uint64)
    for k in range(run):
        found = (found ^ (found >> np.uint64(32))) * MULTIPLIER + hashes[k : len(words) - run + 1 + k]
    return np.unique((found ^ (found >> np.uint64(29))) * MULTIPLIER)


def signature(members: np.ndarray) -> np.ndarray:
    a, b = permutations()
    least = np.full(VALUES, 2**32 - 1, np.uint32)
    for k in range(0, len(members), 2048):
        mixed = (members[k : k + 2048, None] * a + b) >> np.uint64(32)
        least = np.minimum(least, mixed.min(0).astype(np.uint32))
    return least


def least_hits(threshold: float, miss: float = MISS) -> list[int]:
    """For each number of compared batches the fewest equal values with which a pair goes on."""
    found = []
    for n in range(BATCH, VALUES + 1, BATCH):
        chance, m = 0.0, -1
        while chance < miss:
            m += 1
            chance += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        found.append(m)
    return found


def going_on(left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Of rows of signatures, compared row by row, the indices of those that pass every batch."""
    at, hits = np.arange(len(left)), np.zeros(len(left), np.int64)
    for k, least in enumerate(least_hits(threshold)):
        part = slice(k * BATCH, (k + 1) * BATCH)
        hits = hits + (left[at, part] == right[at, part]).sum(1)
        at, hits = at[hits >= least], hits[hits >= least]
    return at


def signatures(batch: list) -> np.ndarray:
    return np.frombuffer(b"".join(batch), np.uint32).reshape(-1, VALUES)


def described(docs: DataFrame, width: int) -> DataFrame:
    """(id, text_key, n_shingles, set_key, signature) of (id, text_key, text); set_key is null for empty sets."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            sets = [shingles(text, width) for text in batch.column("text").to_pylist()]
            columns = {
                "id": batch.column("id"),
                "text_key": batch.column("text_key"),
                "n_shingles": pa.array([len(x) for x in sets], pa.int64()),
                "set_key": pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets], pa.binary()),
                "signature": pa.array([signature(x).tobytes() if len(x) else None for x in sets], pa.binary()),
            }
            yield pa.RecordBatch.from_pydict(columns)
        word_hashes().clear()  # workers outlive tasks, and other stages need their memory

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(describe, f"id {kind}, text_key long, n_shingles long, set_key binary, signature binary")


def survivors(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (a, b) of classes those that no batch of their signatures rules out."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = going_on(signatures(batch.column("sa").to_pylist()), signatures(batch.column("sb").to_pylist()), threshold)
                yield batch.select(["a", "b"]).take(pa.array(at))

    one = classes.select(F.col("k").alias("a"), F.col("signature").alias("sa"))
    other = classes.select(F.col("k").alias("b"), F.col("signature").alias("sb"))
    return pairs.join(one, "a").join(other, "b").select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long")


def broadcast_if_small(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast up to a number of rows; beyond it Spark deals out both sides of the join."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def class_sets(wanted: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(k, members): the whole sets of classes (k), from texts that are read anew.

    A class names one of its documents by id and hash of the text, so that a document meets one class at most, whatever
    ids are null or repeated. The names are broadcast up to a number; beyond it the join deals out the texts.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            found = [shingles(text, width) for text in batch.column("text").to_pylist()]
            own = [k for k, (x, key) in enumerate(zip(found, batch.column("set_key").to_pylist(), strict=True)) if xxhash.xxh3_128_digest(x.tobytes()) == key]
            yield pa.RecordBatch.from_pydict({"k": batch.column("k").take(pa.array(own, pa.int64())), "members": pa.array([found[k].tobytes() for k in own], pa.binary())})
        word_hashes().clear()

    keys = written(wanted.distinct().join(classes, "k").select("k", "set_key", "named"))
    texts = docs.join(broadcast_if_small(keys), (docs["text_key"] == keys["named"]["text_key"]) & docs["id"].eqNullSafe(keys["named"]["id"]))
    return written(texts.select("k", "set_key", "text").mapInArrow(sets, "k long, members binary").dropDuplicates(["k"]))


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("k"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links: pairs whose whole sets have percent / 100 or more of their union in common."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            linked = []
            for x, y in zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist(), strict=True):
                one, other = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(one, other, assume_unique=True))
                linked.append(100 * common >= percent * (len(one) + len(other) - common))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    one = sets.select(F.col("k").alias("a"), F.col("members").alias("xa"))
    other = sets.select(F.col("k").alias("b"), F.col("members").alias("xb"))
    return pairs.join(one, "a").join(other, "b").select("a", "b", "xa", "xb").mapInArrow(confirm, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(k, component) of every linked class, the component being its smallest class.

    Each pass takes the smallest label among neighbours and then the label of that label, so that lengths of paths
    halve; it ends when no label changes.
    """
    both = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    known = written(both.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("b")).select("k", F.least("k", "b").alias("component")))
    while True:
        labels = known.select("k", "component")
        near = both.join(labels, both["b"] == labels["k"]).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels["k"] == near["a"]).select("k", F.col("component").alias("was"), F.least("component", "near").alias("at"))
        jump = lower.select(F.col("k").alias("at"), F.col("at").alias("component"))
        before, known = known, written(lower.join(jump, "at").select("k", "was", "component"))
        discard(before)
        if not known.filter("component <> was").limit(1).count():
            discard(both)
            return known.select("k", "component")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with a class (k) and its component, itself where it has no link."""
    return rows.join(labels, "k", "left").withColumn("component", F.coalesce("component", "k"))


def joined_up(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links: these join components, of which only the linked ones are looked at."""
    found = links.select(F.col("a").alias("k"), F.col("b").alias("other"))
    found = labelled(found, labels).select(F.col("component").alias("a"), F.col("other").alias("k"))
    edges = written(labelled(found, labels).select("a", F.col("component").alias("b")).filter("a <> b").distinct())
    found = components(edges).select(F.col("k").alias("at"), F.col("component").alias("to"))
    classes = labels.unionByName(ends(edges).distinct().join(labels, "k", "left_anti").withColumn("component", F.col("k")))
    return written(classes.join(found, classes["component"] == found["at"], "left").select("k", F.coalesce("to", "component").alias("component")))


def pair(one: str, other: str) -> list[Column]:
    return [F.least(one, other).alias("a"), F.greatest(one, other).alias("b")]


def shared_at_least(percent: int, n: Column | int) -> Column:
    """The least number of common shingles of two linked sets with n shingles in all, counting common ones twice."""
    return F.ceil(percent * n / F.lit(100 + percent))


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(k, shingle, n, at): the first shingles of each open class, by rarity among open classes, with their places.

    A linked set has percent / 100 of its shingles or more in common with the other, so that the first common one stands
    before the rest. Shingles of one class alone are counted, not listed.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, members in zip(batch.column("k").to_pylist(), batch.column("members").to_pylist(), strict=True):
                found = np.frombuffer(members, np.int64)
                yield pa.RecordBatch.from_pydict({"k": np.full(len(found), k), "n": np.full(len(found), len(found)), "shingle": found})

    rows = sets.mapInArrow(each, "k long, n long, shingle long")
    common = rows.groupBy("shingle").agg(F.count("*").alias("classes")).filter("classes > 1")
    own = Window.partitionBy("k")
    place = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("classes", "shingle")) - 1
    placed = rows.join(common, "shingle").withColumn("at", place)
    return placed.filter(F.col("at") <= F.col("n") - F.ceil(percent * F.col("n") / F.lit(100))).select("k", "shingle", "n", "at")


def pivot_pairs(places: DataFrame, percent: int) -> DataFrame:
    """Pairs of a class with its shingles' pivots, of different components, that may reach the threshold if nothing rarer
    is common. Others are left to the third round."""
    pivots = places.groupBy("shingle").agg(F.min(F.struct("at", "n", "k", "component")).alias("pivot"), F.min("component").alias("low"), F.max("component").alias("high"))
    pivots = written(pivots.filter("low < high"))
    met = places.join(broadcast_if_small(pivots), "shingle").filter("component <> pivot.component")
    rest = F.least(F.col("n") - F.col("at"), F.col("pivot.n") - F.col("pivot.at"))
    return met.filter(rest >= shared_at_least(percent, F.col("n") + F.col("pivot.n"))).select(*pair("k", "pivot.k")).distinct()


def open_places(places: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Places of larger and of smaller sets that may be parts of a pair of different components, by shingle and bin of sizes.

    The larger set of a pair has the shared shingle in its prefix, the smaller one in the beginning of it. Both have
    enough shingles from there on. Places of larger sets meet, by shingle and bin, a summary of the smaller ones first,
    and those the summary of the larger ones that are left.
    """
    size_bin = lambda n: F.floor(F.log(n) / F.log(F.lit(BIN)))
    n, rest = F.col("n"), F.col("n") - F.col("at")
    small = places.filter(F.col("at") <= n - shared_at_least(percent, 2 * n)).select("shingle", size_bin(n).alias("bin"), "k", "component", "n", rest.alias("rest"))
    most = F.least(n, F.floor((100 + percent) * rest / F.lit(percent)) - n)  # shingles of a smaller set, by the place
    least = F.ceil(percent * n / F.lit(100))
    large = places.withColumn("most", most).withColumn("least", least).filter("least <= most")
    large = large.select("shingle", F.explode(F.sequence(size_bin(F.col("least")), size_bin(F.col("most")))).alias("bin"), F.col("k").alias("k2"), F.col("component").alias("component2"), F.col("n").alias("n2"), rest.alias("rest2"), "least", "most")
    other = lambda c: (F.col("low") != F.col(c)) | (F.col("high") != F.col(c))

    known = written(small.groupBy("shingle", "bin").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("n").alias("from"), F.max("n").alias("to"), F.max("rest").alias("rest")))
    reach = F.greatest("from", "least")
    large = large.join(broadcast_if_small(known), ["shingle", "bin"]).filter(other("component2") & (reach <= F.least("to", "most")) & enough("rest", "rest2", F.col("n2") + reach, percent))
    large = written(large.drop("low", "high", "from", "to", "rest"))
    known = written(large.groupBy("shingle", "bin").agg(F.min("component2").alias("low"), F.max("component2").alias("high"), F.min("least").alias("from"), F.max("most").alias("to"), F.max("rest2").alias("rest2")))
    small = small.join(broadcast_if_small(known), ["shingle", "bin"]).filter(other("component") & n.between(F.col("from"), F.col("to")) & enough("rest", "rest2", 2 * n, percent))
    return large, written(small.drop("low", "high", "from", "to", "rest2"))


def enough(a: str, b: str, n: Column, percent: int) -> Column:
    return F.least(a, b) >= shared_at_least(percent, n)


def crowded(large: DataFrame, small: DataFrame) -> DataFrame | None:
    """(shingle, bin, crowd): those that would form many pairs, with the crowd that their classes meet in; None if none.

    A crowd is one of these or, where that is less work, all that are linked by common classes: then a class that is in
    many of them meets the others once.
    """
    of = ["shingle", "bin"]
    amounts = large.groupBy(*of).agg(F.count("*").alias("a")).join(small.groupBy(*of).agg(F.count("*").alias("b")), of)
    many = amounts.filter(F.col("a") * F.col("b") > PAIRS_EACH * (F.col("a") + F.col("b"))).select(*of, F.xxhash64(*of).alias("own"))
    many = written(many)
    if not many.limit(1).count():
        return None
    members = written(large.select(*of, F.col("k2").alias("k")).unionByName(small.select(*of, "k")).join(broadcast_if_small(many), of).select("own", "k").distinct())
    firsts = members.groupBy("own").agg(F.min("k").alias("a"))
    families = components(written(members.join(firsts, "own").filter("k <> a").select("a", F.col("k").alias("b")).distinct()))
    placed = written(members.join(families, "k").withColumnRenamed("component", "family"))
    alone = placed.groupBy("family", "own").agg(F.count("*").cast("double").alias("n")).groupBy("family").agg(F.sum(F.col("n") * F.col("n")).alias("alone"))
    together = placed.select("family", "k").distinct().groupBy("family").agg(F.count("*").cast("double").alias("n")).select("family", (F.col("n") * F.col("n")).alias("together"))
    chosen = placed.select("own", "family").distinct().join(alone, "family").join(together, "family")
    crowd = F.when(F.col("together") <= F.col("alone"), F.xxhash64("family")).otherwise(F.col("own"))
    return written(many.join(chosen.select("own", crowd.alias("crowd")), "own").drop("own"))


def open_pairs(large: DataFrame, small: DataFrame, crowds: DataFrame | None, percent: int) -> DataFrame:
    """Pairs of different components that share a shingle of their prefixes and may reach the threshold, but for crowds'."""
    few = [x.join(broadcast_if_small(crowds), ["shingle", "bin"], "left_anti") if crowds is not None else x for x in (large, small)]
    n = F.col("n")
    met = few[0].join(few[1], ["shingle", "bin"]).filter((F.col("component") != F.col("component2")) & n.between(F.col("least"), F.col("most")) & enough("rest", "rest2", n + F.col("n2"), percent))
    return met.select(*pair("k", "k2")).distinct()


def crowd_links(large: DataFrame, small: DataFrame, crowds: DataFrame, opened: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the components of a crowd's classes, one at least for each two that have one.

    A crowd's classes are dealt to blocks by a hash, as many as their bytes ask for, and each two blocks, or one with
    itself, make a cell.
    """
    of = ["shingle", "bin"]
    met = large.select(*of, F.col("k2").alias("k")).unionByName(small.select(*of, "k")).join(broadcast_if_small(crowds), of).select("crowd", "k").distinct()
    rows = labelled(met.join(opened.select("k", "signature"), "k").join(sets, "k"), labels)
    rows = written(rows)
    blocks = rows.groupBy("crowd").agg(F.ceil(F.sum(F.length("members") + F.length("signature")) / F.lit(BLOCK_BYTES)).alias("blocks"))
    own = F.pmod(F.xxhash64("k"), F.col("blocks"))
    dealt = rows.join(blocks, "crowd").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = dealt.select("crowd", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "k", "component", "signature", "members")

    def compare(cell: pa.Table) -> pa.Table:
        cell = cell.sort_by("k")
        ks, block = cell.column("k").to_numpy(), cell.column("own").to_numpy()
        found = [np.frombuffer(x, np.uint64) for x in cell.column("members").to_pylist()]
        signed, label = signatures(cell.column("signature").to_pylist()), cell.column("component").to_numpy().copy()
        sizes = np.array([len(x) for x in found])
        i, j = cell.column("i")[0].as_py(), cell.column("j")[0].as_py()
        links = []
        for at in np.flatnonzero(block == i).tolist():
            open_ = (block == j) & (label != label[at]) & (100 * np.minimum(sizes, sizes[at]) >= percent * np.maximum(sizes, sizes[at]))
            if i == j:
                open_[: at + 1] = False
            others = np.flatnonzero(open_)
            others = others[going_on(np.broadcast_to(signed[at], (len(others), VALUES)), signed[others], percent / 100)]
            for b in others.tolist():
                if label[b] != label[at]:
                    common = len(np.intersect1d(found[at], found[b], assume_unique=True))
                    if 100 * common >= percent * (sizes[at] + sizes[b] - common):
                        links.append((min(ks[at], ks[b]), max(ks[at], ks[b])))
                        label[label == label[b]] = label[at]
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return cells.groupBy("crowd", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every document.

    Two documents are linked if their sets have percent / 100 or more of their union in common. component_id is the
    smallest id that links reach. A null or empty text, or one of white space alone, has an empty set and is linked with
    nothing, so it is kept. A class whose ids are all null has the component null; such rows count as kept. Repeated
    rows have equal results. Other columns are ignored, whatever their names. An empty table gives an empty result. Ids
    may be of any type that has an order. A hot group of copies is one class from the first aggregation on.
    """
    own = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("text_key", F.xxhash64("text"))
    rows = written(described(own, width))
    named = F.min(F.struct("id", "text_key")).alias("named")
    sets = rows.filter("set_key is not null").groupBy("set_key").agg(F.min("id").alias("cid"), named, F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles"))
    classes = written(sets.select(F.monotonically_increasing_id().alias("k"), "*"))

    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring("signature", b * BAND_ROWS * 4 + 1, F.lit(BAND_ROWS * 4))))
    banded = classes.select("k", F.explode(keys).alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min("k").alias("first")).filter("n > 1")
    buckets = written(banded.join(shared, "bucket"))
    stars = buckets.filter("k <> first").select(F.col("first").alias("a"), F.col("k").alias("b")).distinct()
    left = written(survivors(stars, classes, percent / 100))
    labels = components(written(verified(left, class_sets(ends(left), classes, own, width), percent)))

    wide = labelled(buckets.filter("n > 2"), labels)  # the one pair of two members has been compared
    mixed = written(wide.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("bucket"))
    opened = written(wide.join(broadcast_if_small(mixed), "bucket", "left_semi").select("k").distinct().join(classes, "k").select(*classes.columns))
    sets = class_sets(opened.select("k"), opened, own, width)
    places = written(prefixes(sets, percent))
    left = written(survivors(pivot_pairs(labelled(places, labels), percent), opened, percent / 100))
    labels = joined_up(labels, written(verified(left, sets, percent)))
    large, small = open_places(labelled(places, labels), percent)
    crowds = crowded(large, small)
    left = written(survivors(open_pairs(large, small, crowds, percent), opened, percent / 100))
    links = verified(left, sets, percent)
    if crowds is not None:
        links = links.unionByName(crowd_links(large, small, crowds, opened, labels, sets, percent))
    labels = joined_up(labels, written(links))

    joined = labelled(classes.select("k", "set_key", "cid"), labels)
    lowest = joined.groupBy("component").agg(F.min("cid").alias("component_id"))
    found = rows.select("id", "n_shingles", "set_key").join(joined.join(lowest, "component").select("set_key", "component_id"), "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return found.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id")).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, of which one of each component stays: that of the smallest id.

    Of rows with one id and text the one stays whose other columns have the smallest hash, whatever the order of the
    rows; of wholly equal rows one. Null ids count as smaller than all others. Documents without words all stay, apart
    from repeats of an id and text. Ids may be of any type that has an order, and columns may have any names.
    """
    more = F.struct(*[c for c in docs.columns if c not in (id_col, text_col)], F.lit(0).alias("always"))
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("text_key"), F.col(text_col).isNull().alias("none"))
    whole = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key"), F.xxhash64(F.to_json(more)).alias("rank"), text_or_empty(text_col).alias("text"))
    found = near_duplicates(whole.select(F.col("key").dropFields("none").alias("key"), "text"), width, percent, "key", "text")
    kept = found.filter("kept").select(F.col("key").alias("its")).distinct()
    same = lambda a, b: (a["text_key"] == b["text_key"]) & a["id"].eqNullSafe(b["id"])
    narrow = whole.select("key", "rank").join(kept, same(whole["key"], kept["its"])).groupBy("its", "rank", F.col("key.none").alias("none")).agg(F.count("*").alias("n"))
    chosen = written(narrow.groupBy("its").agg(F.min(F.struct("none", "rank", "n")).alias("first")))
    picked = whole.join(chosen, same(whole["key"], chosen["its"]) & (whole["rank"] == chosen["first"]["rank"]) & (whole["key"]["none"] == chosen["first"]["none"]))
    if not chosen.filter("first.n > 1").limit(1).count():
        return picked.select("row.*")
    repeated = picked.filter("first.n > 1").groupBy("its").agg(F.first("row").alias("row"))  # equal rows
    return picked.filter("first.n = 1").select("row").unionByName(repeated.select("row")).select("row.*")
