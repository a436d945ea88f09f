"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations alone.

The ring has a fixed number of cells. Each shard owns virtual nodes at hashed cells, and a cell belongs to the first
node from it on, clockwise. A shard takes the rows of its cells, in ring order, up to its capacity. What overflows
goes on clockwise to the free room of shards that aren't full, room that each of those offers at its nodes in equal
parts. So a full shard's overflow spreads over all others instead of filling its neighbour to the brim, whose own rows
would be pushed on in turn; one more shard then moves fewer rows. Capacities add up to the number of rows and differ by one at most, so every shard ends exactly full.

Rows in overflow meet free room in ring order, first come, first served. Seen from the point of the ring where no row
is still under way, the k-th row in overflow takes the k-th free place, so two running sums decide it all. They run
over the table of cells, whose size is fixed; rows only need their rank within their cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlpit.llm.common import text_or_empty, written

#: Cells of the ring, and virtual nodes of a shard.
CELLS, NODES = 16_384, 64


def running(column: str, window) -> Column:
    """Sum of a column over the rows before this one."""
    return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def ring_nodes(spark, shards: int) -> DataFrame:
    """(node, shard, number, at): the virtual nodes, number counting a shard's nodes and at their cells."""
    nodes = spark.range(shards * NODES, numPartitions=1).select(
        F.col("id").alias("node"), (F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("number")
    )
    return nodes.withColumn("at", F.pmod(F.xxhash64(F.lit("node"), "shard", "number"), F.lit(CELLS)))


def ring_pieces(rows: DataFrame, shards: int) -> DataFrame:
    """(cell, from_rank, to_rank, shard, first_slot): where the rows of each cell go, by their rank in it.

    Of rows only the column cell is read. The result has at most two rows a cell and one a node.
    """
    spark = rows.sparkSession
    nodes = ring_nodes(spark, shards)
    loads = rows.groupBy("cell").agg(F.count("*").alias("n"))
    cells = spark.range(CELLS, numPartitions=1).withColumnRenamed("id", "cell").join(loads, "cell", "left").fillna(0, ["n"])
    cells = written(cells.coalesce(1))  # this and the tables below have a fixed size
    # the owner of a cell: the first node from it on, else the first node of all
    first = nodes.groupBy("at").agg(F.min_by("shard", "node").alias("shard"))
    back = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    owned = cells.join(first, F.col("cell") == F.col("at"), "left").select(
        "cell", "n", F.last("shard", ignorenulls=True).over(back).alias("owner")
    )
    lowest = first.agg(F.min_by("shard", "at").alias("wrap"))
    sizes = cells.agg(F.sum("n").alias("total"))
    owned = owned.join(F.broadcast(lowest)).join(F.broadcast(sizes)).select("cell", "n", "total", F.coalesce("owner", "wrap").alias("shard"))
    capacity = F.floor(F.col("total") / shards) + (F.col("shard") < F.col("total") % shards).cast("long")
    before = running("n", Window.partitionBy("shard").orderBy("cell"))
    home = owned.withColumn("kept", F.least("n", F.greatest(capacity - before, F.lit(0)))).withColumn("over", F.col("n") - F.col("kept"))
    home = written(home.coalesce(1))
    taken = home.groupBy("shard").agg(F.sum("kept").alias("taken"))
    free = nodes.join(taken, "shard", "left").join(F.broadcast(sizes)).withColumn("rest", capacity - F.coalesce("taken", F.lit(0)))
    free = free.withColumn("room", F.floor(F.col("rest") / NODES) + (F.col("number") < F.col("rest") % NODES).cast("long"))
    # overflow and room around the ring; in one cell overflow comes first
    none = F.lit(None)
    events = home.filter("over > 0").select(F.col("cell").alias("at"), F.lit(-1).cast("long").alias("node"), F.col("cell"), F.col("kept"), F.col("over").alias("amount"), none.cast("int").alias("shard"), F.lit(1).alias("sign")).unionByName(
        free.filter("room > 0").select("at", "node", none.cast("long").alias("cell"), none.cast("long").alias("kept"), F.col("room").alias("amount"), "shard", F.lit(-1).alias("sign"))
    )
    around = Window.orderBy("at", "node")
    under_way = written(events.withColumn("level", F.sum(F.col("amount") * F.col("sign")).over(around)).coalesce(1))
    start = under_way.agg(F.min_by(F.struct("at", "node"), F.struct("level", "at", "node")).alias("start"))
    turned = under_way.join(F.broadcast(start)).withColumn("lap", (F.struct("at", "node") <= F.col("start")).cast("int"))
    each = Window.partitionBy("sign").orderBy("lap", "at", "node")
    spans = written(turned.withColumn("lo", running("amount", each)).withColumn("hi", F.col("lo") + F.col("amount")).coalesce(1))
    # the borders of both kinds of spans cut the overflow into parts with one origin and one destination
    borders = spans.select(F.col("lo").alias("lo"), F.when(F.col("sign") == 1, F.struct("lo", "cell", "kept")).alias("origin"), F.when(F.col("sign") == -1, F.col("shard")).alias("goal"))
    borders = borders.groupBy("lo").agg(F.first("origin", True).alias("origin"), F.first("goal", True).alias("goal"))
    along = Window.orderBy("lo")
    filled = borders.select(
        "lo", F.lead("lo").over(along).alias("next"), F.last("origin", True).over(along).alias("origin"), F.last("goal", True).over(along).alias("shard")
    )
    total_over = spans.filter("sign = 1").agg(F.max("hi").alias("end"))
    moved = filled.join(F.broadcast(total_over)).select(
        F.col("origin.cell").alias("cell"),
        (F.col("origin.kept") + F.col("lo") - F.col("origin.lo")).alias("from_rank"),
        (F.col("origin.kept") + F.coalesce("next", "end") - F.col("origin.lo")).alias("to_rank"),
        "shard",
    )
    stay = home.filter("kept > 0").select("cell", F.lit(0).cast("long").alias("from_rank"), F.col("kept").alias("to_rank"), "shard")
    pieces = stay.unionByName(moved).withColumn("rows", F.col("to_rank") - F.col("from_rank"))
    return pieces.withColumn("first_slot", running("rows", Window.partitionBy("shard").orderBy("cell", "from_rank"))).drop("rows")


def shard_rows(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard): every row's shard and its place there.

    The law is `rows`: counts of shards differ by one at most. A row's place on the ring follows from its id, its
    text's CRC-32 and its size. A null text has size 8 and the checksum of an empty one; null ids are hashed like any
    id; repeated rows are placed each by itself; other columns are ignored, whatever their names. An empty table gives
    an empty result. A cell's rows are ranked in one task: about 1 / 16,384 of all, unless one whole row is repeated
    that often. grown_shard is null: only the law `key` has it.
    """
    text = text_or_empty(text_col)
    own = docs.select(F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"))
    own = own.withColumn("place", F.xxhash64("id", "text_crc32", "size"))
    rows = written(own.withColumn("cell", F.pmod(F.shiftright("place", 17), F.lit(CELLS))))
    pieces = written(ring_pieces(rows, shards).coalesce(1))  # read by each task: 2 * CELLS + shards * NODES rows at most
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("place", "id", "text_crc32", "size")) - 1
    ranked = rows.withColumn("rank", rank.cast("long"))
    here = (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank"))
    placed = ranked.join(F.broadcast(pieces.withColumnRenamed("cell", "its_cell")), (F.col("cell") == F.col("its_cell")) & here)
    return placed.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("first_slot") + F.col("rank") - F.col("from_rank")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
