"""Membership filters: Bloom filters in blocks of 512 bits, as tables that are built and asked by joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys for each block of eight words, one bit of each word a key: about one foreign key in 600 passes.
BLOCK_KEYS, WORDS = 32, 8
#: Blocks that are broadcast at most, some 200 bytes each with what a hash table adds; beyond it keys go to their blocks.
BROADCAST_BLOCKS = 200_000


def block_of(key: str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key), blocks)


def bits_of(key: str) -> list[Column]:
    """One bit for each word of the key's block."""
    mixed = F.xxhash64(key, F.lit(1))
    place = [F.shiftright(mixed, 6 * k).bitwiseAND(F.lit(63)).cast("int") for k in range(WORDS)]
    return [F.call_function("shiftleft", F.lit(1).cast("long"), p) for p in place]


def build(keys: DataFrame, key: str, version: int, number: int) -> DataFrame:
    """(version, blocks, block, w0 to w7) of `number` keys at most, about; nulls are no members, repeats change nothing.

    Only touched blocks have a row. Bits are put together on both sides of the shuffle, so a repeated key is no load.
    """
    blocks = max(1, math.ceil(number / BLOCK_KEYS))
    words = [f"w{k}" for k in range(WORDS)]
    placed = keys.filter(F.col(key).isNotNull()).select(block_of(key, F.lit(blocks)).alias("block"), *[b.alias(w) for b, w in zip(bits_of(key), words, strict=True)])
    joined = placed.groupBy("block").agg(*[F.bit_or(w).alias(w) for w in words])
    return joined.select(F.lit(version).cast("long").alias("version"), F.lit(blocks).cast("long").alias("blocks"), "block", *words)


def possible(asked: DataFrame, key: str, filters: DataFrame) -> DataFrame:
    """(key) of asked keys that a filter of any version may hold, each once: all members, and few others.

    Where the filters are small no asked key is shuffled but those that pass.
    """
    sizes = filters.groupBy("version", "blocks").agg(F.count("*").alias("n")).collect()  # one row a version
    if not sizes:
        return asked.select(key).limit(0)
    versions = F.array(*[F.struct(F.lit(r.version).alias("version"), F.lit(r.blocks).alias("blocks")) for r in sizes])
    tried = asked.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.explode(versions).alias("of"))
    placed = tried.select("key", F.col("of.version").alias("version"), block_of("key", F.col("of.blocks")).alias("block"))
    held = filters.drop("blocks")
    if sum(r.n for r in sizes) <= BROADCAST_BLOCKS:
        held = F.broadcast(held)
    passed = placed.join(held, ["version", "block"])
    for k, bit in enumerate(bits_of("key")):
        passed = passed.filter(F.col(f"w{k}").bitwiseAND(bit) != 0)
    return passed.select(F.col("key").alias(key)).distinct()
