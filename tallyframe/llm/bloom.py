"""Blocked Bloom filters as ordinary tables: one row of eight words per block, joined by block number.

A key sets ``PROBES`` of the 512 bits of one block. The number of blocks follows the number of keys up to
``MAX_BLOCKS`` (16 MB of bits), so the table may be broadcast at any size of the input; beyond that the share of
false positives rises, never that of misses.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 16
MAX_BLOCKS = 1 << 18
WORDS = 8
PROBES = 2


def block_count(keys: int) -> int:
    return max(1, min(MAX_BLOCKS, -(-keys * BITS_PER_KEY // (64 * WORDS))))


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(h, F.lit(blocks)).cast("int")


def _places(h: Column) -> list[Column]:
    g = F.xxhash64(h, F.lit(1))
    return [F.shiftrightunsigned(g, 9 * i).bitwiseAND(F.lit(64 * WORDS - 1)).cast("int") for i in range(PROBES)]


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)))


def _masks(h: Column) -> list[Column]:
    """The eight words with the bits of one key."""
    places = _places(h)

    def word(i: int) -> Column:
        parts = [
            F.when(F.shiftright(p, 6) == i, _bit(p)).otherwise(F.lit(0).cast("long"))
            for p in places
        ]
        return reduce(lambda a, b: a.bitwiseOR(b), parts)

    return [word(i) for i in range(WORDS)]


def build(keys: DataFrame, column: str, blocks: int) -> DataFrame:
    """Filter of the long hashes in ``column``: ``_block``, ``_w0`` .. ``_w7``."""
    h = F.col(column)
    rows = keys.where(h.isNotNull()).select(_block(h, blocks).alias("_block"), *[m.alias(f"_w{i}") for i, m in enumerate(_masks(h))])
    return rows.groupBy("_block").agg(*[F.bit_or(f"_w{i}").alias(f"_w{i}") for i in range(WORDS)])


def build_repeated(keys: DataFrame, column: str, blocks: int) -> DataFrame:
    """Filter whose bits are those that at least two rows set: a hash with all its bits there may be repeated."""
    h = F.col(column)
    cells = keys.where(h.isNotNull()).select(_block(h, blocks).alias("_block"), F.explode(F.array(*_places(h))).alias("_place"))
    twice = cells.groupBy("_block", "_place").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2")
    words = [F.when(F.shiftright("_place", 6) == i, _bit(F.col("_place"))).otherwise(F.lit(0).cast("long")) for i in range(WORDS)]
    return twice.groupBy("_block").agg(*[F.bit_or(w).alias(f"_w{i}") for i, w in enumerate(words)])


def flag(rows: DataFrame, column: str, table: DataFrame, blocks: int, name: str) -> DataFrame:
    """Add ``name``: false where the hash in ``column`` is surely not in the filter. A null hash is never in it."""
    h = F.col(column)
    hit = reduce(
        lambda a, b: a & b, [F.coalesce(F.col(f"_w{i}"), F.lit(0).cast("long")).bitwiseAND(m) == m for i, m in enumerate(_masks(h))]
    )
    kept = rows.columns
    with_block = rows.withColumn("_block", F.coalesce(_block(h, blocks), F.lit(-1)))
    joined = with_block.join(F.broadcast(table), "_block", "left")  # at most MAX_BLOCKS rows of 8 words
    return joined.select(*kept, F.coalesce(h.isNotNull() & hit, F.lit(False)).alias(name))
