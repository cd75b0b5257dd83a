"""A blocked Bloom filter made of DataFrame expressions.

A key sets one bit in each of the eight 32-bit words of one block, so the filter is a table of
blocks and a test is a lookup of one row. The table has at most `most_blocks` rows whatever the
number of keys, which bounds its broadcast (some 100 bytes a row); past that size it only lets
more false positives through, which the exact join behind it removes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8
# Odd multipliers that pick a key's bit in each word of its block, below 2**31 so that a
# product with 32 bits stays a bigint.
SALTS = [0x47B6137B, 0x44974D91, 0x2824AD5B, 0x52B7289D, 0x705495C7, 0x2DF1424B, 0x3EFC4947, 0x5C6BFB31]


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 32), F.lit(blocks))


def _bit(h: Column, k: int) -> Column:
    low = h.bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftrightunsigned((low * F.lit(SALTS[k])).bitwiseAND(F.lit(0xFFFFFFFF)), 27).cast("int")


def block_count(keys: int, bits_per_key: int = 16, most_blocks: int = 1 << 18) -> int:
    blocks = 1
    while blocks * WORDS * 32 < keys * bits_per_key and blocks < most_blocks:
        blocks *= 2
    return blocks


def build(df: DataFrame, key: Column, blocks: int) -> DataFrame:
    """(block, w0 .. w7): the blocks that hold a key."""
    h = df.select(F.xxhash64(key).alias("h"))
    one = F.expr("CAST(1 AS INT)")
    words = [F.bit_or(F.call_function("shiftleft", one, _bit(F.col("h"), k))).alias(f"w{k}") for k in range(WORDS)]
    return h.groupBy(_block(F.col("h"), blocks).alias("block")).agg(*words)


def passing(df: DataFrame, key: Column, table: DataFrame, blocks: int) -> DataFrame:
    """The rows whose key the filter may hold: never without a key that was put in."""
    h = F.xxhash64(key)
    test = _block(h, blocks) == F.col("block")
    for k in range(WORDS):
        test &= F.call_function("shiftrightunsigned", F.col(f"w{k}"), _bit(h, k)).bitwiseAND(F.lit(1)) == 1
    return df.join(F.broadcast(table), test, "left_semi")
