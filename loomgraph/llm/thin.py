"""A filter of bounded size ahead of a join, so that rows without a partner aren't sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.store import spare

#: A block has so many 64-bit words. All blocks of a filter together are 8 MB of bits at most.
BLOCK_WORDS, MAX_BLOCKS = 16, 1 << 16
BITS_PER_KEY, PROBES = 12, 3
_PLACE_BITS = (64 * BLOCK_WORDS).bit_length() - 1


def _places(keys: list[Column]) -> list[Column]:
    """Bits of a key in its block."""
    h = F.xxhash64(F.lit("place"), *keys)
    return [F.shiftrightunsigned(h, p * _PLACE_BITS).bitwiseAND(F.lit(64 * BLOCK_WORDS - 1).cast("long")).cast("int") for p in range(PROBES)]


def thin(df: DataFrame, keys: list[str], held: DataFrame, n: int) -> DataFrame:
    """Rows of ``df`` whose keys are in a row of ``held``, and some others; an exact join is to follow.

    A Bloom filter of the ``n`` rows of ``held`` is broadcast, each key's bits in one block of
    it. It is in proportion to n as far as MAX_BLOCKS; beyond, more of the other rows pass.
    """
    blocks = min(MAX_BLOCKS, 1 << ((n * BITS_PER_KEY) // (64 * BLOCK_WORDS)).bit_length())

    def block(of: DataFrame) -> Column:
        return F.pmod(F.xxhash64(F.lit("block"), *[of[k] for k in keys]), F.lit(blocks))

    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(F.lit(63)))
    bits = [F.coalesce(F.bit_or(F.when(F.shiftright("place", 6) == i, bit)), F.lit(0).cast("long")) for i in range(BLOCK_WORDS)]
    block_, words_ = spare(df.columns, "block", "words")
    filled = held.select(block(held).alias(block_), F.explode(F.array(*_places([held[k] for k in keys]))).alias("place")).groupBy(block_).agg(F.array(*bits).alias(words_))
    passes = block(df) == filled[block_]
    for place in _places([df[k] for k in keys]):
        word = F.get(filled[words_], F.shiftright(place, 6))
        passes &= F.call_function("shiftright", word, place.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1).cast("long")) == 1
    return df.join(F.broadcast(filled), passes, "left_semi")
