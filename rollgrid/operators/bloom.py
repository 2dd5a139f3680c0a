"""Bloom filters over distributed keys.

Bits are set by an aggregation in the cluster: each key's probes become bit
positions, gathered into words of 32 bits by bitwise or, combined map-side. The
filter is the table of those words; its size depends on capacity and error alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shape:
    hashes: int
    bits: int


def shape(capacity: int, error: float) -> Shape:
    """Probes and bits for so many keys at a rate of false positives."""
    if capacity < 1 or not 0 < error < 1:
        raise ValueError("a positive capacity and an error between 0 and 1 are needed")
    hashes = math.ceil(-math.log2(error))
    return Shape(hashes, math.ceil(hashes / math.log(2) * capacity))


def _probes(key: Column, s: Shape) -> Column:
    """Bit positions of a key: multiples of one hash added to another."""
    first, second = F.xxhash64(key), F.xxhash64(F.lit(1), key)
    return F.transform(F.sequence(F.lit(0), F.lit(s.hashes - 1)), lambda i: F.pmod(F.shiftright(first, 2) + i * F.shiftright(second, 8), F.lit(s.bits)))


def build(keys: DataFrame, key: str, s: Shape) -> DataFrame:
    """word, bits: the filter's words that are not zero."""
    at = keys.select(F.explode(_probes(F.col(key), s)).alias("at"))
    return at.groupBy(F.floor(F.col("at") / 32).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 32 as int))")).alias("bits"))


def probe(queries: DataFrame, key: str, words: DataFrame, s: Shape) -> DataFrame:
    """queries' distinct keys with "maybe": whether the filter may hold them; false is certain."""
    spread = queries.select(F.col(key).alias("key")).distinct().select("key", F.explode(_probes(F.col("key"), s)).alias("at"))
    placed = spread.withColumn("word", F.floor(F.col("at") / 32)).join(words, "word", "left")
    hit = F.expr("(coalesce(bits, 0L) & shiftleft(1L, cast(at % 32 as int))) != 0")
    return placed.groupBy("key").agg(F.bool_and(hit).alias("maybe"))
