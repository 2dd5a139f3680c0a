"""Enrichment: left joins with a lookup table, which as a rule holds one row a key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A lookup side is broadcast if Catalyst estimates it at no more bytes; beyond it, Catalyst chooses the join.
BROADCAST_BYTES = 64 << 20


def last_by_key(lookup: DataFrame, keys: list[str], position: str) -> DataFrame:
    """One row a key: the one that comes last by position."""
    return _one_by_key(lookup, keys, position, F.max_by)


def first_by_key(lookup: DataFrame, keys: list[str], position: str) -> DataFrame:
    """One row a key: the one that comes first by position."""
    return _one_by_key(lookup, keys, position, F.min_by)


def _one_by_key(lookup: DataFrame, keys: list[str], position: str, pick: Callable[[Column, str], Column]) -> DataFrame:
    """Rows of null position are passed over; a key that has no others gets null columns."""
    columns = [c for c in lookup.columns if c not in (*keys, position)]
    picked = lookup.groupBy(*keys).agg(pick(F.struct(*columns), position).alias("_row"))
    return picked.select(*keys, "_row.*")


def parse_mapping(text: str | None) -> list[tuple[str, str]]:
    """(from, to) pairs of "a:b,c"; a name alone maps to itself, empty parts are skipped."""
    pairs = [p.strip() for p in (text or "").split(",") if p.strip()]
    return [(p.partition(":")[0], p.partition(":")[2] or p.partition(":")[0]) for p in pairs]


def _small(lookup: DataFrame) -> bool:
    """By the optimizer's estimate of its bytes, without running anything."""
    return int(str(lookup._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= BROADCAST_BYTES  # an int or a Scala BigInt, by version


def _joined(stream: DataFrame, lookup: DataFrame, on: list[tuple[str, str]], take: list[str]) -> DataFrame:
    """stream as struct "_in" beside the matched columns "_out" (null on a miss)."""
    own = lookup.select(*[F.col(f"`{b}`").alias(f"_k{i}") for i, (_, b) in enumerate(on)], F.struct(*[F.col(f"`{c}`") for c in take]).alias("_out"))
    side = F.broadcast(own) if _small(own) else own
    left = stream.select(F.struct("*").alias("_in"))
    return left.join(side, [F.col("_in").getField(a) == F.col(f"_k{i}") for i, (a, _) in enumerate(on)], "left")


def enrich(stream: DataFrame, lookup: DataFrame, on: list[tuple[str, str]], include: list[str] | None = None) -> DataFrame:
    """stream with the lookup's columns; they overwrite columns of the same name on a match.

    include: columns to add (None: all, the key's too). On a miss a row stays as
    it is, and added columns are null. A key of several rows in the lookup makes a row each.
    """
    take = include if include is not None else lookup.columns
    joined = _joined(stream, lookup, on, take)

    def column(name: str) -> Column:
        own, new = F.col("_in").getField(name), F.col("_out").getField(name)
        if name not in take:
            return own.alias(name)
        if name not in stream.columns:
            return new.alias(name)
        return F.when(F.col("_out").isNotNull(), new).otherwise(own).alias(name)

    return joined.select(*[column(c) for c in dict.fromkeys([*stream.columns, *take])])


def enrich_mapped(stream: DataFrame, lookup: DataFrame, lookups: str, enriched: str, copied: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """A new record: fields copied from the stream and enriched from the lookup, by "from:to" mappings.

    lookups: "stream field:lookup field" of the key. Enriched fields that are null, as
    all are on a miss, take their defaults if they have any.
    """
    pairs, defaults = parse_mapping(enriched), defaults or {}
    joined = _joined(stream, lookup, parse_mapping(lookups), [a for a, _ in pairs])
    copies = [F.col("_in").getField(a).alias(b) for a, b in parse_mapping(copied)]
    news = []
    for a, b in pairs:
        value = F.col("_out").getField(a)
        news.append((F.coalesce(value, F.lit(defaults[b])) if b in defaults else value).alias(b))
    return joined.select(*copies, *news)


def drop_null_keys(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose whole key is null have nothing to look up and are left out."""
    return stream.where(F.coalesce(*[F.col(f"`{k}`").cast("string") for k in keys]).isNotNull())
