"""Binary forms: keys of cube rows that sort like their values, whole numbers on the wire, keys as bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _big_endian(value: Column, size: int) -> Column:
    """Bytes of a whole number that isn't negative, highest first, so that they sort like it."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * size, "0"))


def _number(raw: Column, at: int, size: int) -> Column:
    return F.conv(F.hex(F.substring(raw, at, size)), 16, 10).cast("long")


def encode_cube_key(time: Column, schema_id: Column, descriptor_id: Column, aggregator_id: Column, keys: Column) -> Column:
    """time (8 bytes), schema, descriptor and aggregator (4 each), then the keys' own bytes."""
    return F.concat(_big_endian(time, 8), *[_big_endian(x, 4) for x in (schema_id, descriptor_id, aggregator_id)], F.encode(keys, "UTF-8"))


def decode_cube_key(raw: Column) -> Column:
    """struct<time, schema_id, descriptor_id, aggregator_id, keys> of an encoded key."""
    rest = F.substring(raw, 21, 2**31 - 1)
    return F.struct(_number(raw, 1, 8).alias("time"), _number(raw, 9, 4).cast("int").alias("schema_id"), _number(raw, 13, 4).cast("int").alias("descriptor_id"), _number(raw, 17, 4).cast("int").alias("aggregator_id"), F.decode(rest, "UTF-8").alias("keys"))


def little_endian(value: Column, size: int) -> Column:
    """Bytes of a whole number, lowest first, as requests on the wire have them; size: 4 or 8."""
    mask = F.lit(0xFFFFFFFF) if size == 4 else F.lit(-1).cast("long")
    told = F.lpad(F.hex(value.cast("long").bitwiseAND(mask)), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(told, 2 * i + 1, 2) for i in reversed(range(size))]))


def read_little_endian(raw: Column, size: int) -> Column:
    """The whole number that little_endian() wrote."""
    told = F.concat(*[F.hex(F.substring(raw, i, 1)) for i in range(size, 0, -1)])
    number = F.conv(told, 16, -10).cast("long")
    return number if size == 8 else F.shiftright(F.shiftleft(number, 32), 32).cast("int")


def key_bytes(value: Column) -> Column:
    """A key as bytes: its text in UTF-8; null stays null."""
    return F.encode(value.cast("string"), "UTF-8")
