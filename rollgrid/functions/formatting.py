"""Formats of results: numbers as text, maps as lists of entries, delimited records."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_entries(entries: Column) -> Column:
    """"[{k:v},{k:v}]" without quotes from array<struct<k, v>>; "[]" if empty or null."""
    told = F.transform(entries, lambda e: F.concat(F.lit("{"), e["k"].cast("string"), F.lit(":"), e["v"].cast("string"), F.lit("}")))
    return F.concat(F.lit("["), F.coalesce(F.array_join(told, ","), F.lit("")), F.lit("]"))


def format_number(value: Column) -> Column:
    return value.cast("string")


def _column(parts: Column, n: int) -> Column:
    return F.coalesce(F.get(parts, F.lit(n)), F.lit(""))


def project_record(body: Column, columns: list[int], source: str = "\x02", target: str = "\x01") -> Column:
    """The listed columns (from 0) of a delimited record, in listed order, each followed by target.

    A missing column is empty; a null record stays null.
    """
    parts = F.split(body, re.escape(source), -1)
    return F.when(body.isNotNull(), F.concat(*[F.concat(_column(parts, n), F.lit(target)) for n in columns]))


def parse_format(layout: str) -> tuple[str, list[tuple[int, str]]]:
    """Prefix, and (column, text after it) for each "{n}" of a format string."""
    pieces = re.split(r"\{(\d+)\}", layout)
    if len(pieces) < 3:
        raise ValueError(f"no column in format {layout!r}")
    return pieces[0], [(int(pieces[i]), pieces[i + 1]) for i in range(1, len(pieces), 2)]


def format_record(body: Column, layout: str, source: str = "\x02") -> Column:
    """A delimited record's columns put into a format string."""
    prefix, columns = parse_format(layout)
    parts = F.split(body, re.escape(source), -1)
    told = [F.lit(prefix)] + [x for n, after in columns for x in (_column(parts, n), F.lit(after))]
    return F.when(body.isNotNull(), F.concat(*told))
