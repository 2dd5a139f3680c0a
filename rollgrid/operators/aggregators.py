"""Aggregators of rollups: how to make a partial result, merge partials, and derive others."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Incremental:
    """partial: of raw values, with the order of arrival; merge: of partials; value: what is shown."""

    partial: Callable[[Column, Column], Column]
    merge: Callable[[Column], Column]
    value: Callable[[Column], Column] = lambda c: c


@dataclass(frozen=True)
class OnTheFly:
    """Derived at query time from the stored aggregators named in children."""

    children: tuple[str, ...]
    value: Callable[..., Column]


INCREMENTAL: dict[str, Incremental] = {
    "SUM": Incremental(lambda v, at: F.sum(v), F.sum),
    "COUNT": Incremental(lambda v, at: F.count(v), F.sum),
    "MIN": Incremental(lambda v, at: F.min(v), F.min),
    "MAX": Incremental(lambda v, at: F.max(v), F.max),
    # a struct of arrival and value merges like a minimum or maximum
    "FIRST": Incremental(lambda v, at: F.min(F.struct(at.alias("at"), v.alias("value"))), F.min, lambda c: c["value"]),
    "LAST": Incremental(lambda v, at: F.max(F.struct(at.alias("at"), v.alias("value"))), F.max, lambda c: c["value"]),
}

ON_THE_FLY: dict[str, OnTheFly] = {
    "AVG": OnTheFly(("SUM", "COUNT"), lambda total, n: F.when(n != 0, total / n)),
}

#: Aggregates that run over the buckets of a group in time, of a stored one.
RUNNING: dict[str, str] = {"CUM_SUM": "SUM"}

#: Composite aggregates keep some of the sub groups of each group: the order in which they rank a value.
COMPOSITE: dict[str, Callable[[Column], Column]] = {"TOPN": lambda value: value.desc(), "BOTTOMN": lambda value: value.asc()}


def known(name: str) -> bool:
    """Whether a measure can have this aggregator by itself."""
    return name in INCREMENTAL or name in ON_THE_FLY or name in RUNNING


def register_composite(name: str, order: Callable[[Column], Column]) -> None:
    """order: of values, those that are kept first."""
    COMPOSITE[name] = order


def register_incremental(name: str, aggregator: Incremental) -> None:
    INCREMENTAL[name] = aggregator


def register_on_the_fly(name: str, aggregator: OnTheFly) -> None:
    if missing := [c for c in aggregator.children if c not in INCREMENTAL]:
        raise ValueError(f"unknown children {missing}")
    ON_THE_FLY[name] = aggregator


def stored(aggregators: Iterable[str]) -> list[str]:
    """The incremental aggregators that have to be stored for the given ones."""
    out: list[str] = []
    for a in aggregators:
        out += [x for x in (ON_THE_FLY[a].children if a in ON_THE_FLY else (RUNNING.get(a, a),)) if x not in out]
    return out
