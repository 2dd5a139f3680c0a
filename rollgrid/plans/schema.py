"""Rollup schemas: keys, measures, time buckets and grouping sets, from JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from itertools import combinations

from rollgrid.functions.timebuckets import ALL_TIME, bucket_millis
from rollgrid.operators.aggregators import COMPOSITE, INCREMENTAL, ON_THE_FLY, known, stored

#: Type names of the schema language and their Spark types.
TYPES = {"boolean": "boolean", "byte": "tinyint", "short": "smallint", "integer": "int", "long": "bigint", "char": "string", "string": "string", "float": "float", "double": "double"}


@dataclass(frozen=True)
class Key:
    name: str
    type: str = "string"
    expression: str | None = None
    enum_values: tuple = ()


@dataclass(frozen=True)
class Composite:
    """Top or bottom count of a measure by the keys in sub, within each parent group."""

    aggregator: str
    count: int
    embedded: str
    sub: tuple[str, ...]

    @property
    def name(self) -> str:
        return f"{self.aggregator}-{self.embedded}-{self.count}_{'_'.join(sorted(self.sub))}"


@dataclass(frozen=True)
class Value:
    name: str
    type: str = "double"
    aggregators: tuple[str, ...] = ()
    composites: tuple[Composite, ...] = ()
    expression: str | None = None

    def composite(self, name: str) -> Composite | None:
        return next((c for c in self.composites if c.name == name), None)


@dataclass(frozen=True)
class Descriptor:
    """One grouping set at one time bucket, with the aggregators stored for each measure."""

    keys: tuple[str, ...]
    bucket: str
    aggregates: dict[str, tuple[str, ...]] = field(hash=False)

    @property
    def dims(self) -> str:
        return ",".join(self.keys) or "()"


@dataclass(frozen=True)
class Schema:
    keys: tuple[Key, ...]
    values: tuple[Value, ...]
    descriptors: tuple[Descriptor, ...]
    buckets: tuple[str, ...]

    @property
    def has_time(self) -> bool:
        return bool(self.buckets)

    def key_names(self) -> tuple[str, ...]:
        return tuple(k.name for k in self.keys)

    def find(self, keys: set[str], bucket: str) -> Descriptor:
        for d in self.descriptors:
            if set(d.keys) == keys and d.bucket == bucket:
                return d
        raise ValueError(f"no rollup of keys {sorted(keys)} at bucket {bucket!r}")


def _check(kind: str) -> str:
    if kind not in TYPES:
        raise ValueError(f"unknown type {kind!r}")
    return kind


def parse_schema(text: str | dict) -> Schema:
    """A schema from its JSON; raises ValueError with the reason if it is not valid."""
    told = json.loads(text) if isinstance(text, str) else text
    keys = tuple(Key(k["name"], _check(k.get("type", "string")), k.get("expression"), tuple(k.get("enumValues", ()))) for k in told.get("keys", ()))
    names = [k.name for k in keys]
    values = []
    for v in told.get("values", ()):
        plain, composite = [], []
        for a in v.get("aggregators", ()):
            if isinstance(a, dict):
                # fixed value: schemas spell the name in this way
                embedded = a.get("embededAggregator") or a.get("embeddedAggregator")
                if a["aggregator"] not in COMPOSITE or not (embedded in INCREMENTAL or embedded in ON_THE_FLY):
                    raise ValueError(f"unknown composite aggregator {a!r}")
                composite.append(Composite(a["aggregator"], int(a["count"]), embedded, tuple(a["subCombinations"])))
            elif known(a):
                plain.append(a)
            else:
                raise ValueError(f"unknown aggregator {a!r}")
        values.append(Value(v["name"], _check(v.get("type", "double")), tuple(plain), tuple(composite), v.get("expression")))
    buckets = tuple(told.get("timeBuckets", ()))
    for b in buckets:
        bucket_millis(b)
    told_sets = told.get("dimensions", [{"combination": []}])
    if told_sets == "ALL_COMBINATIONS":
        told_sets = [{"combination": list(c)} for n in range(len(names) + 1) for c in combinations(names, n)]
    by_set: dict[tuple[tuple[str, ...], str], dict[str, list[str]]] = {}

    def add(combination: list[str], bucket: str, wanted: dict[str, list[str]]) -> None:
        ordered = tuple(n for n in names if n in set(combination))
        if set(combination) - set(names):
            raise ValueError(f"unknown keys in {combination}")
        held = by_set.setdefault((ordered, bucket), {})
        for value, aggregators in wanted.items():
            held.setdefault(value, []).extend(a for a in stored(aggregators) if a not in held.get(value, []))

    for s in told_sets:
        own = buckets + tuple(b for b in s.get("timeBuckets", ()) if b not in buckets)
        wanted = {v.name: list(v.aggregators) for v in values}
        for extra in s.get("additionalValues", ()):
            name, _, aggregator = extra.partition(":")
            if name not in wanted or not known(aggregator):
                raise ValueError(f"unknown additional value {extra!r}")
            wanted[name].append(aggregator)
        for bucket in own or (ALL_TIME,):
            add(s["combination"], bucket, wanted)
            for v in values:  # what composites rank has to be there
                for c in v.composites:
                    add([*s["combination"], *c.sub], bucket, {v.name: [c.embedded]})
    descriptors = tuple(Descriptor(k, b, {n: tuple(a) for n, a in agg.items() if a}) for (k, b), agg in by_set.items())
    every = tuple(dict.fromkeys(d.bucket for d in descriptors if d.bucket != ALL_TIME))
    return Schema(keys, tuple(values), descriptors, every)
