"""Dimension queries: JSON in, a DataFrame (or JSON) out, answered from a cube."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollgrid.functions.formatting import format_entries, format_number
from rollgrid.functions.timebuckets import ALL_TIME, bucket_millis
from rollgrid.operators.aggregators import COMPOSITE, INCREMENTAL, ON_THE_FLY, RUNNING, known, stored
from rollgrid.operators.rollup import collect_composite, rank_composite, rollup, running_sum
from rollgrid.plans.schema import Composite, Descriptor, Schema

TIME_FIELDS = ("time", "timeBucket")
#: Bounds of the whole-number types of keys.
RANGES = {"byte": 7, "short": 15, "integer": 31, "long": 63}


@dataclass(frozen=True)
class DataQuery:
    id: str
    keys: dict[str, list] = field(default_factory=dict)
    fields: tuple[str, ...] = ()
    bucket: str = ALL_TIME
    start: int | None = None
    end: int | None = None
    latest: int | None = None
    sliding: int = 1
    countdown: int | None = None
    incomplete_ok: bool = True


def _checked(value: object, kind: str, name: str) -> object:
    """A key value as its type; ValueError if it cannot be one."""
    if isinstance(value, dict):
        raise ValueError(f"key {name}: an object is no value")
    if kind in RANGES:
        if isinstance(value, bool) or not isinstance(value, int) or not -(2 ** RANGES[kind]) <= value < 2 ** RANGES[kind]:
            raise ValueError(f"key {name}: {value!r} is not a {kind}")
    elif kind in ("float", "double"):
        if isinstance(value, bool) or not isinstance(value, int | float):
            raise ValueError(f"key {name}: {value!r} is not a {kind}")
    elif kind == "boolean":
        if not isinstance(value, bool):
            raise ValueError(f"key {name}: {value!r} is not a boolean")
    elif not isinstance(value, str) or kind == "char" and len(value) != 1:
        raise ValueError(f"key {name}: {value!r} is not a {kind}")
    return value


def parse_query(text: str | dict, schema: Schema) -> DataQuery:
    """A data query from its JSON; raises ValueError with the reason if it is not valid."""
    told = json.loads(text) if isinstance(text, str) else text
    data = told.get("data") or {}
    types = {k.name: k.type for k in schema.keys}
    keys: dict[str, list] = {}
    for name, given in (data.get("keys") or {}).items():
        if name not in types:
            raise ValueError(f"unknown key {name!r}")
        keys[name] = [_checked(v, types[name], name) for v in (given if isinstance(given, list) else [given])]
    time = data.get("time")
    options: dict = {}
    if time is not None:
        options["bucket"] = time.get("bucket") or (schema.buckets[0] if schema.buckets else ALL_TIME)
        bucket_millis(options["bucket"])
        if time.get("from") is not None and time.get("to") is not None:  # wins over latestNumBuckets
            options["start"], options["end"] = int(time["from"]), int(time["to"])
        elif time.get("latestNumBuckets") is not None:
            options["latest"] = int(time["latestNumBuckets"])
        else:
            raise ValueError("a time needs from and to, or latestNumBuckets")
        options["sliding"] = int(time.get("slidingAggregateSize", 1))
        if options["sliding"] < 1:
            raise ValueError("slidingAggregateSize is at least 1")
    query = DataQuery(str(told["id"]), keys, tuple(data.get("fields") or ()), countdown=told.get("countdown"), incomplete_ok=bool(told.get("incompleteResultOK", True)), **options)
    schema.find(set(keys), query.bucket)
    _measures(query, schema)
    return query


def _field(name: str, schema: Schema) -> list[tuple[str, str]]:
    """(measure, aggregator) of a field that is an aggregate: "measure", "measure:AGG" or a composite.

    A composite is named as "measure:TOPN-SUM-10_location" or "measure:TOPN:SUM:10:location".
    """
    values = {v.name: v for v in schema.values}
    measure, *rest = name.split(":")
    if measure not in values:
        raise ValueError(f"unknown field {name!r}")
    value = values[measure]
    if not rest:
        return [(measure, a) for a in (*value.aggregators, *(c.name for c in value.composites))]
    if len(rest) >= 4 and rest[0] in COMPOSITE:
        rest = [f"{'-'.join(rest[:3])}_{'_'.join(sorted(rest[3:]))}"]
    if len(rest) != 1 or not (known(rest[0]) or value.composite(rest[0])):
        raise ValueError(f"unknown aggregator in field {name!r}")
    return [(measure, rest[0])]


def _measures(query: DataQuery, schema: Schema) -> list[tuple[str, str]]:
    """(measure, aggregator) of each field that is an aggregate."""
    plain = (*TIME_FIELDS, *schema.key_names())
    wanted = [n for n in query.fields or tuple(v.name for v in schema.values) if n not in plain]
    return list(dict.fromkeys(m for n in wanted for m in _field(n, schema)))


def _composites(query: DataQuery, schema: Schema) -> list[tuple[str, Composite]]:
    values = {v.name: v for v in schema.values}
    found = [(m, values[m].composite(a)) for m, a in _measures(query, schema)]
    return [(m, c) for m, c in found if c]


def bounds(query: DataQuery, newest: int | None) -> tuple[int, int] | None:
    """The first and last bucket asked for; newest: the time that the latest buckets end at. None without a time."""
    if query.bucket == ALL_TIME:
        return None
    size = bucket_millis(query.bucket)
    if query.start is not None:
        return query.start - query.start % size, query.end - query.end % size
    last = newest - newest % size
    return last - (query.latest - 1) * size, last


def _time_range(rows: DataFrame, query: DataQuery, now: int | None) -> tuple[DataFrame, Column | None]:
    """rows within the query's range, widened for sliding; and the predicate of what is shown."""
    if query.bucket == ALL_TIME:
        return rows, None
    size = bucket_millis(query.bucket)
    before = size * (query.sliding - 1)
    if query.start is not None or now is not None:
        first, last = bounds(query, now)
        return rows.where(F.col("time").between(first - before, last)), F.col("time") >= first
    # one row: the latest bucket of the rollup
    newest = rows.agg(F.max("time").alias("newest"))
    start = F.col("newest") - (query.latest - 1) * size
    held = rows.crossJoin(F.broadcast(newest)).where(F.col("time").between(start - before, F.col("newest"))).withColumn("start", start).drop("newest")
    return held, F.col("time") >= F.col("start")


def run_query(cube: DataFrame, schema: Schema, query: DataQuery, now: int | None = None) -> DataFrame:
    """time, timeBucket, keys and "measure:AGG" columns, as the query's fields ask.

    A key that is not part of the queried combination shows as "ALL". With a
    sliding size of n, each bucket is aggregated with the n - 1 buckets before it
    that the key has; rows without as many are left out. Derived aggregates come
    after sliding. Running sums are over all buckets of the rollup up to each one.
    A composite is an array of its sub keys k and values v, in order of rank. now:
    the time at which the latest buckets end, if not with the newest of the rollup.
    """
    own = schema.find(set(query.keys), query.bucket)
    rows = cube.where((F.col("dims") == own.dims) & (F.col("bucket") == query.bucket))
    measures, composites = _measures(query, schema), _composites(query, schema)
    if composites and query.sliding > 1:
        raise ValueError("composites don't slide")
    running = [(m, a) for m, a in measures if a in RUNNING]
    rows = rows.withColumns({f"{m}:{a}": running_sum(F.col(f"`{m}:{RUNNING[a]}`"), schema) for m, a in running})
    newest_over_all_keys = query.latest is not None and now is None
    predicate = [F.col(f"`{k}`").isin(list(v)) for k, v in query.keys.items() if v]
    if not newest_over_all_keys:
        for p in predicate:
            rows = rows.where(p)
    rows, shown = _time_range(rows, query, now)
    if newest_over_all_keys:
        for p in predicate:
            rows = rows.where(p)
    plain = [(m, a) for m, a in measures if known(a)]
    needed = [(m, a) for m in dict.fromkeys(m for m, _ in plain) for a in stored([x for n, x in plain if n == m])]
    needed = [(m, a) for m, a in needed if f"{m}:{a}" in cube.columns]
    if query.sliding > 1:
        over = Window.partitionBy(*[f"`{k}`" for k in own.keys]).orderBy("time").rowsBetween(1 - query.sliding, 0)
        rows = rows.withColumn("held", F.count("*").over(over))
        rolled = {f"{m}:{a}": F.when(F.count(F.col(f"`{m}:{a}`")).over(over) == query.sliding, INCREMENTAL[a].merge(F.col(f"`{m}:{a}`")).over(over)) for m, a in needed}
        rows = rows.withColumns(rolled).where(F.col("held") == query.sliding)
    if shown is not None:
        rows = rows.where(shown)
    group = ["time", *own.keys]
    for m, c in composites:
        ranked = rank_composite(cube, schema, m, own.keys, tuple(c.sub), query.bucket, c.aggregator, c.embedded, c.count)
        for p in predicate:
            ranked = ranked.where(p)
        told = collect_composite(ranked, own.keys, f"{m}:{c.name}").select(*[F.col(f"`{g}`").alias(f"_{g}") for g in group], f"`{m}:{c.name}`")
        rows = rows.join(told, [F.col(f"`{g}`").eqNullSafe(F.col(f"`_{g}`")) for g in group], "left").drop(*[f"_{g}" for g in group])
    columns: list[Column] = []
    if query.bucket != ALL_TIME and (not query.fields or "time" in query.fields):
        columns.append(F.col("time"))
    if "timeBucket" in query.fields:
        columns.append(F.col("bucket").alias("timeBucket"))
    for k in schema.key_names():
        if k in own.keys:
            columns.append(F.col(f"`{k}`"))
        elif k in query.fields:
            columns.append(F.lit("ALL").alias(k))
    for m, a in measures:
        if a in ON_THE_FLY:
            columns.append(ON_THE_FLY[a].value(*[F.col(f"`{m}:{c}`") for c in ON_THE_FLY[a].children]).alias(f"{m}:{a}"))
        elif f"{m}:{a}" in rows.columns:
            columns.append(F.col(f"`{m}:{a}`"))
        else:
            raise ValueError(f"the rollup does not store {m}:{a}")
    return rows.select(*columns)


def narrowed(schema: Schema, query: DataQuery) -> Schema:
    """The part of a schema that a query needs: its own descriptor, those that its composites rank, and what they store."""
    own = schema.find(set(query.keys), query.bucket)
    wanted: dict[str, list[str]] = {}
    for m, a in _measures(query, schema):
        wanted.setdefault(m, []).extend([a] if known(a) else [])
    needed = [Descriptor(own.keys, own.bucket, {m: tuple(x for x in stored(a) if x in own.aggregates.get(m, ())) for m, a in wanted.items() if a})]
    for m, c in _composites(query, schema):
        sub = schema.find({*own.keys, *c.sub}, own.bucket)
        held = next((d for d in needed if d.keys == sub.keys), None)
        if held is None:
            held = Descriptor(sub.keys, sub.bucket, {})
            needed.append(held)
        held.aggregates[m] = tuple(dict.fromkeys([*held.aggregates.get(m, ()), *stored([c.embedded])]))
    return Schema(schema.keys, schema.values, tuple(needed), () if own.bucket == ALL_TIME else (own.bucket,))


@dataclass(frozen=True)
class Lookup:
    """One stored aggregate that a query needs: a group's keys in one bucket."""

    dims: str
    bucket: str
    time: int | None
    aggregator: str
    keys: tuple[tuple[str, object], ...]


def planned(schema: Schema, query: DataQuery, newest: int | None = None) -> Iterator[Lookup]:
    """The point lookups that would answer a query: its buckets, widened for sliding, by keys and stored aggregators.

    Keys that ask for all values stand for themselves ("ALL"). newest: where the latest buckets end.
    """
    own = schema.find(set(query.keys), query.bucket)
    stored_ones = stored([a for _, a in _measures(query, schema) if known(a)])
    found = bounds(query, newest)
    size = bucket_millis(query.bucket) if found else 1
    times = [None] if found is None else range(found[0] - size * (query.sliding - 1), found[1] + 1, size)
    for time, values in product(times, product(*[query.keys[k] or ["ALL"] for k in own.keys])):
        for a in stored_ones:
            yield Lookup(own.dims, query.bucket, time, a, tuple(zip(own.keys, values)))


def ask(events: DataFrame, schema: Schema, query: DataQuery, time: str = "time", scan: Callable[[int | None, int], Column] | None = None, now: int | None = None) -> DataFrame:
    """answer() straight from events: only what the query needs is read, kept and rolled up.

    scan: the predicate on the source's own columns for times from the first, or from
    the start (None), up to but without the last, in milliseconds; it reaches the source
    where the time column is made from others. Latest buckets end with the newest event,
    which is read first, unless now is given.
    """
    part, rows = narrowed(schema, query), events
    if query.latest is not None:
        newest = now if now is not None else events.agg(F.max(time)).first()[0]
        if newest is None:
            return run_query(rollup(rows, part, time), part, query)
        first, last = bounds(query, newest)
        query = replace(query, latest=None, start=first, end=last)
    for k in schema.keys:
        if query.keys.get(k.name):
            rows = rows.where((F.expr(k.expression) if k.expression else F.col(f"`{k.name}`")).isin(list(query.keys[k.name])))
    if query.bucket != ALL_TIME:
        size = bucket_millis(query.bucket)
        first, last = bounds(query, None)
        start = None if any(a in RUNNING for _, a in _measures(query, schema)) else first - size * (query.sliding - 1)
        if scan is not None:
            rows = rows.where(scan(start, last + size))
        rows = rows.where(F.col(time) < last + size)
        rows = rows if start is None else rows.where(F.col(time) >= start)
    return answer(rollup(rows, part, time), part, query)


def is_complete(result: DataFrame, query: DataQuery) -> bool:
    """Whether every bucket asked for is there; only bounded counts are read."""
    if query.bucket == ALL_TIME:
        return not result.isEmpty()
    size = bucket_millis(query.bucket)
    wanted = query.latest if query.latest is not None else (query.end - query.end % size - (query.start - query.start % size)) // size + 1
    return result.select("time").distinct().count() >= wanted


def answer(cube: DataFrame, schema: Schema, query: DataQuery, now: int | None = None) -> DataFrame:
    """run_query(), but no rows where the result is incomplete and the query wants whole ones."""
    result = run_query(cube, schema, query, now)
    if not query.incomplete_ok and (query.countdown or 1) > 1 and not is_complete(result, query):
        return result.limit(0)
    return result


def result_json(result: DataFrame, query: DataQuery, order: list[str] | None = None) -> str:
    """The JSON message of a result: all values as text, ascending by time, then keys."""
    order = order or [c for c in result.columns if ":" not in c]
    told = [(format_entries(F.col(f"`{c}`")) if t.startswith("array") else format_number(F.col(f"`{c}`"))).alias(c) for c, t in result.dtypes]
    rows = result.orderBy(*[f"`{c}`" for c in order]).select(*told).collect()
    message = {"id": query.id, "type": "dataResult", "data": [r.asDict() for r in rows]}
    if query.countdown is not None:
        message["countdown"] = str(query.countdown)
    return json.dumps(message)


def describe_schema(cube: DataFrame, schema: Schema) -> DataFrame:
    """key, value and the rollup's first and last time: what a schema query is answered from."""
    span = cube.agg(F.min("time").alias("from"), F.max("time").alias("to"))
    seen = None
    for k in schema.keys:
        own = cube.where(F.col(f"`{k.name}`").isNotNull()).select(F.lit(k.name).alias("key"), F.col(f"`{k.name}`").cast("string").alias("value"))
        if k.enum_values:
            listed = cube.sparkSession.createDataFrame([(k.name, str(v)) for v in k.enum_values], "key string, value string")
            own = own.unionByName(listed)
        seen = own if seen is None else seen.unionByName(own)
    if seen is None:
        return span.select(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"), "from", "to")
    return seen.distinct().crossJoin(F.broadcast(span))


def schema_json(cube: DataFrame, schema: Schema, id: str = "1", delay: int = 1000) -> str:
    """The JSON answer to a schema query: keys with the values known, buckets, first and last time, delay of answers."""
    rows = describe_schema(cube, schema).collect()  # the values of keys that a schema query lists
    keys = [{"name": k.name, "type": k.type, "enumValues": sorted({r["value"] for r in rows if r["key"] == k.name})} for k in schema.keys]
    values = [{"name": f"{v.name}:{a}", "type": "long" if a == "COUNT" else v.type} for v in schema.values for a in v.aggregators]
    data = {"schemaType": "dimensions", "keys": keys, "values": values, "buckets": list(schema.buckets), "responseDelayMillis": delay}
    if rows and rows[0]["from"] is not None:
        data |= {"from": rows[0]["from"], "to": rows[0]["to"]}
    return json.dumps({"id": id, "type": "schemaResult", "data": [data]})


def expand_keys(domains: dict[str, DataFrame], keep=None, order: Callable[[list[str]], list[str]] | None = None, valid: Callable[[str, list[str]], Column | None] | None = None) -> DataFrame:
    """Every combination of the keys' values; keep filters them.

    The domains are lists of known key values; the product is what a star query
    over them asks for. order: the order in which keys are bound. valid: for a key and
    the keys bound before it, the condition on their columns under which its value
    stays (None: always); values that don't are dropped before further keys are bound.
    """
    out, bound = None, []
    for name in (order or list)(list(domains)):
        own = domains[name].toDF(name).distinct()
        out = own if out is None else out.crossJoin(own)
        condition = valid(name, list(bound)) if valid else None
        out = out if condition is None else out.where(condition)
        bound.append(name)
    if out is None:
        raise ValueError("no keys")
    return out.where(keep) if keep is not None else out


def single_key(query: DataQuery) -> dict[str, object]:
    """The one value of each key; ValueError if a key has none or several."""
    if many := [k for k, v in query.keys.items() if len(v) != 1]:
        raise ValueError(f"keys {many} need one value each")
    return {k: v[0] for k, v in query.keys.items()}
