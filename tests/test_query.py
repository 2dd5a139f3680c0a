import json

import pytest

from rollgrid.operators.rollup import rollup
from rollgrid.plans.query import answer, describe_schema, parse_query, result_json, run_query
from rollgrid.plans.schema import parse_schema

SCHEMA = parse_schema({
    "keys": [{"name": "shop", "type": "string", "enumValues": ["north", "south", "west"]}, {"name": "brand", "type": "string"}],
    "timeBuckets": ["1m", "5m"],
    "values": [{"name": "visits", "type": "long", "aggregators": ["SUM", "COUNT"]}],
    "dimensions": [{"combination": ["shop"]}, {"combination": ["shop", "brand"]}],
})


@pytest.fixture(scope="module")
def cube(spark):
    rows = [(p, a, 10, 60_000 * m) for p in ("north", "south", "west") for a in ("amber", "birch", "cedar") for m in range(10)]
    return rollup(spark.createDataFrame(rows, "shop string, brand string, visits bigint, time bigint"), SCHEMA)


def ask(data, **top):
    return parse_query(json.dumps({"id": "1", "type": "dataQuery", "data": data, **top}), SCHEMA)


def test_star_query_has_all_nine(cube):
    got = run_query(cube, SCHEMA, ask({"time": {"latestNumBuckets": 1, "bucket": "1m"}, "keys": {"shop": [], "brand": []}, "fields": ["time", "shop", "brand", "visits"]})).collect()
    assert len(got) == 9 and {r["visits:SUM"] for r in got} == {10} and {r["time"] for r in got} == {540_000}


def test_rolling_five(cube):
    got = run_query(cube, SCHEMA, ask({"time": {"from": 240_000, "to": 540_000, "bucket": "1m", "slidingAggregateSize": "5"}, "keys": {"shop": "north", "brand": "birch"}, "fields": ["time", "visits:SUM", "visits:AVG"]})).collect()
    assert len(got) == 6 and {r["visits:SUM"] for r in got} == {50} and {r["visits:AVG"] for r in got} == {10.0}


def test_range_is_floored_and_inclusive(cube):
    got = run_query(cube, SCHEMA, ask({"time": {"from": 61_000, "to": 185_000, "bucket": "1m"}, "keys": {"shop": ["west"]}, "fields": ["time", "visits:COUNT"]})).collect()
    assert sorted(r["time"] for r in got) == [60_000, 120_000, 180_000]


def test_json_and_all(cube):
    query = ask({"time": {"latestNumBuckets": 2, "bucket": "5m"}, "keys": {"shop": "west"}, "fields": ["time", "shop", "brand", "visits:SUM"]}, countdown=2)
    told = json.loads(result_json(run_query(cube, SCHEMA, query), query))
    assert told == {"id": "1", "type": "dataResult", "countdown": "2", "data": [{"time": t, "shop": "west", "brand": "ALL", "visits:SUM": "150"} for t in ("0", "300000")]}


def test_incomplete_results(cube):
    data = {"time": {"latestNumBuckets": 99, "bucket": "1m"}, "keys": {"shop": []}}
    assert answer(cube, SCHEMA, ask(data, incompleteResultOK=False, countdown=2)).count() == 0
    assert answer(cube, SCHEMA, ask(data, incompleteResultOK=False, countdown=1)).count() == 30
    assert answer(cube, SCHEMA, ask(data)).count() == 30


def test_schema_answer(cube):
    rows = describe_schema(cube, SCHEMA).collect()
    assert {(r["from"], r["to"]) for r in rows} == {(0, 540_000)} and len(rows) == 6


@pytest.mark.parametrize("data", [
    {"keys": {"shop": {"a": 1}}, "time": {"latestNumBuckets": 1}},
    {"keys": {"shop": 5}, "time": {"latestNumBuckets": 1}},
    {"keys": {"nobody": "x"}, "time": {"latestNumBuckets": 1}},
    {"keys": {"brand": "x"}, "time": {"latestNumBuckets": 1}},
    {"keys": {"shop": "x"}, "time": {"bucket": "1m"}},
    {"keys": {"shop": "x"}, "time": {"latestNumBuckets": 1, "slidingAggregateSize": 0}},
    {"keys": {"shop": "x"}, "time": {"latestNumBuckets": 1}, "fields": ["nothing"]},
    {"keys": {"shop": "x"}, "time": {"latestNumBuckets": 1, "bucket": "7d"}},
])
def test_bad_queries(data):
    with pytest.raises(ValueError):
        ask(data)
