"""Queries asked of events and cubes: composites, running sums, what is read, and answers while a stream runs."""

import json

import pytest
from pyspark.sql import functions as F

from rollgrid.functions.formatting import format_entries
from rollgrid.operators.aggregators import COMPOSITE, register_composite
from rollgrid.operators.rollup import aggregate_rows, rollup
from rollgrid.plans import registry
from rollgrid.plans.query import answer, ask, expand_keys, narrowed, parse_query, planned, result_json, run_query, schema_json, single_key
from rollgrid.plans.schema import parse_schema
from rollgrid.streaming.jobs import CubeStore
from rollgrid.streaming.server import QueryServer

# Events of two a window, whose sums and averages the composites must give.
PLACES = ["CA", "WA", "ON", "BC"]
TWICE = [("google", place, impressions, (100.0 + i) / 2, 60_000) for _ in range(5) for i, place in enumerate(PLACES) for impressions in (50 + i, None)]
RANKED = [{"aggregator": "TOPN", "count": "10", "embededAggregator": "SUM", "subCombinations": ["location"]}, {"aggregator": "BOTTOMN", "count": "20", "embededAggregator": "AVG", "subCombinations": ["location"]}]


def _schema(**told):
    keys = [{"name": "publisher"}, {"name": "location"}]
    return parse_schema({"keys": keys, "timeBuckets": ["1m", "1h"], "dimensions": [{"combination": ["publisher"]}], **told})


def _query(schema, fields, **time):
    return parse_query({"id": 1, "type": "dataQuery", "data": {"time": {"bucket": "1m", **(time or {"latestNumBuckets": 10})}, "keys": {"publisher": ["google"]}, "fields": fields}}, schema)


def test_composite_fields(spark):
    schema = _schema(values=[{"name": "impressions", "type": "long", "aggregators": RANKED[:1]}, {"name": "cost", "aggregators": RANKED}])
    events = spark.createDataFrame(TWICE, "publisher string, location string, impressions long, cost double, time long")
    fields = ["time", "impressions:TOPN-SUM-10_location", "cost:TOPN:SUM:10:location", "cost:BOTTOMN-AVG-20_location"]
    query = _query(schema, fields)
    for found in (run_query(rollup(events, schema), schema, query), ask(events, schema, query)):
        (row,) = found.collect()
        told = {c: {e["k"]: e["v"] for e in row[c]} for c in found.columns if "_location" in c}
        assert told == {"impressions:TOPN-SUM-10_location": dict(zip(PLACES, [250, 255, 260, 265])), "cost:TOPN-SUM-10_location": dict(zip(PLACES, [500, 505, 510, 515])), "cost:BOTTOMN-AVG-20_location": dict(zip(PLACES, [50, 50.5, 51, 51.5]))}
        assert [e["k"] for e in row["cost:BOTTOMN-AVG-20_location"]] == PLACES
    message = json.loads(result_json(ask(events, schema, query), query))
    assert message["data"][0]["impressions:TOPN-SUM-10_location"] == "[{BC:265},{ON:260},{WA:255},{CA:250}]"
    assert {d.dims for d in narrowed(schema, query).descriptors} == {"publisher", "publisher,location"}
    for bad in ("cost:TOPN-SUM-11_location", "impressions:BOTTOMN-AVG-20_location", "cost:TOPN:SUM:10", "cost:a:b:c:d"):
        with pytest.raises(ValueError):
            _query(schema, ["time", bad])


def test_own_composite(spark):
    register_composite("NEAREST", lambda value: F.abs(value - 51).asc())
    try:
        schema = _schema(values=[{"name": "impressions", "type": "long", "aggregators": [{"aggregator": "NEAREST", "count": 1, "embededAggregator": "MAX", "subCombinations": ["location"]}]}])
        events = spark.createDataFrame(TWICE, "publisher string, location string, impressions long, cost double, time long")
        row = ask(events, schema, _query(schema, ["impressions:NEAREST-MAX-1_location"])).select(format_entries(F.col("`impressions:NEAREST-MAX-1_location`"))).first()
        assert row[0] == "[{WA:51}]"
    finally:
        del COMPOSITE["NEAREST"]


def test_running_sums(spark):
    schema = _schema(values=[{"name": "cost", "aggregators": ["SUM", "CUM_SUM"]}])
    events = spark.createDataFrame([("google", "x", float(m), m * 60_000) for m in range(8) if m != 5], "publisher string, location string, cost double, time long")
    query = _query(schema, ["time", "cost"], **{"from": 180_000, "to": 420_000})
    for found in (run_query(rollup(events, schema), schema, query), ask(events, schema, query)):
        got = {r["time"] // 60_000: (r["cost:SUM"], r["cost:CUM_SUM"]) for r in found.collect()}
        assert got == {3: (3, 6), 4: (4, 10), 6: (6, 16), 7: (7, 23)}


def test_times_of_latest_buckets(spark):
    schema = _schema(values=[{"name": "cost", "aggregators": ["SUM"]}])
    events = spark.createDataFrame([("google", "x", 1.0, m * 60_000) for m in range(8)], "publisher string, location string, cost double, time long")
    query = _query(schema, ["time", "cost"], latestNumBuckets=3)
    now = 5 * 60_000 + 30_000
    assert sorted(r["time"] // 60_000 for r in ask(events, schema, query).collect()) == [5, 6, 7]
    for found in (ask(events, schema, query, now=now), answer(rollup(events, schema), schema, query, now)):
        assert sorted(r["time"] // 60_000 for r in found.collect()) == [3, 4, 5]
    assert ask(events.limit(0), schema, query).count() == 0


@pytest.mark.parametrize("name", ["query_from_to", "query_key_in", "query_latest_n"])
def test_filters_reach_the_scan(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("\n")[0]
    assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed
    assert ("In(event_type" in pushed) == (name == "query_key_in")
    assert "user_id" not in plan.split("ReadSchema")[1].split("\n")[0] and "Generate explode" not in plan


def test_buckets_of_sets(spark):
    schema = parse_schema({"keys": [{"name": k} for k in ("publisher", "advertiser", "location")], "timeBuckets": ["1m", "3d"], "values": [{"name": v, "aggregators": ["SUM"]} for v in ("clicks", "cost")],
                           "dimensions": [{"combination": [], "timeBuckets": ["1h", "5s"]}, {"combination": ["location"]}, {"combination": ["advertiser", "location"], "timeBuckets": ["30s", "2h", "1d"]}]})
    one = spark.createDataFrame([("google", "starbucks", "SKY", 100, 5.5, 300)], "publisher string, advertiser string, location string, clicks long, cost double, time long")
    assert aggregate_rows(rollup(one, schema), schema).count() == 11  # fixed value


def test_key_hooks(spark):
    letters, numbers = (spark.createDataFrame([(x,) for x in xs], f"v {t}") for xs, t in ((["a", "b"], "string"), ([1, 2, 3], "int")))
    seen = []

    def valid(name, bound):
        seen.append((name, tuple(bound)))
        return F.col("n") > 1 if name == "n" else ~((F.col("l") == "a") & (F.col("n") == 3))

    got = {(r["l"], r["n"]) for r in expand_keys({"l": letters, "n": numbers}, order=lambda names: names[::-1], valid=valid).collect()}
    assert got == {("a", 2), ("b", 2), ("b", 3)} and seen == [("n", ()), ("l", ("n",))]
    schema = _schema(values=[{"name": "cost", "aggregators": ["SUM"]}])
    assert single_key(_query(schema, ["time"])) == {"publisher": "google"}
    with pytest.raises(ValueError):
        single_key(parse_query({"id": 1, "data": {"time": {"latestNumBuckets": 1}, "keys": {"publisher": []}}}, schema))


def test_planned_lookups():
    schema = _schema(values=[{"name": "cost", "aggregators": ["SUM", "AVG"]}])
    told = {"id": 1, "data": {"time": {"from": 61_000, "to": 200_000, "bucket": "1m", "slidingAggregateSize": 5}, "keys": {"publisher": ["google", "bing"]}, "fields": ["time", "cost:SUM"]}}
    asked = list(planned(schema, parse_query(told, schema)))
    assert len(asked) == len(set(asked)) == 7 * 2 and {x.time for x in asked} == set(range(-180_000, 180_001, 60_000))
    told["data"] |= {"time": {"latestNumBuckets": 3, "bucket": "1m"}, "fields": ["cost:AVG"]}
    asked = list(planned(schema, parse_query(told, schema), newest=600_500))
    assert sorted({x.time for x in asked}) == [480_000, 540_000, 600_000] and {x.aggregator for x in asked} == {"SUM", "COUNT"} and len(asked) == 3 * 2 * 2


def test_answers_while_a_stream_runs(spark, tmp_path):
    schema = _schema(values=[{"name": "cost", "aggregators": ["SUM", "COUNT"]}])
    server = QueryServer(CubeStore(spark, str(tmp_path / "cube"), schema), str(tmp_path / "out"))
    data = {"time": {"latestNumBuckets": 1, "bucket": "1h"}, "keys": {"publisher": []}, "fields": ["time", "publisher", "cost:SUM"]}
    assert server.submit(json.dumps({"id": "a", "type": "dataQuery", "countdown": 2, "data": data})) == "a"
    assert server.submit(json.dumps({"id": "a", "type": "dataQuery", "countdown": 1, "data": data})) == "a"  # the larger number stays
    assert server.submit(json.dumps({"id": "b", "type": "dataQuery", "data": data})) == "b"
    assert server.submit(json.dumps({"id": "s", "type": "schemaQuery"})) == "s"
    assert server.submit("{") is None and server.submit(json.dumps({"id": "c", "data": {"keys": {"no": 1}}})) is None
    for batch in (0, 1, 1, 2):  # one batch comes again
        rows = spark.createDataFrame([("google", "x", 1.0, batch)], "publisher string, location string, cost double, time long")
        server.on_batch(rows, batch)
    told = [(r["batch"], json.loads(r["message"])) for r in server.results().collect()]
    data_results = sorted((b, m["id"], m.get("countdown"), m["data"][0]["cost:SUM"]) for b, m in told if m["type"] == "dataResult")
    assert data_results == [(0, "a", "2", "1.0"), (0, "b", None, "1.0"), (1, "a", "1", "2.0")]
    (described,) = [m for _, m in told if m["type"] == "schemaResult"]
    assert described == json.loads(schema_json(server.store.read().where("time = 0"), schema, "s"))
    assert described["data"][0]["buckets"] == ["1m", "1h"] and described["data"][0]["keys"][0] == {"name": "publisher", "type": "string", "enumValues": ["google"]}
