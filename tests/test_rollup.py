"""Golden cases of rollups: how many aggregates a configuration makes, and their values."""

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from rollgrid.functions.timebuckets import bucket_millis
from rollgrid.operators.aggregators import Incremental, OnTheFly, register_incremental, register_on_the_fly
from rollgrid.operators.rollup import aggregate_rows, collect_composite, merge_cubes, rank_composite, rollup
from rollgrid.plans.schema import parse_schema

# Three events, and how many aggregates each configuration makes of them (in the tests below).
AD = "publisher string, advertiser string, location string, impressions bigint, clicks bigint, cost double, revenue double, time bigint"
E1 = ("google", "starbucks", "SKY", 1000, 100, 5.5, 10.0, 300)
E2 = ("google", "safeway", "N", 100, 150, 3.5, 5.0, 300)
E3 = ("google", "safeway", "SKY", 105, 155, 3.55, 5.5, 305)
KEYS = [{"name": k, "type": "string"} for k in ("publisher", "advertiser", "location")]
SETS = [list(c) for n in range(4) for c in combinations(("publisher", "advertiser", "location"), n)]


def schema(aggregators, buckets, sets, extra=None, values=("impressions", "clicks", "cost", "revenue")):
    told = {"keys": KEYS, "values": [{"name": v, "type": "double", "aggregators": aggregators} for v in values]}
    if buckets:
        told["timeBuckets"] = buckets
    if sets is not None:
        told["dimensions"] = sets if isinstance(sets, str) else [{"combination": s, **(extra or {}).get(i, {})} for i, s in enumerate(sets)]
    return parse_schema(told)


def count(spark, s, rows):
    return aggregate_rows(rollup(spark.createDataFrame(rows, AD), s), s).count()


def test_simple_sums(spark):
    s = schema(["SUM"], ["1m"], [["publisher"]])
    row = rollup(spark.createDataFrame([E1, E2], AD), s).first()
    assert (row["clicks:SUM"], row["impressions:SUM"], row["revenue:SUM"], row["cost:SUM"], row["time"]) == (250, 1100, 15.0, 9.0, 0)


def test_numbers_of_aggregates(spark):
    buckets = ["1m", "1h", "1d"]
    more = {3: {"additionalValues": ["impressions:MIN", "clicks:MIN", "impressions:MAX"]}, 1: {"additionalValues": ["clicks:MIN", "clicks:MAX"]}}  # of location and of publisher
    full = schema(["SUM", "COUNT"], buckets, SETS, more)
    assert count(spark, full, [E1]) == 60
    assert count(spark, full, [E1, E2, E3]) == 114
    assert count(spark, schema(["SUM", "COUNT"], buckets, [[]]), [E1, E2, E3]) == 6
    assert count(spark, schema(["SUM", "AVG"], buckets, [[]]), [E1, E2]) == 6
    assert count(spark, schema(["SUM"], ["1m", "1h", "1d", "5m", "3h"], [[]]), [E1]) == 5
    assert count(spark, schema(["SUM"], None, SETS), [E1, E1]) == 8
    assert len(schema(["SUM"], ["1m"], "ALL_COMBINATIONS").descriptors) == 8
    assert count(spark, schema(["SUM"], ["1m", "1h"], [[], ["location"], ["advertiser"]], {1: {"timeBuckets": ["1d"]}, 2: {"timeBuckets": ["5m", "3h", "30s"]}}), [E1]) == 2 + 3 + 5


def test_no_time_doubles(spark):
    s = schema(["SUM"], None, SETS)
    rows = rollup(spark.createDataFrame([E1, E1], AD), s).collect()
    assert len(rows) == 8 and all(r["clicks:SUM"] == 200 and r["time"] is None for r in rows)


def test_measure_only_by_additional_values(spark):
    s = schema([], ["1m"], [["publisher"]], {0: {"additionalValues": ["revenue:SUM", "clicks:SUM"]}})
    row = rollup(spark.createDataFrame([E1], AD), s).first()
    assert row["revenue:SUM"] == 10.0 and "cost:SUM" not in row.asDict()


def test_composites(spark):
    rows = [("google", "x", loc, 50 + i, 0, 100.0 + i, 0.0, 60_000) for _ in range(5) for i, loc in enumerate(["CA", "WA", "ON", "BC"])]
    told = [{"aggregator": "TOPN", "count": 10, "embededAggregator": "SUM", "subCombinations": ["location"]}, {"aggregator": "BOTTOMN", "count": 20, "embededAggregator": "AVG", "subCombinations": ["location"]}]
    s = parse_schema({"keys": KEYS, "timeBuckets": ["1m"], "values": [{"name": v, "aggregators": told} for v in ("impressions", "cost")], "dimensions": [{"combination": ["publisher"]}]})
    assert [c.name for c in s.values[0].composites] == ["TOPN-SUM-10_location", "BOTTOMN-AVG-20_location"]
    cube = rollup(spark.createDataFrame(rows, AD), s)
    top = collect_composite(rank_composite(cube, s, "impressions", ("publisher",), ("location",), "1m", "TOPN", "SUM", 10), ("publisher",), "top").first()
    assert [(e["k"], e["v"]) for e in top["top"]] == [("BC", 265), ("ON", 260), ("WA", 255), ("CA", 250)]
    low = collect_composite(rank_composite(cube, s, "cost", ("publisher",), ("location",), "1m", "BOTTOMN", "AVG", 20), ("publisher",), "low").first()
    assert [(e["k"], e["v"]) for e in low["low"]] == [("CA", 100.0), ("WA", 101.0), ("ON", 102.0), ("BC", 103.0)]


def test_partial_cubes_merge(spark):
    s = schema(["SUM", "COUNT", "MIN", "MAX"], ["1m"], SETS)
    whole = rollup(spark.createDataFrame([E1, E2, E3], AD), s)
    parts = rollup(spark.createDataFrame([E1], AD), s).unionByName(rollup(spark.createDataFrame([E2, E3], AD), s))
    assert sorted(map(str, merge_cubes(parts, s).collect())) == sorted(map(str, whole.collect()))


def test_own_aggregators(spark):
    register_incremental("SUMSQ", Incremental(lambda v, at: F.sum(v * v), F.sum))
    register_on_the_fly("MEANSQ", OnTheFly(("SUMSQ", "COUNT"), lambda q, n: q / n))
    s = schema(["MEANSQ"], ["1m"], [[]], values=("clicks",))
    row = rollup(spark.createDataFrame([E1, E2], AD), s).first()
    assert row["clicks:SUMSQ"] == 32_500 and row["clicks:COUNT"] == 2
    with pytest.raises(ValueError):
        register_on_the_fly("NO", OnTheFly(("NOTHING",), lambda x: x))


def test_bad_schemas():
    for told in ({"keys": [{"name": "a", "type": "decimal"}]}, {"values": [{"name": "v", "aggregators": ["MEDIAN"]}]}, {"keys": [], "dimensions": [{"combination": ["b"]}]}, {"timeBuckets": ["5x"]}, {"values": [{"name": "v"}], "dimensions": [{"combination": [], "additionalValues": ["w:SUM"]}]}):
        with pytest.raises(ValueError):
            parse_schema(told)
    assert bucket_millis("5m", 2) == 600_000
