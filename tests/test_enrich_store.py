import pytest

from rollgrid.functions.formatting import format_entries, format_record, parse_format, project_record
from rollgrid.operators import bloom, enrich, keyed_store, merge, partitioning
from rollgrid.sources import event_log, lookups
from pyspark.sql import functions as F

# Rows of a lookup table.
PEOPLE = [(1, "Paul", 32, "California", 20000.0), (2, "Allen", 25, "Texas", 15000.0), (3, "Teddy", 23, "Norway", 20000.0), (4, "Mark", 25, "Rich-Mond", 65000.0)]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(PEOPLE, "ID int, NAME string, AGE int, ADDRESS string, SALARY double")


def test_composite_lookup(spark, people):
    stream = spark.createDataFrame([(25, "Texas"), (99, "Nowhere")], "AGE int, ADDRESS string")
    got = enrich.enrich(stream, people, [("AGE", "AGE"), ("ADDRESS", "ADDRESS")], ["ID", "NAME"]).collect()
    assert sorted(map(str, got)) == sorted(map(str, [type(got[0])(AGE=25, ADDRESS="Texas", ID=2, NAME="Allen"), type(got[0])(AGE=99, ADDRESS="Nowhere", ID=None, NAME=None)]))


def test_mapped_records(spark, people):
    orders = spark.createDataFrame([(3, 4, 700), (9, 77, 1)], "OID int, ID int, amount int")
    got = {r["OID"]: r for r in enrich.enrich_mapped(orders, people, "ID", "NAME,AGE,SALARY:pay", "OID,amount:sum", {"pay": 0.0}).collect()}
    assert (got[3]["NAME"], got[3]["pay"], got[3]["sum"]) == ("Mark", 65000.0, 700) and (got[9]["NAME"], got[9]["pay"]) == (None, 0.0)
    assert enrich.parse_mapping("a:b,, c ,") == [("a", "b"), ("c", "c")]


def test_overwriting(spark):
    stream = spark.createDataFrame([("k", "Value1", "Value2"), ("z", "Value1", "Value2")], "key string, In1 string, In2 string")
    lookup = spark.createDataFrame([("k", "A", "B", "Value3")], "key string, A string, B string, In1 string")
    every = {r["key"]: r for r in enrich.enrich(stream, lookup, [("key", "key")]).collect()}
    assert every["k"]["In1"] == "Value3" and every["z"]["In1"] == "Value1" and every["z"]["A"] is None
    some = enrich.enrich(stream, lookup, [("key", "key")], ["A", "B"])
    assert some.columns == ["key", "In1", "In2", "A", "B"] and {r["In1"] for r in some.collect()} == {"Value1"}
    assert enrich.drop_null_keys(stream.unionByName(spark.createDataFrame([(None, "x", "y")], stream.schema)), ["key"]).count() == 2


def test_json_lines(spark, tmp_path):
    (tmp_path / "map.txt").write_text('{"productId": 3, "productCategory": 1}\nnot json\n{"productId": 3, "productCategory": 5}\n{"productId": 4, "productCategory": 2}\n')
    rows = lookups.load_json_lines(spark, str(tmp_path / "map.txt"), ["productId"], "productCategory int, productId int").collect()
    assert {r["productId"]: r["productCategory"] for r in rows if r["productId"]} == {3: 5, 4: 2}


def test_wide_columns(spark):
    cells = spark.createDataFrame([("row1", "personal", "name", "raju"), ("row1", "professional", "Salary", "1"), ("row2", "personal", "name", "ravi")], "row_key string, family string, qualifier string, value string")
    got = {r["row_key"]: (r["personal.name"], r["professional.Salary"]) for r in lookups.wide_columns(cells, [("personal", "name"), ("professional", "Salary")]).collect()}
    assert got == {"row1": ("raju", "1"), "row2": ("ravi", None)}


def test_purge(spark):
    log = [(k, "PUT", 0, k, f"v{k}", None) for k in range(10)] + [(20, "PURGE", 0, 2, None, 5), (21, "PUT", 0, 3, "again", None), (22, "DELETE", 0, 9, None, None)]
    df = spark.createDataFrame(log, keyed_store.LOG)
    assert sorted(r["key"] for r in keyed_store.latest(df, 20).collect()) == [0, 1, 6, 7, 8, 9]
    assert keyed_store.get(df, 0, 3) == "again" and keyed_store.get(df, 0, 2) is None and keyed_store.get(df, 0, 6) == "v6" and keyed_store.get(df, 0, 9) is None
    assert sorted(map(str, keyed_store.latest(keyed_store.compact(df, 20)).collect())) == sorted(map(str, keyed_store.latest(df).collect()))
    with pytest.raises(ValueError):
        keyed_store.bucket_of("key", 6)


def test_ranges(spark):
    def made(*pairs):
        return sorted((r["start"], r["end"]) for r in keyed_store.coalesce_ranges(spark.createDataFrame(pairs, "start long, end long")).collect())

    assert made((1, 10), (11, 20), (1, 5)) == [(1, 10), (11, 20)]
    assert made((1, 10), (11, 20), (1, 5), (5, 12)) == [(1, 20)]
    held = spark.createDataFrame([(1, 5), (11, 20), (30, 60)], "start long, end long")
    assert keyed_store.overlapping(held, spark.createDataFrame([(5, 11)], "start long, end long")).count() == 2
    assert keyed_store.overlapping(held, spark.createDataFrame([(6, 10)], "start long, end long")).count() == 0


# Delimited records and what is left of them.
@pytest.mark.parametrize(("body", "want"), [("", "\x01\x01\x01"), ("\x02", "\x01\x01\x01"), ("First", "\x01\x01\x01"), ("\x02First", "First\x01\x01\x01"), ("First\x02Second", "Second\x01\x01\x01"), ("First\x02\x02Second", "\x01Second\x01\x01"), ("First\x02\x02Second\x02\x02\x02", "\x01Second\x01\x01"), (None, None)])
def test_records(spark, body, want):
    df = spark.createDataFrame([(body,)], "body string")
    assert df.select(project_record(F.col("body"), [1, 2, 3])).first()[0] == want


def test_formats(spark):
    df = spark.createDataFrame([("First\x02\x02Second\x02\x02\x02",)], "body string")
    assert df.select(format_record(F.col("body"), "a{1}bc{2}def{3}ghi")).first()[0] == "abcSeconddefghi"
    assert df.select(format_record(F.col("body"), "a{1}bc{2}def{3}")).first()[0] == "abcSeconddef"
    with pytest.raises(ValueError):
        parse_format("none")
    entries = spark.sql("SELECT array(named_struct('k', 'a', 'v', 1L), named_struct('k', 'b', 'v', 2L)) AS e, cast(null AS array<struct<k:string,v:bigint>>) AS n")
    assert tuple(entries.select(format_entries(F.col("e")), format_entries(F.col("n"))).first()) == ("[{a:1},{b:2}]", "[]")


def test_result_merge(spark):
    rows = [(i, "dataResult", ["x"] if i in (2, 4, 5) and n == 2 else [], n) for i in range(1, 8) for n in range(5 if i in (2, 4, 5) else 3)]
    df = spark.createDataFrame(rows, "id long, type string, data array<string>, arrival long")
    assert {r["id"]: len(r["data"]) for r in merge.first_non_empty(df).collect()} == {i: int(i in (2, 4, 5)) for i in range(1, 8)}
    assert merge.drop_empty(df).count() == 3


def test_bloom(spark):
    shape = bloom.shape(20_000, 0.01)
    assert shape.hashes == 7
    words = bloom.build(spark.range(10_000), "id", shape)
    assert bloom.probe(spark.range(10_000), "id", words, shape).where("NOT maybe").count() == 0
    wrong = bloom.probe(spark.range(1_000_000, 1_020_000), "id", words, shape).where("maybe").count()
    assert wrong / 20_000 <= 0.01


def test_parts():
    assert [partitioning.latency_load(x, 10, 20) for x in ([5, 6], [12], [30], [])] == [-1, 0, 1, 0]
    assert partitioning.deal_round_robin([1, 2, 3], 5) == [[1], [2], [3]] and partitioning.deal_round_robin([1, 2, 3], 2) == [[1, 3], [2]]
    assert event_log.adapt_batch(1000, 5, 0) == 950 and event_log.adapt_batch(1000, 0, 2) == 1050 and event_log.adapt_batch(100, 9, 0) == 100
    assert event_log.events_per_window(500, 2000, 4) == 250


def test_event_log(spark, tmp_path):
    log = event_log.EventLog(spark, str(tmp_path / "log"))
    events = spark.createDataFrame([(i, {"n": str(i)}, bytearray(b'{"v": %d}' % i if i % 2 else b"broken")) for i in range(6)], "i long, headers map<string,string>, body binary")
    for n in (0, 1, 1):
        log.store(events.where(f"i % 2 = {n}"), n, ["i"])
    assert log.read().count() == 6
    after = log.read(after=event_log.address(0, 1)).collect()
    assert sorted((r["file_no"], r["offset"]) for r in after) == [(0, 2), (1, 0), (1, 1), (1, 2)]
    good, bad = event_log.decode_json(log.read(), "v int")
    assert good.count() == 3 and bad.count() == 3
    assert log.retrieve(event_log.address(1, 0)) == b'{"v": 1}'
    assert log.clean(event_log.address(1, 0)) == [0] and log.files() == [1]
    with pytest.raises(KeyError):
        log.retrieve(event_log.address(0, 0))
