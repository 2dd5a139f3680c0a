from collections import Counter

from pyspark.sql import functions as F

from rollgrid.operators import dedup, laggards
from rollgrid.operators.running import running

ROWS = "arrival long, id long, time long"


def verdicts(df):
    return Counter(r["verdict"] for r in df.collect())


def test_ordered_expiry(spark):
    times = [*range(1000, 1200, 10), *range(1050, 1150, 10), *range(50, 150, 10)]
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(times)], ROWS)
    assert verdicts(dedup.dedup_ordered(df, "id", "time", ["arrival"], 1000, 10)) == {"unique": 20, "duplicate": 10, "expired": 10}


def test_time_expiry(spark):
    seconds = [*range(1000, 3000, 100), *range(1000, 2000, 100), *range(50, 150, 10)]
    df = spark.createDataFrame([(i, t, t * 1000) for i, t in enumerate(seconds)], ROWS)
    assert verdicts(dedup.dedup_time(df, "id", "time", ["arrival"], 2000, 10)) == {"unique": 20, "duplicate": 10, "expired": 10}
    assert verdicts(dedup.dedup_time(df, "id", "time", ["arrival"], 2000, 10, now=10_000)) == {"expired": 40}


def test_jump_is_an_error_and_leaves_the_clock(spark):
    df = spark.createDataFrame([(i, i, t) for i, t in enumerate([100, 110, 500, 115, 95, 9])], ROWS)
    got = {r["arrival"]: r["verdict"] for r in dedup.dedup_ordered(df, "id", "time", ["arrival"], 20, 10, max_jump=50).collect()}
    # the clock starts at 19 with an expiry point of 0, which takes any jump
    assert got == {0: "unique", 1: "unique", 2: "error", 3: "unique", 4: "expired", 5: "expired"}


def test_categorical(spark):
    five = spark.createDataFrame([(i, i, f"f{i}") for i in range(1, 6)], "arrival long, id long, cat string")
    assert verdicts(dedup.dedup_categorical(five, "id", "cat", ["arrival"], 5)) == {"unique": 5}
    df = spark.createDataFrame([(i, i, c) for i, c in enumerate(["f1", "f2", "f3", "f1", "f2"])], "arrival long, id long, cat string")
    got = {r["arrival"]: r["verdict"] for r in dedup.dedup_categorical(df, "id", "cat", ["arrival"], 2).collect()}
    assert got == {0: "unique", 1: "unique", 2: "unique", 3: "expired", 4: "unique"}


def test_order_is_kept(spark):
    df = spark.createDataFrame([(i, k) for i, k in enumerate([0, 1, 2, 3, 4, 5, 0, 1, 2, 3, 4, None, None])], "arrival long, id long")
    judged = dedup.in_order(dedup.dedup(df, "id", ["arrival"]), ["arrival"]).collect()
    assert [r["verdict"] for r in judged] == ["unique"] * 6 + ["duplicate"] * 5 + ["unique", "duplicate"]
    assert {r["verdict"]: r["n"] for r in dedup.dedup_counts(dedup.dedup(df, "id", ["arrival"])).collect()} == {"unique": 7, "duplicate": 6, "expired": 0, "error": 0}


def test_running(spark):
    values = [(i, (i * 37) % 101) for i in range(300)]
    df = spark.createDataFrame(values, "at long, v long")
    got = {r["at"]: (r["m"], r["s"]) for r in running(running(df, ["at"], "v", "max", "m"), ["at"], "v", "sum", "s", inclusive=True, ranges=7).collect()}
    for i in range(300):
        before = [v for _, v in values[:i]]
        assert got[i] == (max(before) if before else None, sum(before) + values[i][1])
    assert running(df.limit(0), ["at"], "v", "max", "m").count() == 0


def test_laggards(spark):
    times = {1234567: "normal", 1231199: "laggard", 1227599: "late_laggard", 1234567 + 30: "normal", 1234567 + 61 + 5: "error", None: "error"}
    df = spark.createDataFrame([(t * 1000 if t else None,) for t in times], "time long")
    judged = laggards.classify(df, "time", F.lit(1_234_567_000))
    assert {r["time"] // 1000 if r["time"] else None: r["verdict"] for r in judged.collect()} == times
    assert tuple(laggards.verdict_counts(judged).first()) == (6, 2, 1, 1, 3)
