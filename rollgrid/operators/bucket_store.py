"""Keys seen before, kept for a deduper: by window and bucket, with expiry, compaction and rescaling.

Each window's new keys are one folder, dealt to buckets by their hash; writing a
window again replaces it. Reading some buckets prunes the others' files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollgrid.operators import bloom
from rollgrid.operators.dedup import DUPLICATE, ERROR, EXPIRED, UNIQUE, dedup
from rollgrid.operators.partitioning import hash_part

#: How many buckets a store has, and the keys of a bucket and the error that size its bloom filter.
BUCKETS, BLOOM_KEYS, BLOOM_ERROR = 1000, 10_000, 0.01


def validity(bucket: str = "bucket"):
    """The verdict that a negative bucket stands for: -1 expired, others an error; null for a valid one."""
    return F.when(F.col(bucket) == -1, EXPIRED).when(F.col(bucket) < 0, ERROR)


class BucketStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets

    def _folder(self, window: int) -> str:
        return f"{self.path}/window={window}"

    def save(self, keys: DataFrame, window: int) -> None:
        """keys (key, time) first seen in a window; a window saved again is replaced."""
        dealt = keys.select("key", "time", hash_part(F.col("key"), self.buckets).alias("bucket"))
        dealt.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._folder(window))

    def windows(self) -> list[int]:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        files = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(where):
            return []
        names = [s.getPath().getName() for s in files.listStatus(where)]
        return sorted(int(n.partition("=")[2]) for n in names if n.startswith("window="))

    def load(self, buckets: list[int] | None = None) -> DataFrame:
        """key, time (the last it was seen): the keys of some buckets, or of all."""
        if not self.windows():
            return self.spark.createDataFrame([], "key long, time long")
        rows = self.spark.read.parquet(self.path)
        rows = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
        return rows.groupBy("key").agg(F.max("time").alias("time"))

    def _drop(self, windows: list[int]) -> None:
        for w in windows:
            where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._folder(w))
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def expire(self, before: int, committed: int) -> list[int]:
        """Drops the windows, of those committed, whose times are all before a time; gives their numbers."""
        if not self.windows():
            return []
        last = self.spark.read.parquet(self.path).where(F.col("window") <= committed).groupBy("window").agg(F.max("time").alias("last"))
        gone = sorted(r["window"] for r in last.where(F.col("last") < before).collect())  # a row a window at most
        self._drop(gone)
        return gone

    def compact(self, upto: int) -> None:
        """Windows up to one become that one, with each key once."""
        old = [w for w in self.windows() if w <= upto]
        if len(old) > 1:
            rows = self.spark.read.parquet(self.path).where(F.col("window") <= upto).groupBy("key", "bucket").agg(F.max("time").alias("time"))
            spare = f"{self.path}/.compacted"
            rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(spare)
            self.spark.read.parquet(spare).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._folder(upto))
            self._drop([w for w in old if w != upto])

    def rescale(self, path: str, buckets: int) -> BucketStore:
        """The same keys dealt to another number of buckets."""
        out = BucketStore(self.spark, path, buckets)
        for w in self.windows():
            out.save(self.spark.read.parquet(self._folder(w)).select("key", "time"), w)
        return out

    def judge(self, events: DataFrame, key: str, arrival: list[str], shape: bloom.Shape | None = None) -> DataFrame:
        """events with a verdict: duplicate if the store holds the key, or an earlier event has it.

        Keys that a bloom filter of the stored ones lacks are new for certain, and aren't
        looked up; the others are joined with the store, so that verdicts are exact.
        """
        shape = shape or bloom.shape(self.buckets * BLOOM_KEYS, BLOOM_ERROR)
        stored = self.load().select("key")
        words = bloom.build(stored, "key", shape)
        maybe = bloom.probe(events.where(F.col(key).isNotNull()), key, words, shape).where("maybe").select("key")
        held = maybe.join(stored, "key", "left_semi").select(F.col("key").alias("_held"))
        judged = dedup(events, key, arrival)
        told = judged.join(held, F.col(key) == F.col("_held"), "left")
        return told.withColumn("verdict", F.when(F.col("_held").isNotNull(), DUPLICATE).otherwise(F.col("verdict"))).drop("_held")

    def absorb(self, judged: DataFrame, window: int, key: str, time: str) -> None:
        """Saves the keys of a window's unique events."""
        self.save(judged.where(F.col("verdict") == UNIQUE).select(F.col(key).alias("key"), F.col(time).alias("time")), window)
