"""A mutable keyed store on versioned rows: put, delete and range purge, merged on read.

A log holds rows (version, op, bucket, key, value, key_end). PUT and DELETE
concern a key, PURGE the closed range from key to key_end. Reading folds the
log: the latest put or delete of a key counts, unless a later purge covers it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PUT, DELETE, PURGE = "PUT", "DELETE", "PURGE"
LOG = "version long, op string, bucket long, key long, value string, key_end long"


def latest(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """bucket, key, value of all live keys, as of a version (None: the last)."""
    seen = log if as_of is None else log.where(F.col("version") <= as_of)
    last = seen.where(F.col("op") != PURGE).groupBy("bucket", "key").agg(F.max_by(F.struct("op", "value", "version"), "version").alias("last"))
    live = last.where(F.col("last.op") == PUT).select("bucket", "key", "last.value", F.col("last.version").alias("version"))
    purges = seen.where(F.col("op") == PURGE).select(F.col("bucket").alias("p_bucket"), F.col("key").alias("p_start"), "key_end", F.col("version").alias("p_version"))
    covered = (F.col("bucket") == F.col("p_bucket")) & F.col("key").between(F.col("p_start"), F.col("key_end")) & (F.col("version") < F.col("p_version"))
    return live.join(purges, covered, "left_anti").select("bucket", "key", "value")


def get(log: DataFrame, bucket: int, key: int, as_of: int | None = None) -> str | None:
    """One key's value; None if it isn't live."""
    own = log.where((F.col("bucket") == bucket) & ((F.col("op") == PURGE) | (F.col("key") == key)))
    row = latest(own, as_of).where(F.col("key") == key).first()
    return row["value"] if row else None


def compact(log: DataFrame, version: int) -> DataFrame:
    """The log with all up to a version folded into puts of live keys."""
    folded = latest(log, version).select(F.lit(version).alias("version"), F.lit(PUT).alias("op"), "bucket", "key", "value", F.lit(None).cast("long").alias("key_end"))
    return folded.unionByName(log.where(F.col("version") > version))


def write_sorted(rows: DataFrame, path: str, files: int) -> None:
    """Data files with disjoint, sorted key ranges."""
    rows.repartitionByRange(files, "bucket", "key").sortWithinPartitions("bucket", "key").write.mode("overwrite").parquet(path)


def file_index(rows: DataFrame, size: int) -> DataFrame:
    """bucket, file, first and last key, keys: the sorted keys of each bucket in files of size keys."""
    order = Window.partitionBy("bucket").orderBy("key")
    placed = rows.withColumn("file", F.floor((F.row_number().over(order) - 1) / size).cast("long"))
    return placed.groupBy("bucket", "file").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count("*").alias("n"))


def bucket_of(key: str, buckets: int):
    """The bucket of a key; the number of buckets is a power of two."""
    if buckets & (buckets - 1):
        raise ValueError("the number of buckets is a power of two")
    return F.xxhash64(key).bitwiseAND(F.lit(buckets - 1))


def coalesce_ranges(ranges: DataFrame, start: str = "start", end: str = "end", group: list[str] | None = None) -> DataFrame:
    """Closed ranges that overlap or share an end point become one; repeated ones count once."""
    group = group or []
    ranges = ranges.select(*group, start, end).distinct()
    over = Window.partitionBy(*group).orderBy(start, end)
    before = F.max(end).over(over.rowsBetween(Window.unboundedPreceding, -1))
    islands = ranges.withColumn("_new", (before.isNull() | (F.col(start) > before)).cast("long")).withColumn("_island", F.sum("_new").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*group, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def overlapping(a: DataFrame, b: DataFrame, width: int = 64) -> DataFrame:
    """a_start, a_end, b_start, b_end of closed ranges of whole numbers that share a point.

    Ranges are joined on the bins of width that they reach into; a pair is taken in the
    bin in which the later of the two begins, so once. Ranges end where they begin or later.
    """

    def binned(rows: DataFrame, side: str) -> DataFrame:
        held = rows.where("start <= end").select(F.col("start").cast("long").alias(f"{side}_start"), F.col("end").cast("long").alias(f"{side}_end"), F.col("start").alias(f"{side}_s"), F.col("end").alias(f"{side}_e"))
        bins = F.sequence(F.floor(F.col(f"{side}_start") / width), F.floor(F.col(f"{side}_end") / width))
        return held.withColumn("bin", F.explode(bins))

    met = binned(a, "a").join(binned(b, "b"), "bin").where((F.col("a_start") <= F.col("b_end")) & (F.col("a_end") >= F.col("b_start")))
    once = met.where(F.col("bin") == F.floor(F.greatest("a_start", "b_start") / width))
    return once.select(F.col("a_s").alias("a_start"), F.col("a_e").alias("a_end"), F.col("b_s").alias("b_start"), F.col("b_e").alias("b_end"))


def contains(start: Column, end: Column, point: Column) -> Column:
    return point.between(start, end)


def within(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Whether a closed range lies in another."""
    return (start >= other_start) & (end <= other_end)


def extended(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """The least range that holds both, as struct<start, end>."""
    return F.struct(F.least(start, other_start).alias("start"), F.greatest(end, other_end).alias("end"))


def purge_plan(index: DataFrame, purges: DataFrame) -> DataFrame:
    """index (bucket, file, first_key, last_key) with what purges (bucket, start, end) ask of each file.

    delete: one purge covers the whole file; rewrite: some reach into it; keep: none does.
    """
    p = coalesce_ranges(purges, group=["bucket"]).select(F.col("bucket").alias("_b"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    met = index.join(p, (F.col("bucket") == F.col("_b")) & (F.col("first_key") <= F.col("_e")) & (F.col("last_key") >= F.col("_s")), "left")
    whole = F.coalesce((F.col("_s") <= F.col("first_key")) & (F.col("_e") >= F.col("last_key")), F.lit(False))
    told = met.groupBy(*index.columns).agg(F.max(whole).alias("_whole"), F.count("_b").alias("_n"))
    return told.select(*index.columns, F.when(F.col("_whole"), "delete").when(F.col("_n") > 0, "rewrite").otherwise("keep").alias("action"))


def read_keys(spark: SparkSession, path: str, bucket: int, keys: list[int]) -> DataFrame:
    """Rows of some keys from sorted data files: files and blocks whose range of keys holds none are skipped."""
    return spark.read.parquet(path).where((F.col("bucket") == bucket) & F.col("key").isin(keys))


#: Keys, or windows since the last flush, after which a cache is flushed.
FLUSH_KEYS, FLUSH_WINDOWS = 1_000_000, 120


def should_flush(keys: int, windows: int, most_keys: int = FLUSH_KEYS, most_windows: int = FLUSH_WINDOWS) -> bool:
    return keys > most_keys or windows > most_windows


class WriteAheadLog:
    """Log rows by window: each window is a folder of bounded files, so that writing it again replaces it."""

    def __init__(self, spark: SparkSession, path: str, file_rows: int = 1_000_000) -> None:
        self.spark, self.path, self.file_rows = spark, path, file_rows

    def append(self, rows: DataFrame, window: int) -> None:
        rows.write.option("maxRecordsPerFile", self.file_rows).mode("overwrite").parquet(f"{self.path}/window={window}")

    def recover(self, after: int) -> DataFrame:
        """Rows of the windows after one, which are to be put again."""
        return self.spark.read.parquet(self.path).where(F.col("window") > after)

    def windows(self) -> list[int]:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        listed = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
        return sorted(int(s.getPath().getName().partition("=")[2]) for s in listed if s.getPath().getName().startswith("window="))

    def _drop(self, windows: list[int]) -> None:
        for w in windows:
            where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/window={w}")
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def truncate(self, checkpoint: int) -> None:
        """Drops windows after the last one checkpointed, which will be written again."""
        self._drop([w for w in self.windows() if w > checkpoint])

    def clean(self, flushed: int) -> None:
        """Drops windows whose rows are in data files."""
        self._drop([w for w in self.windows() if w <= flushed])


def log_counters(log: DataFrame) -> DataFrame:
    """Counters of a log by bucket, and over all buckets (bucket null): puts, deletes, purges and bytes written."""

    def n(op: str) -> Column:
        return F.count(F.when(F.col("op") == op, True))

    size = F.sum(F.coalesce(F.octet_length("value"), F.lit(0)).cast("long"))
    return log.rollup("bucket").agg(n(PUT).alias("puts"), n(DELETE).alias("deletes"), n(PURGE).alias("purges"), size.alias("bytes"))


def io_counters(stats: DataFrame) -> DataFrame:
    """Counters summed by bucket, and over all buckets (bucket null)."""
    names = [c for c in stats.columns if c != "bucket"]
    return stats.rollup("bucket").agg(*[F.sum(n).alias(n) for n in names])
