"""Helpers shared by the operators: checkpoints, row keys and Arrow batches."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sorts after every doc_id; stands for a null one where rows need an order.
NULL_ID_LAST = 2**63 - 1


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster's shared folder; one of this machine only where all of Spark runs in this process."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="rollgrid-checkpoints-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Written to the checkpoint folder now; later reads survive lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A function that writes a table, compressed, to the shared folder and reads it again; all go at the end."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/tables-{uuid4()}"

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    try:
        yield keep
    finally:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def order_id(doc_id: str | Column = "doc_id") -> Column:
    """A never-null form of an integer id: nulls come last."""
    return F.coalesce(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit(NULL_ID_LAST)).cast("long")


def text_key(text: str | Column = "text") -> Column:
    """A 64-bit digest that tells apart rows of one id; null and empty differ."""
    return F.xxhash64(F.col(text) if isinstance(text, str) else text)


_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Sends this package to the executors, once a context; their Python workers import it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="rollgrid-code-"), "rollgrid-code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


_built: dict[str, object] = {}


def once(key: str, build):
    """What build() gives, made once in a worker process for each key.

    A key is "group/part"; what other groups have left is dropped first, so that a
    worker holds no more than the operator that runs needs.
    """
    group = key.partition("/")[0]
    for other in [k for k in _built if k.partition("/")[0] != group]:
        del _built[other]
    if key not in _built:
        _built[key] = build()
    return _built[key]
