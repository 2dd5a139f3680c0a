"""Session defaults and table access shared by the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Settings that every rollgrid session wants; a caller's own settings win.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str = "local[*]", app: str = "rollgrid", **conf: str) -> SparkSession:
    """A session with the library's defaults; keyword settings use ``__`` for dots."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory, through Spark's readers only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
