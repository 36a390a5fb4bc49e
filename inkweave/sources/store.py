"""Derived tables, written once for each folder of inputs and session, and read by all queries after that.

The graph is derived state: it is built from its sources and then queried many times.  The tables go to the folder named
in spark.checkpoint.dir, which the driver and all executors share.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_paths: dict[tuple[str, str, str], tuple[str, object]] = {}


def _base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.gettempdir() + "/inkweave-checkpoints"


def stored(spark: SparkSession, source: str, name: str, make: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
    """The table that make gives for a source folder, written by the first call of a session; by: a column to partition on.

    A source that changes needs ``forget``.
    """
    key = (spark.sparkContext.applicationId, source, name)
    if key not in _paths:
        df, path = make(), f"{_base(spark)}/inkweave-store-{uuid.uuid4().hex}"
        out = df.write.option("compression", "zstd")
        (out.partitionBy(by) if by else out).parquet(path)
        _paths[key] = path, df.schema
    path, schema = _paths[key]
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def written(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df, written now and read from then on, so that its size is known and it is made once."""
    path = f"{_base(spark)}/inkweave-store-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def folder(spark: SparkSession, source: str, name: str) -> str:
    """A folder of this session for a derived structure of a source folder; empty when it is first asked for."""
    key = (spark.sparkContext.applicationId, source, name)
    if key not in _paths:
        _paths[key] = f"{_base(spark)}/inkweave-store-{uuid.uuid4().hex}", None
    return _paths[key][0]


def forget(source: str) -> None:
    """The tables of a source folder are built anew when they are next asked for."""
    for key in [k for k in _paths if k[1] == source]:
        del _paths[key]
