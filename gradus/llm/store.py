"""Where intermediate tables of the operators are kept: the folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder and runs in one process, as in tests.
LOCAL_FOLDER = "/tmp/checkpoints"
_scopes: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of the session. On a cluster it has to be set, as executors do not share local folders."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return LOCAL_FOLDER


def settle(df: DataFrame) -> DataFrame:
    """Writes ``df`` once as a table in the shared folder and returns the table: later steps neither compute it again nor depend on
    what executors hold. Tables of one application lie under its id; ``clear`` deletes them."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    for scope in _scopes:
        scope.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Tables that ``settle`` writes inside are deleted at the end: what is made of them has to be written by then."""
    own: list[str] = []
    _scopes.append(own)
    try:
        yield
    finally:
        _scopes.remove(own)
        for path in own:
            remove(spark, path)


def drop(table: DataFrame) -> None:
    """Deletes a table that ``settle`` has written; nothing may read it later."""
    for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
        remove(table.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Deletes the tables that ``settle`` has written in this application."""
    remove(spark, f"{shared_folder(spark)}/{spark.sparkContext.applicationId}")
