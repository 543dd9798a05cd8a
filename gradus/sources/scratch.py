"""Tables between two steps, in the folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder and runs in one process, as in tests.
LOCAL_FOLDER = "/tmp/checkpoints"


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, below the application's id."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not named and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(named or LOCAL_FOLDER).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table that is written once, so that later steps neither compute it again nor depend on what executors hold."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, store = _at(spark, path)
    return store.exists(at)


def listed(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder."""
    at, store = _at(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(at))


def put(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file under its own name, wherever Spark keeps files; never half of it."""
    at, store = _at(spark, path)
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
    out = store.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    store.delete(at, False)
    store.rename(new, at)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder wherever Spark keeps it; one that is not there is no error."""
    at, store = _at(spark, path)
    store.delete(at, True)


def clear(spark: SparkSession) -> None:
    """Deletes what this application has written here."""
    remove(spark, folder(spark, "").rpartition("/")[0])
