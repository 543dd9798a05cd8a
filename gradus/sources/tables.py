"""Sources and sinks: one DataFrame with a split column for each dataset."""

from __future__ import annotations

import io
import os
import tarfile
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import groupby, islice
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.sources import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def json_files(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Files that are one JSON value each, or a list of rows: rows (file, and the columns of ``schema``)."""
    return spark.read.schema(schema).option("multiLine", True).json(paths).select(F.col("_metadata.file_name").alias("file"), "*")


def with_definitions(rows: DataFrame, definitions: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the columns of a side schema's rows of the same keys; rows that it does not define are left out."""
    return rows.join(definitions.dropDuplicates(keys), keys)


def separated(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True, quote: str = '"') -> DataFrame:
    """Text with separators; a quote inside quotes is doubled. An empty ``quote`` takes quotes as they stand."""
    return spark.read.option("sep", sep).option("header", header).option("quote", quote).option("escape", quote or "\\").schema(schema).csv(path)


def union(parts: list[DataFrame]) -> DataFrame:
    """All configurations of a source; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


#: Stores whose files tasks can open and read from any place on; archives elsewhere come whole through Spark's reader, in a row each.
SEEKABLE = ("file", "s3", "s3a", "gs", "hdfs", "abfs", "abfss")
LINES = "archive string, member string, line_no bigint, line string"


def seekable(path: str) -> BinaryIO:
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return open("/" + rest.lstrip("/"), "rb")
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path.replace("s3a:", "s3:", 1))
    return store.open_input_file(at)


def directory(found: DataFrame, suffix: str = "") -> DataFrame:
    """Rows (archive, member, at, size) of the files in the archives at ``path``: at is a place in a zip's directory or where a tar's file begins. A
    compressed tar has no places, it is one row without a member."""

    def listed(f: BinaryIO) -> Iterator[tuple[str | None, int, int]]:
        start = f.read(6)
        f.seek(0)
        if start[:2] == b"PK":
            with zipfile.ZipFile(f) as z:
                yield from ((x.filename, i, x.file_size) for i, x in enumerate(z.infolist()) if not x.is_dir() and x.filename.endswith(suffix))
        elif start[:2] == b"\x1f\x8b" or start[:3] == b"BZh" or start == b"\xfd7zXZ\0":
            yield None, -1, -1
        else:
            with tarfile.open(fileobj=f, mode="r:") as t:
                yield from ((x.name, x.offset_data, x.size) for x in t if x.isfile() and x.name.endswith(suffix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                with seekable(archive) as f:
                    rows = listed(f)
                    while some := list(islice(rows, 10_000)):
                        columns = [pa.array(c, t) for c, t in zip(zip(*some), (pa.string(), pa.int64(), pa.int64()))]
                        yield pa.RecordBatch.from_arrays([pa.array([archive] * len(some)), *columns], names=["archive", "member", "at", "size"])

    return found.select("path").mapInArrow(run, "archive string, member string, at bigint, size bigint")


def _lines(archive: str, member: str, f: BinaryIO) -> Iterator[pa.RecordBatch]:
    numbered = enumerate(io.TextIOWrapper(f, "utf-8-sig", "replace", newline="\n"))
    while some := list(islice(numbered, 10_000)):
        columns = [[archive] * len(some), [member] * len(some), [n for n, _ in some], [line.rstrip("\r\n") for _, line in some]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.string()))], names=["archive", "member", "line_no", "line"])


def _streamed(archive: str, f: BinaryIO, suffix: str) -> Iterator[pa.RecordBatch]:
    """All files of an archive, one after the other."""
    if f.read(2) == b"PK":
        f.seek(0)
        with zipfile.ZipFile(f) as z:
            for x in z.infolist():
                if not x.is_dir() and x.filename.endswith(suffix):
                    with z.open(x) as own:
                        yield from _lines(archive, x.filename, own)
    else:
        f.seek(0)
        with tarfile.open(fileobj=f, mode="r|*") as t:
            for x in t:
                if x.isfile() and x.name.endswith(suffix):
                    yield from _lines(archive, x.name, io.BufferedReader(_Part(t.extractfile(x), x.size)))


class _Part(io.RawIOBase):
    """So many bytes of a file, from where it stands."""

    def __init__(self, f: BinaryIO, size: int):
        self.f, self.left = f, size

    def readable(self) -> bool:
        return True

    def readinto(self, buffer: bytearray) -> int:
        data = self.f.read(min(len(buffer), self.left))
        buffer[: len(data)] = data
        self.left -= len(data)
        return len(data)


def members(spark: SparkSession, path: str, suffix: str = "", tasks: int | None = None) -> DataFrame:
    """Rows (archive, member, line_no, line): the lines of the files in zip, tar and compressed tar archives whose names end in ``suffix``, a leading byte
    order mark left out, bytes that are no UTF-8 replaced.

    The files of an archive, as its directory lists them, are dealt to ``tasks`` tasks (as many as there are shuffle partitions). A task seeks to its
    files and reads them line by line, whatever the size of file or archive. A compressed tar is read from its start on by one task. In a store that tasks
    cannot open (see SEEKABLE) an archive is a task's work too, and has to fit a row (2 GB)."""
    found = spark.read.format("binaryFile").load(path)
    schemes = [r[0] for r in found.select(F.substring_index("path", ":", 1)).distinct().collect()]

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, rows in groupby(zip(*(batch.column(c).to_pylist() for c in ("archive", "member", "at", "size"))), key=lambda r: r[0]):
                with seekable(archive) as f:
                    is_zip = f.read(2) == b"PK"
                    z = zipfile.ZipFile(f) if is_zip else None
                    for _, member, at, size in rows:
                        if is_zip:
                            with z.open(z.infolist()[at]) as own:
                                yield from _lines(archive, member, own)
                        elif member is None:
                            f.seek(0)
                            yield from _streamed(archive, f, suffix)
                        else:
                            f.seek(at)
                            yield from _lines(archive, member, io.BufferedReader(_Part(f, size)))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from _streamed(archive, io.BytesIO(content.as_py()), suffix)

    if not set(schemes) <= set(SEEKABLE):
        return found.select("path", "content").mapInArrow(whole, LINES)
    n = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = directory(found, suffix).repartition(n, "archive", "at").sortWithinPartitions("archive", "at")
    return dealt.mapInArrow(opened, LINES)


def zipped(files: DataFrame, path: str, archive: str, member: Column, body: str) -> None:
    """Writes zip archives ``<path>/<archive>.zip`` with a file for each row, a task for each archive. ``path`` is one of a store that tasks can open as files."""
    at = path.removeprefix("file:")
    own = files.select(F.col(archive).cast("string").alias("archive"), member.alias("member"), F.col(body).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(at, exist_ok=True)
        rows = ((r["archive"], r["member"], r["body"]) for b in batches for r in b.to_pylist())
        for name, some in groupby(rows, key=lambda r: r[0]):
            new = f"{at}/.{uuid.uuid4().hex}"
            with zipfile.ZipFile(new, "w", zipfile.ZIP_DEFLATED) as z:
                for _, inside, text in some:
                    z.writestr(inside, text or "")
            os.replace(new, f"{at}/{name}.zip")
            yield pa.RecordBatch.from_pydict({"archive": [name]})

    own.repartition("archive").sortWithinPartitions("archive", "member").mapInArrow(run, "archive string").count()


def json_members(spark: SparkSession, path: str, schema: str, suffix: str = ".jsonl") -> DataFrame:
    """JSON lines in archives: rows (member, and the columns of ``schema``)."""
    lines = members(spark, path, suffix).where(F.trim("line") != "")
    return lines.select("member", F.from_json("line", schema).alias("j")).select("member", "j.*")


def configurations(spark: SparkSession, paths: dict[str, str], skipped: tuple[str, ...] = ()) -> DataFrame:
    """All configurations of a source but the skipped ones, with a config column."""
    return union([spark.read.parquet(p).withColumn("config", F.lit(c)) for c, p in sorted(paths.items()) if c not in skipped])


def save(samples: DataFrame, path: str) -> None:
    """Builds the datasets that ``samples`` has, beside those at ``path`` that it has not; one that is there already is built anew.

    A build is a folder of its own, partitioned by dataset and split, so that a split is read alone. Once it is written, the manifest gets a file with a
    row for each of its datasets and splits (n = 0 for an empty split, so that reading it does not fail) and a version above all others. The rows of a dataset's
    last version say which build stands: until that file is there, and if a build fails, readers find the build before. One build at a time writes to a path."""
    spark = samples.sparkSession
    build = uuid.uuid4().hex
    samples.write.partitionBy("dataset", "split").parquet(f"{path}/builds/{build}")
    written = spark.read.schema(samples.schema).parquet(f"{path}/builds/{build}")
    splits = F.explode(F.array(*[F.lit(s) for s in ("train", "validation", "test")])).alias("split")
    n = written.groupBy("dataset", "split").agg(F.count("*").alias("n"))
    every = n.select("dataset").distinct().select("dataset", splits)
    rows = every.join(n, ["dataset", "split"], "full").fillna(0, ["n"])
    version = 1 + (_versions(spark, path).agg(F.max("version")).first()[0] or 0 if scratch.exists(spark, f"{path}/manifest") else 0)
    rows.withColumns({"build": F.lit(build), "version": F.lit(version).cast("long")}).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def _versions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("dataset string, split string, n bigint, build string, version bigint").parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows (dataset, split, n, build, version) of the builds that stand."""
    rows = _versions(spark, path)
    last = rows.groupBy(F.col("dataset").alias("m_dataset")).agg(F.max("version").alias("m_version"))
    return rows.join(last, (F.col("dataset") == F.col("m_dataset")) & (F.col("version") == F.col("m_version"))).select(*rows.columns)


def load(spark: SparkSession, path: str, dataset: str, split: str) -> DataFrame:
    """The rows of a dataset's split. One that was never built is an error."""
    return load_all(spark, path, [dataset]).where(F.col("split") == split)


def load_all(spark: SparkSession, path: str, datasets: Sequence[str] | None = None) -> DataFrame:
    """The rows of the named datasets, of all if none are named: of each build its datasets that stand. Builds are as many as ``save`` was called, less what
    later builds replaced."""
    standing = manifest(spark, path).where(F.lit(True) if datasets is None else F.col("dataset").isin(*datasets)).select("build", "dataset").distinct().collect()
    if missing := sorted(set(datasets or ()) - {r.dataset for r in standing}):
        raise ValueError(f"not built: {', '.join(missing)}")
    if not standing:
        raise ValueError(f"nothing is built at {path}")
    builds: dict[str, list[str]] = {}
    for r in standing:
        builds.setdefault(r.build, []).append(r.dataset)
    return union([spark.read.parquet(f"{path}/builds/{b}").withColumns({c: F.col(c).cast("string") for c in ("dataset", "split")}).where(F.col("dataset").isin(*own)) for b, own in sorted(builds.items())])


def sweep(spark: SparkSession, path: str) -> list[str]:
    """Deletes the builds of which no dataset stands, failed ones among them, and gives their names. Readers that began before may still need them."""
    standing = {r.build for r in manifest(spark, path).select("build").distinct().collect()}
    gone = [b for b in scratch.listed(spark, f"{path}/builds") if b not in standing]
    for b in gone:
        scratch.remove(spark, f"{path}/builds/{b}")
    return gone
