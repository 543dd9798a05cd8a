"""Selecting and batching built samples."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradus.functions import row
from gradus.operators.numbered import smallest


def limited(samples: DataFrame, most: int) -> DataFrame:
    """Rows with two options or more; of a larger dataset the ``most`` of smallest hash of content."""
    h = row.sha1(F.concat(F.coalesce(F.nullif("state", F.lit("")), "question"), F.lit(":"), "question"))
    return smallest(samples.where(F.size("options") >= 2), ("dataset",), h, most, "pos")


def capped_items(samples: DataFrame, most: int, fits: Column | None = None) -> DataFrame:
    """Of each dataset the ``most`` rows of smallest hash of content, and of these the ones with two options or more that fit: the cap comes first,
    so that every run scores rows out of the same ones."""
    h = row.sha1(F.concat(F.coalesce(F.nullif("state", F.lit("")), "question"), F.lit(":"), "question"))
    return smallest(samples, ("dataset",), h, most, "pos").where((F.size("options") >= 2) & (F.lit(True) if fits is None else fits))


def weights(samples: DataFrame, alpha: float = 0.5) -> DataFrame:
    """Rows (dataset, n, weight): the weight of each row of a dataset, n**alpha / n."""
    return samples.groupBy("dataset").agg(F.count("*").alias("n")).withColumn("weight", F.pow("n", F.lit(alpha)) / F.col("n"))


def packed(samples: DataFrame, size: str, budget: int, rows: int = 100_000, order: Column | None = None) -> DataFrame:
    """Adds shard and batch. There is a shard for every ``rows`` rows, 8 at least. Inside a shard rows come by size, or
    by ``order`` if it is given, and a batch closes where its longest row times its rows would pass
    ``budget``. Sequential by nature: a fold over a sorted shard, which streams."""
    schema = T.StructType([*samples.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("batch", T.LongType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, n, longest = None, 0, 0, 0
        for b in batches:
            out = []
            for s, length in zip(b.column("shard").to_pylist(), b.column(size).to_pylist()):
                length = length or 0  # a row without a size takes no room
                if s != shard:
                    shard, number, n, longest = s, 0, 0, 0
                if n and max(longest, length) * (n + 1) > budget:
                    number, n, longest = number + 1, 0, 0
                n, longest = n + 1, max(longest, length)
                out.append(number)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=schema.names)

    shards = max(8, -(-samples.count() // rows))
    spread = samples.withColumn("shard", row.bucket(F.concat(F.lit("shard:"), F.coalesce(F.col(samples.columns[0]).cast("string"), F.lit(""))), shards))
    return spread.repartition(shards, "shard").sortWithinPartitions("shard", F.col(size) if order is None else order, *samples.columns[:1]).mapInArrow(fold, schema)


def epoch(samples: DataFrame, row_id: str, size: str, budget: int, number: int, seed: str = "0") -> DataFrame:
    """One pass over all rows in an order of its own: every row in one batch, batches within ``budget`` as in :func:`packed`."""
    return packed(samples, size, budget, order=row.sha1(F.concat(F.lit(f"epoch:{seed}:{number}:"), F.col(row_id).cast("string"))))


def predicted(samples: DataFrame, predict) -> DataFrame:
    """Adds probs: ``predict`` takes lists of (state, question, option texts) and gives a list of probabilities for each."""
    schema = T.StructType([*samples.schema.fields, T.StructField("probs", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(b.column("state").to_pylist(), b.column("question").to_pylist(), [[o["text"] for o in x] for x in b.column("options").to_pylist()]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(predict(rows), pa.list_(pa.float64()))], names=schema.names)

    return samples.mapInArrow(run, schema)
