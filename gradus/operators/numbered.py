"""Operators on one global order: gapless row numbers, draws by number, the rows of smallest hash, batches of one fold over all rows.

No step has a task for all rows, nor one for all rows of a dataset. The order is a range sort, written as a table whose rows know their range and
their place in it; what is known of whole ranges is a row for each range.
"""

from __future__ import annotations

import random
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradus.sources import scratch

#: Parts that the values of a hash are dealt to when the smallest are looked for: hexadecimal digits of its start.
DIGITS = 3


def ranged(rows: DataFrame, *order: Column | str) -> DataFrame:
    """``rows`` as a written table in ``order``, with n_part, the range, and n_at, the place in it from 0. Ranges are in order, but rows of equal
    order are not dealt to several of them, so the order should end with what tells rows apart."""
    in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return scratch.written(ordered.withColumns({"n_part": F.spark_partition_id(), "n_at": in_task}), "ranged")


def numbered(rows: DataFrame, *order: Column | str) -> DataFrame:
    """``rows`` with number, from 0 without a gap, in ``order``: a prefix sum of the ranges' counts, and a row's place in its range."""
    held = ranged(rows, *order)
    before = Window.partitionBy(F.lit(0)).orderBy("n_part").rowsBetween(Window.unboundedPreceding, -1)
    first = held.groupBy("n_part").agg(F.count("*").alias("n")).withColumn("n_first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return held.join(F.broadcast(first), "n_part").withColumn("number", F.col("n_first") + F.col("n_at")).drop("n_part", "n_at", "n_first")  # a row for each task that wrote


@F.pandas_udf(T.ArrayType(T.LongType()))
def _drawn(sizes: pd.Series, most: pd.Series, seeds: pd.Series) -> pd.Series:
    return pd.Series([random.Random(int(s)).sample(range(int(n)), int(m)) for n, m, s in zip(sizes, most, seeds)], dtype=object)


def sampled(samples: DataFrame, most: int, keys: Sequence[str] = ("dataset", "split"), order: str = "pos", seed: int = 0) -> DataFrame:
    """At most ``most`` rows of each of ``keys``, those that a seeded generator draws out of range(n), for builds that have to repeat earlier ones
    exactly: rows are numbered in ``order``, and the drawn numbers, ``most`` for each of the keys, are joined to them. The generator runs once for each of the keys."""
    own = numbered(samples, *keys, order, F.xxhash64(*samples.columns))
    groups = own.groupBy(*keys).agg(F.min("number").alias("first"), F.count("*").alias("n"))
    told = [F.col(k).alias(f"k_{k}") for k in keys]
    small = groups.where(F.col("n") <= most).select(*told)
    drawn = groups.where(F.col("n") > most).select("first", F.explode(_drawn("n", F.lit(most), F.lit(seed))).alias("at")).select((F.col("first") + F.col("at")).alias("drawn"))
    same = [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in keys]
    kept = own.join(small, same, "left_semi").unionByName(own.join(drawn, F.col("number") == F.col("drawn"), "left_semi"))
    return kept.select(*samples.columns)


def smallest(rows: DataFrame, keys: Sequence[str], h: Column, most: int, tie: str) -> DataFrame:
    """Of each of ``keys`` the ``most`` rows of smallest ``h``, a hexadecimal hash, then ``tie``. Rows are counted by the hash's first digits, 16**DIGITS numbers
    for each of the keys at most; that tells below which start all rows are in and in which one the last are. Only rows up to that one move, those of one start together."""
    start = F.substring("s_h", 1, DIGITS)
    own = rows.withColumn("s_h", h)
    counts = own.groupBy(*[F.col(k).alias(f"k_{k}") for k in keys], start.alias("s_start")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*[f"k_{k}" for k in keys]).orderBy("s_start"))
    last = counts.withColumn("s_upto", upto).groupBy(*[f"k_{k}" for k in keys]).agg(F.min(F.when(F.col("s_upto") >= most, F.struct("s_start", (most - F.col("s_upto") + F.col("n")).alias("left")))).alias("s_last"))
    near = own.join(last, [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in keys]).withColumn("s_start", start).where(F.col("s_last").isNull() | (F.col("s_start") <= F.col("s_last.s_start")))
    placed = near.withColumn("s_n", F.row_number().over(Window.partitionBy(*keys, "s_start").orderBy("s_h", tie)))
    return placed.where(F.col("s_last").isNull() | (F.col("s_start") < F.col("s_last.s_start")) | (F.col("s_n") <= F.col("s_last.left"))).select(*rows.columns)


def following(lengths: list[int], budget: int) -> list[int]:
    """For each place the one where the next batch begins if a batch begins here. These only grow, so that both ends of a batch go forward once;
    the window's longest row is the first of a queue of rows that no later one passes."""
    out, queue, j = [], deque(), 0
    for i, length in enumerate(lengths):
        if j <= i:
            queue, j = deque([i]), i + 1
        while j < len(lengths) and max(lengths[queue[0]], lengths[j]) * (j - i + 1) <= budget:
            while queue and lengths[queue[-1]] <= lengths[j]:
                queue.pop()
            queue.append(j)
            j += 1
        out.append(j)
        if queue[0] == i:
            queue.popleft()
    return out


def summed_up(lengths: list[int], budget: int) -> tuple[list[int], list[int], list[int], list[int]]:
    """A range as a function of the batch that is open before it. Whatever that holds, it closes within the rows that a batch from here on could
    hold, or with the row after these: their lengths, and, for a batch that begins at each of them, how many batches begin from there on, and rows and
    longest row of the last one."""
    after = following(lengths, budget)
    room = after[0] + 1
    begun, last = [0] * (len(lengths) + 1), list(range(len(lengths)))
    for i in range(len(lengths) - 1, -1, -1):
        begun[i] = begun[after[i]] + 1
        if after[i] < len(lengths):
            last[i] = last[after[i]]
    longest = {i: max(lengths[i:]) for i in set(last[:room])}
    return lengths[:room], begun[: min(room, len(lengths))], [len(lengths) - i for i in last[:room]], [longest[i] for i in last[:room]]


def batches(samples: DataFrame, size: str, budget: int, *order: Column | str) -> DataFrame:
    """``samples`` with batch: one fold over all rows in ``order`` (by ``size``, if none is given), where a batch closes before the row with which its
    longest row times its rows would pass ``budget``. A row without a size takes no room.

    The fold's state crosses from range to range. Each range is first summed up as a function of the state that it gets, which takes
    as many numbers as a batch has rows; a task goes through these sums, some thousandths of the rows, one after the other and tells each range its state and its first batch's number;
    then the ranges are folded, each by itself."""
    length = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long"))
    held = ranged(samples.withColumn("n_length", length), *(order or (F.asc_nulls_first(size), F.xxhash64(*samples.columns))))
    together = lambda df: df.repartition("n_part").sortWithinPartitions("n_part", "n_at")
    longs = "array<long>"

    def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
        now, parts = None, []
        for b in batches:
            numbers = b.column("n_part").to_numpy()
            cuts = np.flatnonzero(np.diff(numbers)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(numbers)]):
                if hi > lo:
                    if numbers[lo] != now and parts:
                        yield now, parts
                        parts = []
                    now = int(numbers[lo])
                    parts.append(b.slice(lo, hi - lo))
        if parts:
            yield now, parts

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in by_range(batches):
            told = summed_up(np.concatenate([b.column("n_length").to_numpy() for b in own]).tolist(), budget)
            yield pa.RecordBatch.from_pydict({"n_part": pa.array([part], pa.int32()), **{k: pa.array([v], pa.list_(pa.int64())) for k, v in zip(("first", "begun", "rows", "longest"), told)}})

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, n, longest = -1, 0, 0  # of the open batch
        for b in batches:
            for row in b.to_pylist():
                yield pa.RecordBatch.from_pydict({"n_part": pa.array([row["n_part"]], pa.int32()), "s_batch": [number], "s_rows": [n], "s_longest": [longest]})
                i = 0
                while i < len(row["first"]) and n and max(longest, row["first"][i]) * (n + 1) <= budget:
                    n, longest, i = n + 1, max(longest, row["first"][i]), i + 1
                if i < len(row["begun"]):
                    number, n, longest = number + row["begun"][i], row["rows"][i], row["longest"][i]

    names = held.columns
    schema = T.StructType([*held.schema.fields, T.StructField("batch", T.LongType())])
    states = together(held.select("n_part", "n_at", "n_length")).mapInArrow(summed, f"n_part int, first {longs}, begun {longs}, rows {longs}, longest {longs}")
    states = states.repartition(1).sortWithinPartitions("n_part").mapInArrow(composed, "n_part int, s_batch long, s_rows long, s_longest long")
    begun = scratch.written(states, "states")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, n, longest = None, -1, 0, 0
        for b in batches:
            out = []
            for part, length, s_batch, s_rows, s_longest in zip(*(b.column(c).to_pylist() for c in ("n_part", "n_length", "s_batch", "s_rows", "s_longest"))):
                if part != now:
                    now, number, n, longest = part, s_batch, s_rows, s_longest
                if not n or max(longest, length) * (n + 1) > budget:
                    number, n, longest = number + 1, 0, 0
                n, longest = n + 1, max(longest, length)
                out.append(number)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(out, pa.int64())], names=[*names, "batch"])

    told = together(held.join(F.broadcast(begun), "n_part").select(*names, "s_batch", "s_rows", "s_longest"))  # a row for each range
    return told.mapInArrow(run, schema).select(*samples.columns, "batch")
