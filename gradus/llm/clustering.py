"""k-means over whole-number vectors by sort-means.

Vectors lie in blocks, one row of arrays each: ids, components, and for each vector the centroid that it was dealt to last and the squared
distance to it. A round orders the other centroids by their distance from each centroid. A vector is scanned from its previous centroid on, in
that order, and its scan ends at the first centroid that is strictly more than twice as far from the previous one as the vector is: by the
triangle inequality neither that one nor any later one is nearer, and none is as near, so that ties are met and go to the smaller number.

Each block also keeps the number of its vectors and the sum of their components by centroid. Only these columns are read for the new centroids:
a row for each block, centroid and component, added up by Spark. What reaches the driver are k centroids; what goes to the tasks are these and
their k * k distances. Each round is written to the shared folder, and the round before it is deleted once the next is there.

Sums and distances are whole numbers, so that the result does not depend on how rows are dealt. Components beyond LARGEST raise an error, as
distances would not fit 64 bits.

Defined results: vectors that are null, that have not ``dim`` components or hold a null or a component that is not finite take no part; rows of
one id are vectors of their own; starting centroids of one hash come in order of their components, those without an id last (the start needs
an id, the clustering does not); fewer than k vectors give as many centroids; equal centroids: the smallest number takes all vectors, the others stay
empty where they are; an empty table gives an empty result; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradus.llm.store import drop, settle
from gradus.llm.topk import _usable

K, ROUNDS, SCALE = 16, 3, 64
#: Vectors of a block at most.
ROWS = 2048
#: The largest component by amount: with up to 256 components four times a squared distance fits 64 bits.
LARGEST = 1 << 25


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(-1)


def scan(x: np.ndarray, previous: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance) of the rows of ``x``, whose previous centroids are known."""
    between = squared(centroids[:, None], centroids[None])
    order = np.argsort(between, 1, kind="stable")
    near, least = previous.copy(), squared(x, centroids[previous])
    for p in np.unique(previous).tolist():
        rows = np.flatnonzero(previous == p)
        reach = 4 * least[rows]
        for j in order[p].tolist():
            going = reach >= between[p, j]
            rows, reach = rows[going], reach[going]
            if not len(rows):
                break
            if j != p:
                d = squared(x[rows], centroids[j])
                better = (d < least[rows]) | (d == least[rows]) & (j < near[rows])
                near[rows[better]], least[rows[better]] = j, d[better]
    return near, least


def _schema(id_type: T.DataType) -> T.StructType:
    longs = T.ArrayType(T.LongType())
    lists = [("ids", T.ArrayType(id_type)), ("components", longs), ("cluster", T.ArrayType(T.IntegerType())), ("distance", longs), ("counts", longs), ("sums", longs)]
    return T.StructType([T.StructField(n, t) for n, t in lists])


def _list(values: np.ndarray | pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))


def _block(ids: pa.Array, x: np.ndarray, near: np.ndarray, least: np.ndarray, k: int) -> pa.RecordBatch:
    counts, sums = np.bincount(near, minlength=k), np.zeros((k, x.shape[1]), np.int64)
    np.add.at(sums, near, x)
    columns = {"ids": ids, "components": x.ravel(), "cluster": near.astype(np.int32), "distance": least, "counts": counts.astype(np.int64), "sums": sums.ravel()}
    return pa.RecordBatch.from_pydict({n: _list(c) for n, c in columns.items()})


def blocks(vectors: DataFrame, dim: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """The usable vectors in blocks, as floor(scale * component), all dealt to centroid 0."""
    own = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, first, lengths = _usable(batch.column(1))
            good = np.flatnonzero(lengths == dim)
            for at in range(0, len(good), ROWS):
                some = good[at : at + ROWS]
                scaled = np.floor(scale * x[first[some][:, None] + np.arange(dim)])
                if np.abs(scaled).max(initial=0) > LARGEST:
                    raise ValueError("a component is too large for distances in 64 bits")
                n = np.zeros(len(some), np.int64)
                yield _block(batch.column(0).take(pa.array(some)), scaled.astype(np.int64), n, n, 1)

    return own.mapInArrow(run, _schema(own.schema["id"].dataType))


def dealt(held: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The blocks with each vector at its nearest centroid."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                part = batch.slice(i, 1)
                ids, x, previous = (part.column(c).flatten() for c in ("ids", "components", "cluster"))
                x = x.to_numpy().reshape(-1, dim)
                yield _block(ids, x, *scan(x, previous.to_numpy().astype(np.int64), centroids), k)

    return held.mapInArrow(run, held.schema)


def start(held: DataFrame, k: int, dim: int, seed: int = 1) -> np.ndarray:
    """The k vectors of the smallest SHA-256 of seed and id, in that order."""
    vector = F.explode(F.transform(F.sequence(F.lit(0), F.size("ids") - 1), lambda i: F.struct(F.get("ids", i).alias("id"), F.slice("components", i * dim + 1, F.lit(dim)).alias("v")))).alias("s")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("s.id").cast("string")).cast("binary"), 256)
    chosen = held.select(vector).select(key.alias("key"), "s.v").orderBy(F.asc_nulls_last("key"), "v").limit(k).collect()
    return np.array([r.v for r in chosen], np.int64).reshape(-1, dim)


def moved(held: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floor of the mean of each centroid's vectors; a centroid without vectors stays. k * dim sums come to the driver."""
    k, dim = centroids.shape
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    counts = {r.at: int(r.n) for r in held.select(F.posexplode("counts").alias("at", "c")).groupBy("at").agg(whole("c").alias("n")).collect()}
    out = centroids.copy()
    for r in held.select(F.posexplode("sums").alias("at", "c")).groupBy("at").agg(whole("c").alias("total")).collect():
        c, i = divmod(r["at"], dim)
        if counts[c]:
            out[c, i] = int(r.total) // counts[c]
    return out


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, scale: int = SCALE, dim: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """Rows (id_col, cluster, distance), one for each vector that takes part, and the centroids: ``rounds`` times all vectors go to their nearest
    centroid and the centroids to the mean, then the vectors are dealt once more."""
    held = settle(blocks(vectors, dim, scale, id_col, vector_col))
    centroids = start(held, k, dim)
    for i in range(rounds + 1) if len(centroids) else ():
        before, held = held, settle(dealt(held, centroids))
        drop(before)
        if i < rounds:
            centroids = moved(held, centroids)
    each = held.select(F.explode(F.arrays_zip("ids", "cluster", "distance")).alias("e"))
    return each.select(F.col("e.ids").alias(id_col), F.col("e.cluster").alias("cluster"), F.col("e.distance").alias("distance")), centroids
