"""Exact top-k search by inner product, with the three phases of a uniform threshold.

Vectors are packed into blocks, and a stated query set, packed likewise, meets every block of rows once. A score is the sum of partial
scores over m segments of the dimensions; each segment of a block is one local list.

1. One block in FIRST gathers, for each query, the k best of each local list, sums their scores exactly and passes on the k best. The
   k-th best of any blocks is a lower bound of the k-th best score there is.
2. That bound is the safe cutoff t. It goes to all blocks with the queries. An entry can only belong to the result if one of its
   partial scores is t / m or more; these entries are sufficient and are collected, the rest are never scored in full. A query without
   a bound (fewer than k entries so far) collects all.
3. The collected entries' remaining partial scores are added, those of t or more leave the block, and the best k are taken. The k-th best
   of the blocks that a task has seen is a bound too and raises t for those that follow.

So partial scores of all queries and rows are computed once, and those of one block in FIRST once more.

Rows and queries are dealt to the cells of a grid: each block of queries goes to every share of the rows, each block of rows to every group of
queries. A task holds the queries of a cell, HELD bytes of them on average, and the rows stream by. Both are shuffled; nothing is broadcast, as
the copies of the queries grow with the shares.

Partial and whole scores are integers, so all comparisons are exact: products run in float32 while every sum of a segment stays below 2**24, in
float64 below 2**53, else in int64. Scores beyond int64 raise an error.

Defined results: vectors that are null, or hold a null or a component that is not finite, take no part; a null id takes no part; rows
whose ids are equal are rows of their own: each query row has its own result, and meets all rows but itself; a query with fewer than k
others gets all of them; ties go to the smaller id; only vectors of equal length are compared; an empty vector has score 0 with others; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.llm.store import settle

#: Vectors of a packed block of rows and of queries; a pair of blocks is what a task holds.
ROWS, QUERIES, SEGMENTS = 1024, 512, 4
#: Of so many blocks one is looked at for the cutoffs.
FIRST = 8
#: Bytes of queries in a cell, on average; cells, unless the rows' bytes are so many times those of the queries.
HELD, CELLS = 1 << 24, 256
SCALE = 1024
LEAST = -(1 << 63)


def _usable(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all components, first, length) of the lists of an Arrow array; length -1 where a list takes no part."""
    flat = values.flatten()
    lengths = np.nan_to_num(pa.compute.list_value_length(values).cast(pa.float64()).to_numpy(zero_copy_only=False), nan=0).astype(np.int64)
    first = np.cumsum(lengths) - lengths
    x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = np.append(0, np.cumsum(~np.isfinite(x)))
    ok = (bad[first + lengths] == bad[first]) & np.asarray(values.is_valid())
    return x, first, np.where(ok, lengths, -1)


def packed(vectors: DataFrame, most: int) -> DataFrame:
    """From (row, id, asked, vector): rows (dim, rows, ids, asked, data), all but dim BINARY: blocks of ``most`` vectors at most of one length, as
    floor(1024 * x) in the narrowest integers that hold the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}

        def block(dim: int) -> pa.RecordBatch:
            rows, ids, asked, data = (np.concatenate(c) for c in zip(*held.pop(dim)))
            rows, ids, asked, data = (c.tobytes() for c in (rows, ids, asked, _narrow(data)))
            return pa.RecordBatch.from_pydict({"dim": [dim], "rows": [rows], "ids": [ids], "asked": [asked], "data": [data]})

        for batch in batches:
            x, first, lengths = _usable(batch.column(3))
            numbers, ids = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            asked = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for dim in np.unique(lengths[lengths >= 0]).tolist():
                own = np.flatnonzero(lengths == dim)
                scaled = np.floor(SCALE * x[first[own][:, None] + np.arange(dim)])
                if np.abs(scaled).max(initial=0) >= 2.0**62:
                    raise ValueError("a component is too large for scores in 64 bits")
                for at in range(0, len(own), most):
                    some = own[at : at + most]
                    held.setdefault(dim, []).append((numbers[some], ids[some], asked[some], scaled[at : at + most].astype(np.int64)))
                    if sum(len(p[0]) for p in held[dim]) >= most:
                        yield block(dim)
        for dim in list(held):
            yield block(dim)

    return vectors.mapInArrow(run, "dim long, rows binary, ids binary, asked binary, data binary")


def _queries(blocks: DataFrame, most: int) -> DataFrame:
    """Rows (q_block, dim, q_rows, q_ids, q_data): the vectors asked for, ``most`` in a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}

        def out(dim: int) -> Iterator[pa.RecordBatch]:
            rows, ids, data = (np.concatenate(c) for c in zip(*held.pop(dim)))
            for at in range(0, len(rows), most):
                own = [c[at : at + most].tobytes() for c in (rows, ids, data)]
                yield pa.RecordBatch.from_pydict({"dim": [dim], "q_rows": [own[0]], "q_ids": [own[1]], "q_data": [own[2]]})

        for batch in batches:
            for row in batch.to_pylist():
                asked = np.flatnonzero(np.frombuffer(row["asked"], bool))
                if len(asked):
                    rows, ids = (np.frombuffer(row[c], np.int64)[asked] for c in ("rows", "ids"))
                    parts = held.setdefault(row["dim"], [])
                    parts.append((rows, ids, _matrix(row["data"], row["dim"], len(row["asked"]))[asked]))
                    if sum(len(p[0]) for p in parts) >= most:
                        yield from out(row["dim"])
        for dim in list(held):
            yield from out(dim)

    found = blocks.mapInArrow(run, "dim long, q_rows binary, q_ids binary, q_data binary")
    return found.select(F.sha2("q_rows", 256).alias("q_block"), "*")


def _narrow(x: np.ndarray) -> np.ndarray:
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _matrix(data: bytes, dim: int, n: int) -> np.ndarray:
    """The width of the integers is told by the length."""
    return np.frombuffer(data, f"i{len(data) // (n * dim)}" if n * dim else np.int64).reshape(n, dim)


def _largest(x: np.ndarray) -> float:
    return max(-float(x.min(initial=0)), float(x.max(initial=0)))


class _Side:
    """The vectors of a block, in whatever numbers their products are taken."""

    def __init__(self, data: bytes, dim: int, n: int):
        self.x, self.kinds = _matrix(data, dim, n), {}
        self.largest = _largest(self.x)

    def of(self, kind: type) -> np.ndarray:
        if kind not in self.kinds:
            self.kinds[kind] = self.x.astype(kind)
        return self.kinds[kind]


def _partials(q: _Side, x: _Side, segments: int) -> Iterator[np.ndarray]:
    """Partial scores of all queries and rows, one segment of the dimensions after the other."""
    dim = q.x.shape[1]
    most = q.largest * x.largest
    if most * max(1, dim) >= 2.0**63:
        raise ValueError("scores may not fit 64 bits")
    kind = np.float32 if most * -(-dim // segments) < 2.0**24 else np.float64 if most * dim < 2.0**53 else np.int64
    for j in range(segments):
        own = slice(dim * j // segments, dim * (j + 1) // segments)
        yield q.of(kind)[:, own] @ x.of(kind)[:, own].T


class _Queries:
    """A block of queries, and the best of the rows that it has met: scores and ids by query, the best first, LEAST where there are fewer than k."""

    def __init__(self, row: dict, k: int):
        self.rows, self.ids = (np.frombuffer(row[c], np.int64) for c in ("rows", "ids"))
        self.side = _Side(row["data"], row["dim"], len(self.rows))
        self.cutoffs = np.full(len(self.rows), LEAST) if row["cutoffs"] is None else np.frombuffer(row["cutoffs"], np.int64).copy()
        self.scores, self.found = np.full((len(self.rows), k), LEAST), np.zeros((len(self.rows), k), np.int64)
        self.n = np.zeros(len(self.rows), np.int64)

    def local_lists(self, x_rows: np.ndarray, _ids: np.ndarray, x: _Side, k: int, segments: int) -> None:
        """Phase 1. What counts is the k best scores; the ids of the entries are not kept."""
        parts = list(_partials(self.side, x, segments))
        own = self.rows[:, None] == x_rows[None, :]
        top = np.sort(np.concatenate([np.argpartition(p, -k, axis=1)[:, -k:] for p in parts], axis=1) if len(x_rows) > k else np.broadcast_to(np.arange(len(x_rows)), own.shape), axis=1)
        scores = sum(np.take_along_axis(p, top, 1).astype(np.int64) for p in parts)
        scores[np.take_along_axis(own, top, 1)] = LEAST
        scores[:, 1:][top[:, 1:] == top[:, :-1]] = LEAST
        self.scores = ~np.sort(~np.concatenate([self.scores, scores], 1), axis=1)[:, :k]
        self.n = (self.scores > LEAST).sum(1)

    def sufficient(self, x_rows: np.ndarray, x_ids: np.ndarray, x: _Side, k: int, segments: int) -> None:
        """Phases 2 and 3."""
        parts = list(_partials(self.side, x, segments))
        # some partial score is at least the mean, rounded up as all are integers; the least integer can not be negated
        floor = (self.cutoffs // segments + (self.cutoffs % segments > 0))[:, None]
        if parts[0].dtype != np.int64:
            floor = np.clip(floor, -(2**53), 2**53) if parts[0].dtype == np.float64 else np.clip(floor, -(2**24), 2**24)  # partial scores lie between
        some = np.zeros(parts[0].shape, bool)
        for p in parts:
            some |= p >= floor.astype(p.dtype)
        i, j = np.nonzero(some)
        scores = sum(p[i, j].astype(np.int64) for p in parts)
        full = (scores >= self.cutoffs[i]) & (self.rows[i] != x_rows[j])
        i, scores, ids = i[full], scores[full], x_ids[j[full]]
        if not len(i):
            return
        met = np.unique(i)
        held = np.repeat(met, self.n[met])
        place = np.arange(len(held)) - np.repeat(np.cumsum(self.n[met]) - self.n[met], self.n[met])
        i, scores, ids = np.append(i, held), np.append(scores, self.scores[held, place]), np.append(ids, self.found[held, place])
        order = np.lexsort((ids, ~scores, i))
        i, scores, ids = i[order], scores[order], ids[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        i, scores, ids, rank = (c[rank < k] for c in (i, scores, ids, rank))
        self.scores[i, rank], self.found[i, rank] = scores, ids
        self.n[met] = np.searchsorted(i, met, "right") - np.searchsorted(i, met)
        whole = met[self.n[met] == k]
        self.cutoffs[whole] = np.maximum(self.cutoffs[whole], self.scores[whole, k - 1])

    def best(self) -> pa.RecordBatch:
        i = np.repeat(np.arange(len(self.rows)), self.n)
        place = np.arange(len(i)) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (self.rows[i], self.ids[i], self.found[i, place], self.scores[i, place])], names=["q_row", "query_id", "vec_id", "score"])


def _met(cells: DataFrame, n: int, work, k: int, segments: int) -> DataFrame:
    """Rows (q_row, query_id, vec_id, score): the k best that ``work`` finds for each query in each cell. A cell's queries come before its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, queries = None, {}  # by dimension
        for batch in batches:
            for at in range(len(batch)):
                row = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
                if row["cell"] != now:
                    for q in sum(queries.values(), []):
                        yield q.best()
                    now, queries = row["cell"], {}
                if row["asks"]:
                    queries.setdefault(row["dim"], []).append(_Queries(row, k))
                elif row["dim"] in queries:
                    x_rows, x_ids = (np.frombuffer(row[c], np.int64) for c in ("rows", "ids"))
                    x = _Side(row["data"], row["dim"], len(x_rows))
                    for q in queries[row["dim"]]:
                        work(q, x_rows, x_ids, x, k, segments)
        for q in sum(queries.values(), []):
            yield q.best()

    dealt = cells.repartitionById(n, F.col("cell").cast("int")).sortWithinPartitions("cell", F.desc("asks"))
    return dealt.mapInArrow(run, "q_row long, query_id long, vec_id long, score long")


def _cells(blocks: DataFrame, asked: DataFrame, shares: int, groups: int) -> DataFrame:
    """Rows (cell, asks, dim, rows, ids, data, cutoffs): each block of rows in all cells of its share, each block of queries in all of its group."""
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    rows = blocks.select("*", all_of(groups).alias("t_group"), F.pmod(F.xxhash64("rows"), F.lit(shares)).alias("t_share"))
    queries = asked.select("*", F.pmod(F.xxhash64("q_rows"), F.lit(groups)).alias("t_group"), all_of(shares).alias("t_share"))
    cell = (F.col("t_share") * groups + F.col("t_group")).alias("cell")
    cutoffs = F.col("cutoffs") if "cutoffs" in asked.columns else F.lit(None).cast("binary")
    return rows.select(cell, F.lit(False).alias("asks"), "dim", "rows", "ids", "data", F.lit(None).cast("binary").alias("cutoffs")).union(
        queries.select(cell, F.lit(True), "dim", F.col("q_rows"), F.col("q_ids"), F.col("q_data"), cutoffs)
    )


def _ranked(found: DataFrame, k: int, *ties: str) -> DataFrame:
    """The k best of each query of what the cells gave, k of each share."""
    best_first = Window.partitionBy("q_row").orderBy(F.desc("score"), *ties)
    return found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", segments: int = SEGMENTS, rows: int = ROWS, queries: int = QUERIES) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each row of ``vectors`` where ``is_query`` holds the k best of all other rows."""
    own = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asked"), F.col(vector_col).alias("vector"))
    blocks = settle(packed(own.where("id is not null"), rows))
    asked = settle(_queries(blocks.select("dim", "rows", "ids", "asked", "data"), queries))
    # A block of queries goes to every share of the blocks of rows, and there meets each block of vectors of its length once.
    n_blocks, x_bytes = blocks.agg(F.count("*"), F.coalesce(F.sum(F.length("data")), F.lit(0))).first()
    q_bytes = asked.agg(F.sum(F.length("q_data"))).first()[0] or 0
    # What is shuffled, rows times groups and queries times shares, is least where both are equal.
    cells = min(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(CELLS, 4 * x_bytes // max(1, q_bytes)))
    groups = max(1 + q_bytes // HELD, round((cells * q_bytes / max(1, x_bytes)) ** 0.5))
    shares = max(1, min(n_blocks, -(-cells // groups)))
    some = max(1, n_blocks // FIRST)
    blocks = blocks.select("dim", "rows", "ids", "data")
    few = blocks.where(F.pmod(F.shiftright(F.xxhash64("rows"), 20), F.lit(FIRST)) == 0) if some > 1 else blocks
    first = _ranked(_met(_cells(few, asked, shares, groups), shares * groups, _Queries.local_lists, k, segments), k)
    cutoffs = first.where(F.col("rank") == k).select("q_row", F.col("score").alias("cutoff"))
    with_cutoffs = settle(_with_cutoffs(asked, settle(cutoffs)))
    found = _met(_cells(blocks, with_cutoffs, shares, groups), shares * groups, _Queries.sufficient, k, segments)
    return _ranked(found, k, "vec_id").select("query_id", "rank", "vec_id", "score")


def _with_cutoffs(asked: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Blocks of queries with a cutoff beside each query, the least integer where there is none. A block has a bounded number of queries,
    which bounds the group."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(data, np.int64)
                yield pa.RecordBatch.from_pydict({"q_block": [block] * len(own), "place": np.arange(len(own), dtype=np.int32), "q_row": own})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed_ = [np.array([c["cutoff"] for c in sorted(cs, key=lambda c: c["place"])], np.int64).tobytes() for cs in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"q_block": batch.column(0), "cutoffs": packed_})

    places = asked.select("q_block", "q_rows").mapInArrow(rows, "q_block string, place int, q_row long")
    known = places.join(cutoffs.hint("merge"), "q_row", "left").select("q_block", F.struct("place", F.coalesce("cutoff", F.lit(LEAST)).alias("cutoff")).alias("c"))
    lists = known.groupBy("q_block").agg(F.collect_list("c").alias("cs")).mapInArrow(pack, "q_block string, cutoffs binary")
    return asked.join(lists.hint("merge"), "q_block")
