"""SimHash near-duplicates with anchors from a covering code.

A fingerprint's 64 bits are cut into two halves; of two fingerprints that differ in at most 3 bits, one half differs in at most one. In each
half the anchors are the words of the binary Hamming code of length 31: every word of 31 bits lies within the covering radius 1 of exactly
one of them, so the home anchor of a fingerprint lies within 1 + 1 of every fingerprint whose half differs in one bit. Each fingerprint goes to
all anchors within that distance, 16 at most, 32 for both halves, whatever the input; fingerprints that meet at an anchor are compared.

What meets at one anchor is compared in blocks and gives links of a spanning forest, not all pairs. Where more than ``most`` meet, they
are dealt again: the bits not yet fixed are cut into four parts, one of which two linked fingerprints share, and so on; no pair is lost.

Defined results: a null text is empty; a text without words has fingerprint 0; equal texts have equal fingerprints and are compared once;
null ids get a fingerprint and a component, but give it no name (it is null if all its ids are null).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradus.llm.components import components
from gradus.llm.store import settle

SHINGLE, SEED, NEAR = 3, 42, 3
#: Members of one bucket that are compared in one place; more are dealt again.
MOST = 4096
#: Shingle hashes whose bits are counted at a time.
COUNTED = 1 << 16

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None) -> int:
    """64 bits as a signed number. Bit i is 1 if more than half of the shingles' hashes have it."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(LOWER).split()  # bytes.split() splits at the six ASCII white-space characters
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    k = min(SHINGLE, len(words))
    n = len(words) - k + 1
    ones, a, b = np.zeros(64, np.int64), starts.tolist(), ends[k - 1 :].tolist()
    for at in range(0, n, COUNTED):
        hashes = np.array([xxh64_intdigest(joined[i:j], SEED) for i, j in zip(a[at : min(n, at + COUNTED)], b[at : at + COUNTED])], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, fp BIGINT), one for each row of ``docs``."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=[id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _parity(x: Column, bit: int) -> Column:
    """Sum of the bits of a word of 31 whose place, from 1, has ``bit`` set."""
    mask = sum(1 << (place - 1) for place in range(1, 32) if place >> bit & 1)
    return F.bit_count(x.bitwiseAND(F.lit(mask))) % 2


def anchors(half: Column) -> Column:
    """The code words within distance 2 of a word of 31 bits. With syndrome s, flipping the places i and j leads to one if i xor j = s,
    and flipping s alone does."""
    syndrome = sum((_parity(half, b) * (1 << b) for b in range(1, 5)), _parity(half, 0))
    flip = lambda s: 1 << (s - 1)
    flips = [[0], *[[flip(s), *[flip(i) | flip(i ^ s) for i in range(1, 32) if 0 < i ^ s and i < i ^ s]] for s in range(1, 32)]]
    table = F.array(*[F.array(*[F.lit(f).cast("long") for f in row]) for row in flips])
    return F.transform(F.element_at(table, (syndrome + 1).cast("int")), lambda f: half.bitwiseXOR(f))


def buckets(fps: DataFrame) -> DataFrame:
    """Rows (key, fp, free): the anchors of distinct fingerprints, by half; free is the mask of bits that the key says nothing of."""
    low, high = F.col("fp").bitwiseAND(F.lit(0x7FFFFFFF)), F.shiftrightunsigned("fp", 33).bitwiseAND(F.lit(0x7FFFFFFF))
    keys = F.concat(F.transform(anchors(low), lambda x: x * 2), F.transform(anchors(high), lambda x: x * 2 + 1))
    return fps.select("fp", F.explode(keys).alias("key"), F.lit(-1).cast("long").alias("free"))


def _forest(group: np.ndarray, near: int) -> np.ndarray:
    """Links of a spanning forest of the fingerprints that differ in ``near`` bits at most. Compares what has been reached with what
    has not, a row at a time, so that a tight group is done in a few rows."""
    rest, links = group, []
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            hit = np.bitwise_count(rest ^ x) <= near
            if hit.any():
                found = rest[hit]
                links.append(np.stack([np.full(len(found), x), found], 1))
                front.extend(found)
                rest = rest[~hit]
    return np.concatenate(links) if links else np.zeros((0, 2), np.uint64)


def _parts(free: int) -> list[int]:
    """The set bits of ``free``, dealt into four masks (fewer, if there are fewer bits)."""
    bits = [1 << i for i in range(64) if free >> i & 1]
    return [m for i in range(4) if (m := sum(bits[i::4]))]


def compare(rows: DataFrame, near: int = NEAR, most: int = MOST) -> DataFrame:
    """From (key, fp, free): links (a, b) between fingerprints of one key, where b is set; and where more than ``most`` meet, rows (a, key,
    free) dealt anew. A task reads its keys in order and holds ``most`` fingerprints of one key."""
    schema = "a long, b long, key long, free long"
    signed = lambda x: np.asarray(x, np.uint64).view(np.int64)

    def dealt(key: int, fps: np.ndarray, free: int) -> list[tuple]:
        out = []
        for j, part in enumerate(_parts(free & (2**64 - 1))):
            value = fps & np.uint64(part)
            new = (value ^ np.uint64((key * 4 + j) & (2**64 - 1))) * np.uint64(0x9E3779B97F4A7C15)
            new = (new ^ new >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            out.append((signed(fps), signed(new ^ new >> np.uint64(32)), np.full(len(fps), signed([free & (2**64 - 1) & ~part])[0])))
        return out

    def table(links: list[np.ndarray], anew: list[tuple]) -> pa.RecordBatch:
        link = signed(np.concatenate(links)) if links else np.zeros((0, 2), np.int64)
        a, key, free = (np.concatenate(x) for x in zip(*anew)) if anew else [np.zeros(0, np.int64)] * 3
        n = len(a)
        columns = [pa.array(np.concatenate([link[:, 0], a])), pa.array([*link[:, 1].tolist(), *[None] * n], pa.int64()), pa.array([*[None] * len(link), *key.tolist()], pa.int64()), pa.array([*[None] * len(link), *free.tolist()], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "key", "free"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, mask, held, over = None, -1, np.zeros(0, np.uint64), False  # over: this key's first rows were dealt anew already

        def done() -> tuple[list, list]:
            if over:
                return [], dealt(key, held, mask)
            return [_forest(held, near)] if len(held) > 1 else [], []

        for batch in batches:
            keys, fps, frees = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()
            if not len(keys):
                continue
            cuts = np.flatnonzero(np.diff(keys)) + 1
            starts, stops = np.append(0, cuts), np.append(cuts, len(keys))
            links, anew = [], []
            pairs = np.flatnonzero(stops - starts == 2)
            pairs = pairs[(pairs > 0) & (pairs < len(starts) - 1)]
            x, y = fps[starts[pairs]], fps[starts[pairs] + 1]
            hit = np.bitwise_count(x ^ y) <= near
            links.append(np.stack([x[hit], y[hit]], 1))
            for r in np.unique(np.concatenate([[0, len(starts) - 1], np.flatnonzero(stops - starts > 2)])).tolist():
                k, own = int(keys[starts[r]]), fps[starts[r] : stops[r]]
                if k != key:
                    if key is not None:
                        more, again = done()
                        links += more
                        anew += again
                    key, mask, held, over = k, int(frees[starts[r]]), own, False
                else:
                    held = np.concatenate([held, own])
                if len(held) > most and _parts(mask & (2**64 - 1)):
                    anew += dealt(key, held, mask)
                    held, over = held[:0], True
            yield table(links, anew)
        if key is not None:
            yield table(*done())

    dealt_rows = rows.select("key", "fp", "free").repartition("key").sortWithinPartitions("key", "fp")
    return dealt_rows.mapInArrow(run, schema)


def links(fps: DataFrame, near: int = NEAR, most: int = MOST) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints of ``fps`` that differ in at most ``near`` (3 or fewer) bits, if not every pair."""
    if not 0 <= near <= 3:
        raise ValueError("the anchors cover distances up to 3")
    found, rows = None, buckets(fps)
    while rows is not None:
        compared = settle(compare(rows, near, most))
        new = compared.where("b is not null").select("a", "b")
        found = new if found is None else found.union(new)
        anew = compared.where("key is not null").select("key", F.col("a").alias("fp"), "free").distinct()
        rows = None if anew.isEmpty() else anew
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: int = NEAR, most: int = MOST) -> DataFrame:
    """Rows (id_col, fp, component): one for each row of ``docs``; component is the smallest id that links reach."""
    own = settle(fingerprints(docs, id_col, text_col))
    distinct = settle(own.groupBy("fp").agg(F.min(id_col).alias("n_first")))
    groups = components(links(distinct.select("fp"), near, most)).withColumnsRenamed({"node": "fp", "component": "n_group"})
    named = distinct.join(groups, "fp", "left").withColumn("n_group", F.coalesce("n_group", "fp"))
    firsts = named.groupBy("n_group").agg(F.min("n_first").alias("component"))
    return own.join(named.join(firsts, "n_group").select("fp", "component"), "fp").select(id_col, "fp", "component")
