"""Exact removal of long repeated byte strings with suffix arrays and longest-previous-factor arrays.

A window is a string of ``length`` bytes. All windows with equal bytes have the same least k-mer hash, so windows are dealt by it: a run of
neighbouring windows with one least hash is kept as one stretch of text. Stretches that are equal as a whole (by a 128-bit hash) are
counted; only of the different stretches under one hash value does one of each travel, to be compared byte for byte.

The comparison builds a suffix array of the stretches side by side, in document order, by prefix doubling up to ``length``. Suffixes cut at
``length`` that are equal stand together, in order of position, so the previous smaller position in suffix order is a window's neighbour
there and the longest previous factor, cut at ``length``, is full exactly for windows that have one. Those are later copies; the windows
they lead back to are the first ones. ``keep="first"`` removes later copies, ``keep="none"`` the first ones too.

Where more than ``most`` bytes of different stretches share a hash value, they are dealt again by another hash function, those that are counted
beforehand before they are moved, and after ``LEVELS`` times window by window; nothing is dropped.

Defined results: a null text is empty; texts shorter than ``length`` keep everything; matches never cross documents, and may overlap, in
one document too; rows that are equal in id and text are copies of each other under ``keep="none"`` and one document under
``keep="first"``; null ids are ids; ids may stand for several texts; texts of any length are taken in whole; an empty table gives an empty
result. Columns besides id and text are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradus.llm.bpe import _chunks
from gradus.llm.store import settle

LENGTH, KMER = 400, 32
#: Bytes that are scanned, and bytes of stretches that are sorted, at a time.
SCANNED, MOST = 1 << 20, 6 << 20
LEVELS = 3
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _powers or len(_powers[base][0]) < n:
        _powers[base] = tuple(np.append(np.uint64(1), np.cumprod(np.full(n - 1, b, np.uint64))) for b in (base, pow(base, -1, 1 << 64)))
    return _powers[base][0][:n], _powers[base][1][:n]


def kmer_hashes(data: np.ndarray, k: int, level: int = 0) -> np.ndarray:
    power, back = _power(len(data) + 1, BASES[level % len(BASES)])
    sums = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1]))
    h = (sums[k:] - sums[:-k]) * back[: len(sums) - k]
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ h >> np.uint64(32)) >> np.uint64(1)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours: running minima from both ends of blocks."""
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(grid, 1).ravel()
    return np.minimum(ahead[: n - width + 1], behind[width - 1 : n])


def stretches(data: np.ndarray, sizes: np.ndarray, length: int, k: int, level: int = 0) -> tuple[np.ndarray, ...]:
    """Of texts side by side: (least hash, text, first window, number of windows, whether a window may stand in it twice) of each run of
    windows with one least hash; places count from the start of all texts."""
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty.astype(np.uint64), empty, empty, empty, empty.astype(bool)
    hashes = kmer_hashes(data, k, level)
    least = sliding_min(hashes, length - k + 1)
    text = np.repeat(np.arange(len(sizes)), sizes)
    valid = text[: len(least)] == text[length - 1 :]
    change = np.ones(len(least), bool)
    change[1:] = (least[1:] != least[:-1]) | (text[1 : len(least)] != text[: len(least) - 1]) | (valid[1:] != valid[:-1])
    starts = np.flatnonzero(change)
    counts = np.diff(np.append(starts, len(least)))
    ok = valid[starts]
    starts, counts = starts[ok], counts[ok]
    value = least[starts]
    twice = np.fromiter((np.count_nonzero(hashes[a:b] == v) > 1 for a, b, v in zip(starts.tolist(), (starts + counts + length - k).tolist(), value)), bool, len(starts))
    return value, text[starts], starts, counts, twice


def same_windows(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of ``starts`` by suffix cut at ``length``, then place; whether the one before in that order has the same cut suffix)."""
    n = len(data)
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    span = 1
    while span * 2 <= min(8, length):
        span *= 2
    key = np.zeros(n, np.uint64)
    for i in range(span):
        key = key << np.uint64(8) | wide[i : n + i]
    rank = _ranks(key)
    while span < length:
        step = min(span, length - span)
        later = np.zeros(n, np.uint64)
        later[: n - step] = rank[step:].astype(np.uint64) + np.uint64(1)
        key = rank.astype(np.uint64) << np.uint64(32) | later
        span += step
        if span == length:
            key = key[starts]
            order = np.argsort(key, kind="stable")
            return order, np.append(False, key[order][1:] == key[order][:-1])[: len(order)]
        rank = _ranks(key)
    key = key[starts]
    order = np.argsort(key, kind="stable")
    return order, np.append(False, key[order][1:] == key[order][:-1])[: len(order)]


def _ranks(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    ordered = key[order]
    rank = np.empty(len(key), np.uint32)
    rank[order] = np.cumsum(np.append(False, ordered[1:] != ordered[:-1])[: len(key)]).astype(np.uint32)
    return rank


def repeated(texts: list[bytes], counts: np.ndarray, length: int, first: bool) -> list[tuple[int, int, int]]:
    """(text, from, to): ranges of windows that another window equals, or only an earlier one if ``first``; ``counts`` windows a text."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    begins = np.concatenate([[0], np.cumsum([len(t) for t in texts])])[:-1]
    text = np.repeat(np.arange(len(texts)), counts)
    inside = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    order, same = same_windows(data, begins[text] + inside, length)
    full = same if first else same | np.append(same[1:], False)  # the longest previous factor is full, or leads back here
    hit = np.zeros(len(text), bool)
    hit[order[full]] = True
    fresh = hit.copy()
    fresh[1:] &= ~(hit[:-1] & (text[1:] == text[:-1]))
    a = np.flatnonzero(fresh)
    last = hit.copy()
    last[:-1] &= ~(hit[1:] & (text[1:] == text[:-1]))
    b = np.flatnonzero(last)
    return list(zip(text[a].tolist(), inside[a].tolist(), inside[b].tolist()))


def _found(docs: DataFrame, length: int, k: int) -> DataFrame:
    """Rows (value, content, id, key, start, windows, twice): every stretch of every text."""
    id_type = docs.schema["id"].dataType
    schema = T.StructType([T.StructField("value", T.LongType()), T.StructField("content", T.BinaryType()), T.StructField("id", id_type), T.StructField("key", T.BinaryType()),
                           T.StructField("start", T.IntegerType()), T.StructField("windows", T.IntegerType()), T.StructField("twice", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in _chunks(batches, "data", SCANNED):
            texts = batch.column(2).to_pylist()
            sizes = np.array([len(t) for t in texts], np.int64)
            whole = b"".join(texts)
            value, text, starts, counts, twice = stretches(np.frombuffer(whole, np.uint8), sizes, length, k)
            content = [xxh3_128_digest(whole[a:b]) for a, b in zip(starts.tolist(), (starts + counts + length - 1).tolist())]
            place = starts - (np.cumsum(sizes) - sizes)[text]
            which = pa.array(text)
            yield pa.RecordBatch.from_arrays([pa.array(value.astype(np.int64)), pa.array(content, pa.binary()), batch.column(0).take(which), batch.column(1).take(which),
                                              pa.array(place.astype(np.int32)), pa.array(counts.astype(np.int32)), pa.array(twice)], names=schema.names)

    return docs.mapInArrow(run, schema)


def _cut(docs: DataFrame, wanted: DataFrame, length: int, k: int) -> DataFrame:
    """Rows (value, content, base, text, heavy): the bytes of the wanted stretches, dealt anew where they are heavy.
    wanted: (key, value, content, start, windows, heavy)."""
    lists = wanted.groupBy(F.col("key").alias("w_key")).agg(F.collect_list(F.struct("value", "content", "start", "windows", "heavy")).alias("wanted"))
    joined = docs.join(lists, F.col("key") == F.col("w_key")).select("data", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches, "data", SCANNED):
            rows = []
            for data, ws in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w in ws:
                    text = data[w["start"] : w["start"] + w["windows"] + length - 1]
                    if w["heavy"]:
                        rows += [(v, w["content"], at, piece, True) for v, at, piece in _dealt(w["value"], text, 1, length, k)]
                    else:
                        rows.append((w["value"], w["content"], 0, text, False))
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.bool_()))], names=["value", "content", "base", "text", "heavy"])

    return joined.mapInArrow(run, "value long, content binary, base int, text binary, heavy boolean")


def _dealt(value: int, text: bytes, level: int, length: int, k: int) -> Iterator[tuple[int, int, bytes]]:
    """(value, place, text) of the stretches of a stretch by the hash function of ``level``, single windows beyond LEVELS."""
    from xxhash import xxh3_64_intdigest

    if level <= LEVELS:
        data = np.frombuffer(text, np.uint8)
        values, _, starts, counts, _ = stretches(data, np.array([len(data)]), length, k, level)
    else:
        n = len(text) - length + 1
        values, starts, counts = [xxh3_64_intdigest(text[i : i + length]) >> 1 for i in range(n)], np.arange(n), np.ones(n, np.int64)
    for v, s, c in zip(values, starts.tolist(), counts.tolist()):
        mixed = xxh3_64_intdigest(value.to_bytes(8, "little") + int(v).to_bytes(8, "little")) >> 1
        yield mixed, s, text[s : s + c + length - 1]


def _compared(rows: DataFrame, length: int, k: int, level: int, most: int, first: bool) -> DataFrame:
    """From (value, content, base, text, place): rows (content, low, high), ranges of windows to remove; and rows with value and text,
    stretches dealt anew. place orders the stretches of a value by document."""
    schema = "content binary, low int, high int, value long, base int, text binary, place binary"

    def out(found: list[tuple], anew: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        all_rows = [(*f, None, None, None, None) for f in found] + [(c, None, None, v, b, t, p) for v, c, b, t, p in anew]
        columns = list(zip(*all_rows)) or [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["content", "low", "high", "value", "base", "text", "place"])

    def dealt(value: int, group: list[tuple]) -> list[tuple]:
        return [(v, content, base + at, piece, place) for content, base, text, place in group for v, at, piece in _dealt(value, text, level + 1, length, k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, size, over = None, [], 0, False
        ready: list[tuple] = []  # whole groups that wait to be sorted together
        ready_size = 0

        def sort() -> list[tuple]:
            nonlocal ready, ready_size
            texts = [r[2] for r in ready]
            found = repeated(texts, np.array([len(t) - length + 1 for t in texts]), length, first) if texts else []
            found = [(ready[i][0], ready[i][1] + a, ready[i][1] + b) for i, a, b in found]
            ready, ready_size = [], 0
            return found

        for batch in batches:
            found, anew = [], []
            for value, content, base, text, place in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                if value != now:
                    if over:
                        anew += dealt(now, group)
                    else:
                        ready += group
                        ready_size += size
                    if ready_size > most // 2:
                        found += sort()
                    now, group, size, over = value, [], 0, False
                group.append((content, base, text, place))
                size += len(text)
                if size > most:
                    anew += dealt(now, group)
                    group, size, over = [], 0, True
                    if len(anew) > 1000:
                        yield out(found, anew)
                        found, anew = [], []
            yield out(found, anew)
        if over:
            yield out([], dealt(now, group))
        else:
            ready += group
        yield out(sort(), [])

    ordered = rows.select("value", "content", "base", "text", "place").repartition("value").sortWithinPartitions("value", "place", "base")
    return ordered.mapInArrow(run, schema)


def spans(docs: DataFrame, length: int = LENGTH, k: int = KMER, keep: str = "none", most: int = MOST) -> DataFrame:
    """From (id, key, data): rows (key, spans ARRAY<STRUCT<from, to>>) of what to remove, as collected, for texts that lose something."""
    first = keep == "first"
    found = settle(_found(docs, length, k))
    occurrence = F.struct("id", "key", "start", "windows")
    kinds = settle(found.groupBy("value", "content").agg(F.count("*").alias("n"), F.min(occurrence).alias("first"), F.max("twice").alias("twice")))
    size = F.sum(F.col("first.windows") + F.lit(length - 1))
    shared = kinds.groupBy("value").agg(F.count("*").alias("n_kinds"), F.max("twice").alias("any_twice"), size.alias("n_bytes")).where("n_kinds > 1 or any_twice")
    shared = shared.select(F.col("value").alias("s_value"), (F.col("n_bytes") > most).alias("heavy"))
    wanted = kinds.join(shared, F.col("value") == F.col("s_value")).select("value", "content", "first", "heavy")
    cut = settle(_cut(docs, wanted.select("first.key", "value", "content", "first.start", "first.windows", "heavy"), length, k))
    # Documents come in the order of their ids; the place only has to order them, for keep="first".
    place = wanted.select(F.col("content").alias("p_content"), F.col("first.id").alias("p_id"), F.col("first.key").alias("p_key"), F.col("first.start").alias("p_start"))
    if first:
        keyed = F.concat(F.unhex(F.lpad(F.hex(F.coalesce(F.col("p_id").cast("long"), F.lit(0)) + F.lit(1 << 62)), 16, "0")), F.col("p_key"), F.unhex(F.lpad(F.hex("p_start"), 8, "0")))
        placed = cut.join(place, F.col("content") == F.col("p_content")).select("value", "content", "base", "text", keyed.alias("place"), "heavy")
    else:
        placed = cut.select("value", "content", "base", "text", F.lit(b"").alias("place"), "heavy")
    rows, heavy = placed.where("not heavy").drop("heavy"), placed.where("heavy").drop("heavy")
    heavy = None if heavy.isEmpty() else heavy
    ranges, level = None, 0
    while rows is not None:
        if level > LEVELS:  # single windows: those that stand twice, counted before the shuffle
            same = rows.groupBy("value", "text").agg(F.count("*").alias("n"), F.min(F.struct("place", "base")).alias("least")).where("n > 1").withColumnsRenamed({"value": "v", "text": "t"})
            later = F.struct("place", "base") != F.col("least") if first else F.lit(True)
            new = rows.join(same, (F.col("value") == F.col("v")) & (F.col("text") == F.col("t"))).where(later).select("content", F.col("base").alias("low"), F.col("base").alias("high"))
            ranges = ranges.union(new)
            break
        compared = settle(_compared(rows, length, k, level, most, first))
        new = compared.where("low is not null").select("content", "low", "high")
        ranges = new if ranges is None else ranges.union(new)
        rows = compared.where("text is not null").select("value", "content", "base", "text", "place")
        rows, level = (None if rows.isEmpty() else rows), level + 1
        if level == 1 and heavy is not None:  # what was dealt by the first of the other hash functions before it was moved
            rows = heavy if rows is None else rows.union(heavy)
    whole = kinds.where("n > 1").select("content", F.col("first").alias("w_first"))
    own = [F.col("id"), F.col("key"), F.col("start"), F.col("windows")]
    here = F.struct(*own)
    all_of = found.join(whole, "content").where(~here.eqNullSafe(F.col("w_first")) if first else F.lit(True)).select("key", F.col("start").alias("from"), (F.col("start") + F.col("windows") + (length - 1)).alias("to"))
    parts = found.join(ranges, "content").select("key", (F.col("start") + F.col("low")).alias("from"), (F.col("start") + F.col("high") + length).alias("to"))
    return all_of.union(parts).groupBy("key").agg(F.collect_list(F.struct("from", "to")).alias("spans"))


def _merged(spans_: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in sorted(spans_ or [], key=lambda s: s["from"]):
        if out and s["from"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["to"])
        else:
            out.append([s["from"], s["to"]])
    return [tuple(x) for x in out]


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = KMER, keep: str = "none", id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """Rows (id_col, n_bytes, spans ARRAY<STRUCT<from, to>>, kept BINARY), one for each row of ``docs``: the maximal runs of removed bytes,
    and what remains. ``keep="first"`` takes integer ids."""
    if keep not in ("none", "first") or not 0 < k <= length:
        raise ValueError("keep is none or first, and k at most length")
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    keyed = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("~")).cast("binary"), F.lit(b"\0"), data))).alias("key"), data.alias("data"))
    lost = spans(keyed, length, k, keep, most).withColumnRenamed("key", "l_key")
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()),
                           T.StructField("spans", T.ArrayType(T.StructType([T.StructField("from", T.IntegerType()), T.StructField("to", T.IntegerType())]))), T.StructField("kept", T.BinaryType())])
    kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches, "data", 4 * SCANNED):
            sizes, merged, kept = [], [], []
            for data, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                runs = _merged(own)
                sizes.append(len(data))
                merged.append([{"from": a, "to": b} for a, b in runs])
                edges = [0, *[x for r in runs for x in r], len(data)]
                kept.append(b"".join([data[a:b] for a, b in zip(edges[::2], edges[1::2])]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(merged, kind), pa.array(kept, pa.binary())], names=schema.names)

    joined = keyed.join(lost, keyed["key"] == lost["l_key"], "left").select("id", "data", "spans")
    return joined.mapInArrow(run, schema)
