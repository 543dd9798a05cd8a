"""Byte-level BPE encoding and decoding.

Pre-tokenisation runs without a regular expression. Every code point of a chunk of texts gets a symbol: letter, number, white space (by what
follows it), the start of an English contraction, anything else, or the end of a text. A symbol is a transition function between the few
states of the splitting automaton; composing functions is associative, and the compositions of the symbols' functions form a small monoid,
so that a blocked scan over monoid elements (numpy takes from the composition table) gives the state before each code point, and with it
where pieces start. The slices feed a cache of merged pieces; token offsets are kept for decoding.

The pieces are those of the pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.

Defined results: a null or empty text has no tokens; rows are encoded one by one, in whole, special tokens are ordinary text; result columns
replace input columns of the same name. A worker holds one chunk of texts, at least one whole text.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Code points that a worker splits at a time, but for longer texts.
CHUNK = 1_000_000
#: Pieces that a worker's cache keeps at most from one chunk to the next.
CACHED = 300_000
#: Widths in bytes of the matrices in which pieces are merged; longer pieces are merged one by one. An id that pairs with none fills up.
WIDTHS, PAD = (4, 7, 10, 14, 20, 40), 1 << 30
#: The rank of a pair that does not merge.
NONE = 1 << 40

# Symbols and states of the automaton.
LETTER, NUMBER, OTHER, SPACE_ON, SPACE_BEFORE, SPACE_LAST, SHORT, LONG, END = range(9)
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_SPACE, LED, ONE_MORE, TWO_MORE = range(8)
#: The code points of the White_Space property.
WHITE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def _moves() -> tuple[np.ndarray, np.ndarray]:
    """next state and whether a piece starts, by symbol and state."""
    to, starts = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    for symbol, run in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHER)):
        to[symbol] = run
        starts[symbol, [run, LED]] = False
    to[SPACE_ON], to[SPACE_BEFORE], to[SPACE_LAST], to[END] = IN_SPACE, LED, FRESH, FRESH
    starts[SPACE_ON, IN_SPACE] = False
    for symbol, state in ((SHORT, ONE_MORE), (LONG, TWO_MORE)):
        to[symbol] = state
        to[symbol, [IN_OTHER, LED]] = IN_OTHER
        starts[symbol, [IN_OTHER, LED]] = False
    to[:END, ONE_MORE], to[:END, TWO_MORE] = FRESH, ONE_MORE
    starts[:END, [ONE_MORE, TWO_MORE]] = False
    return to, starts


@cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(element of each symbol, composition table "first, then", functions of the elements, piece starts by symbol and state)."""
    to, starts = _moves()
    found = {bytes(range(8)): 0}
    functions = [np.arange(8, dtype=np.uint8)]
    for f in functions:
        for g in to:
            if (key := (h := g[f]).tobytes()) not in found:
                found[key] = len(functions)
                functions.append(h)
    table = np.array([[found[g[f].tobytes()] for g in functions] for f in functions], np.uint16)
    return np.array([found[g.tobytes()] for g in to], np.uint16), table, np.stack(functions), starts


def scan(elements: np.ndarray, width: int = 256) -> np.ndarray:
    """Running compositions of monoid elements: inside blocks side by side, over the blocks' totals, then both together."""
    table = _monoid()[1]
    flat, m, n = table.ravel(), len(table), len(elements)
    if n <= 64:
        out, now = np.empty(n, np.uint16), 0
        for i, x in enumerate(elements):
            out[i] = now = table[now, x]
        return out
    width = min(width, max(2, int(n**0.5)))
    blocks = -(-n // width)
    padded = np.zeros(blocks * width, np.uint16)
    padded[:n] = elements
    side = np.ascontiguousarray(padded.reshape(blocks, width).T).astype(np.int32)
    for j in range(1, width):
        side[j] = flat[side[j - 1] * m + side[j]]
    before = np.zeros(blocks, np.int32)
    before[1:] = scan(side[-1].astype(np.uint16))[:-1]
    return flat[before * m + side].T.reshape(-1)[:n]


@cache
def _kinds() -> np.ndarray:
    """Symbol of each code point: letter, number, other or white space."""
    first = "".join(unicodedata.category(chr(i))[0] for i in range(0x110000))
    codes = np.frombuffer(first.encode(), np.uint8)
    out = np.full(0x110000, OTHER, np.uint8)
    out[codes == ord("L")], out[codes == ord("N")] = LETTER, NUMBER
    out[list(WHITE)] = SPACE_ON
    return out


def boundaries(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pieces start, in texts laid side by side with one more code point after each, at ``ends``; those count as pieces."""
    kinds = _kinds()[points]
    kinds[ends] = END
    ahead = np.append(kinds[1:], END)
    solid = (kinds == SPACE_ON) & (ahead != SPACE_ON) & (ahead != END)
    symbols = kinds
    symbols[solid] = np.where(points[solid] == 32, SPACE_BEFORE, SPACE_LAST)
    marks = np.flatnonzero((points == ord("'")) & (symbols == OTHER))
    if len(marks):
        wide = np.append(points, [0, 0])
        one, two = wide[marks + 1], wide[marks + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        long &= ahead[np.minimum(marks + 1, len(ahead) - 1)] != END
        short &= ahead[marks] != END
        symbols[marks[short]], symbols[marks[long & ~short & (ahead[marks] != END)]] = SHORT, LONG
    of_symbol, _, functions, starts = _monoid()
    states = functions[scan(of_symbol[symbols]), FRESH]
    before = np.empty_like(states)
    before[0], before[1:] = FRESH, states[:-1]
    return np.flatnonzero(starts[symbols, before])


class Merges(dict):
    """piece -> its number, of the pieces met so far; arrays hold the token ids by number. What a chunk adds is merged side by side, in
    matrices of pieces of like length."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.forget()
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = {
            (a << 32 | b) + 1: rank for token, rank in ranks.items() for i in range(1, len(token))
            if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None
        }
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, NONE, np.int64)
        left, values = np.fromiter(pairs.keys(), np.uint64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs))
        slots = self._slots(left)
        while len(left):  # open addressing; of the pairs that want one slot, one gets it
            free = np.flatnonzero(self.keys[slots] == 0)
            _, first = np.unique(slots[free], return_index=True)
            got = free[first]
            self.keys[slots[got]], self.values[slots[got]] = left[got], values[got]
            rest = np.ones(len(left), bool)
            rest[got] = False
            left, values, slots = left[rest], values[rest], (slots[rest] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a << 32 | b).astype(np.uint64) + np.uint64(1)
        slots, out = self._slots(keys), np.full(keys.shape, NONE)
        open_ = np.arange(len(keys))
        while len(open_):
            held = self.keys[slots]
            hit = held == keys
            out[open_[hit]] = self.values[slots[hit]]
            on = ~hit & (held != 0)
            open_, keys, slots = open_[on], keys[on], (slots[on] + 1) & ((1 << self.bits) - 1)
        return out

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        return number

    def forget(self) -> None:
        self.clear()
        self.ids, self.first, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def tokens(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, number of ids of each)."""
        if len(self) > CACHED:
            self.forget()
        known = len(self)
        numbers = np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))
        self._add([p.encode() for p in islice(self, known, None)])
        counts = self.counts[numbers]
        ends = np.cumsum(counts)
        places = np.repeat(self.first[numbers] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)
        return self.ids[places], counts

    def _add(self, new: list[bytes]) -> None:
        lengths = np.fromiter(map(len, new), np.int64, len(new))
        ids, first, counts = [self.ids], np.zeros(len(new), np.int64), np.ones(len(new), np.int64)
        at = len(self.ids)
        whole = np.fromiter((self.ranks.get(p, -1) for p in new), np.int64, len(new))
        known = np.flatnonzero(whole >= 0)
        ids.append(whole[known])
        first[known] = at + np.arange(len(known))
        at += len(known)
        low = 0
        for most in (*WIDTHS, None):
            group = np.flatnonzero((whole < 0) & (lengths > low) & (lengths <= (most or lengths.max(initial=0))))
            low = most
            if not len(group):
                continue
            if most:
                raw = np.frombuffer(b"".join([new[i].ljust(most, b"\0") for i in group.tolist()]), np.uint8).reshape(-1, most)
                rows = np.where(np.arange(most) < lengths[group][:, None], self.bytes[raw], PAD)
                merged, n = self._merged(rows, lengths[group])
                merged = merged[np.arange(most) < n[:, None]]
            else:
                each = [self._merged_long(new[i]) for i in group.tolist()]
                merged, n = np.fromiter(chain.from_iterable(each), np.int64), np.fromiter(map(len, each), np.int64)
            ids.append(merged)
            first[group], counts[group] = at + np.cumsum(n) - n, n
            at += len(merged)
        self.ids = np.concatenate(ids).astype(np.int32)
        self.first, self.counts = np.append(self.first, first), np.append(self.counts, counts)

    def _merged(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """In each row, the pair of lowest rank merges first, the leftmost of equal ones, until none has a rank."""
        n, width = ids.shape
        counts, live = counts.copy(), np.arange(n)
        out, now = ids.copy(), ids
        ranks = self.pair_ranks(now[:, :-1].ravel(), now[:, 1:].ravel()).reshape(n, -1) if width > 1 else np.zeros((n, 0), np.int64)
        while ranks.shape[1]:
            at = ranks.argmin(1)
            low = np.take_along_axis(ranks, at[:, None], 1)[:, 0]
            go = low < NONE
            if not go.all():
                out[live[~go], : now.shape[1]] = now[~go]
                live, now, ranks, at, low = live[go], now[go], ranks[go], at[go], low[go]
            if not len(live):
                return out, counts
            columns = np.arange(now.shape[1] - 1)
            now = np.take_along_axis(now, columns + (columns > at[:, None]), 1)
            rows = np.arange(len(live))
            now[rows, at] = low
            columns = columns[:-1]
            ranks = np.take_along_axis(ranks, columns + (columns >= at[:, None]), 1)
            right, left = np.flatnonzero(at < ranks.shape[1]), np.flatnonzero(at > 0)
            ranks[right, at[right]] = self.pair_ranks(now[right, at[right]], now[right, at[right] + 1])
            ranks[left, at[left] - 1] = self.pair_ranks(now[left, at[left] - 1], now[left, at[left]])
            counts[live] -= 1
        out[live, : now.shape[1]] = now
        return out, counts

    def _merged_long(self, piece: bytes) -> tuple[int, ...]:
        """The same with a heap and a linked list, for pieces of any length."""
        ranks, n = self.ranks, len(piece)
        ends, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ends[j] != end:
                continue
            ends[i], alive[j], after[i] = end, False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(piece[i : ends[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, ends[after[i]]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:end])) is not None:
                heapq.heappush(heap, (r, h, end))
        return tuple([ranks[piece[i : ends[i]]] for i in range(n) if alive[i]])


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def encode_chunk(texts: list[str], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, number of ids of each)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1) - 1
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    starts = boundaries(points, ends)
    stops = np.append(starts[1:], len(points))
    is_end = np.zeros(len(points), bool)
    is_end[ends] = True
    real = ~is_end[starts]
    starts, stops = starts[real], stops[real]
    pieces = [joined[a:b] for a, b in zip(starts.tolist(), stops.tolist())]
    ids, each = merges.tokens(pieces)
    counts = np.append(0, np.cumsum(each))
    return ids, np.diff(counts[np.searchsorted(starts, ends)], prepend=0)


def _chunks(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, each with about ``most`` bytes in ``column``."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = np.cumsum(np.nan_to_num(pc.cast(pc.binary_length(batch.column(column)), pa.float64()).to_numpy(zero_copy_only=False)))
        at = 0
        while at < len(sizes):
            done = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, done + most)))
            yield batch.slice(at, to - at)
            at = to


def _with(batch: pa.RecordBatch, names: list[str], **columns: pa.Array) -> pa.RecordBatch:
    kept = {c: batch.column(c) for c in batch.schema.names} | columns
    return pa.RecordBatch.from_arrays([kept[n] for n in names], names=names)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(values, pa.int32()))


def _schema(df: DataFrame, **more: T.DataType) -> T.StructType:
    return T.StructType([*[f for f in df.schema.fields if f.name not in more], *[T.StructField(k, v) for k, v in more.items()]])


def encode(df: DataFrame, ranks: bytes, text_col: str = "text") -> DataFrame:
    """``df`` with ids ARRAY<INT> and offsets ARRAY<INT>, where each token's bytes end in the UTF-8 text. ranks: the bytes of a rank
    file, which every worker gets (some 800 kB for 50,000 tokens)."""
    schema = _schema(df, ids=T.ArrayType(T.IntegerType()), offsets=T.ArrayType(T.IntegerType()))
    names, shared = schema.names, df.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = read_ranks(shared.value)
        merges = Merges(table)
        lengths = np.zeros(max(table.values()) + 1, np.int64)
        lengths[list(table.values())] = [len(t) for t in table]
        for batch in _chunks(batches, text_col, CHUNK):
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            ids, counts = encode_chunk(texts, merges)
            total = np.concatenate([[0], np.cumsum(lengths[ids])])
            first = np.cumsum(counts) - counts
            offsets = total[1:] - np.repeat(total[first], counts)
            yield _with(batch, names, ids=_lists(ids, counts), offsets=_lists(offsets, counts))

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ranks: bytes, ids_col: str = "ids") -> DataFrame:
    """``df`` with decoded BINARY, the bytes of the tokens in ``ids_col``; null for null."""
    schema = _schema(df, decoded=T.BinaryType())
    names, shared = schema.names, df.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = read_ranks(shared.value)
        tokens = [b""] * (max(table.values()) + 1)
        for token, i in table.items():
            tokens[i] = token
        of = tokens.__getitem__
        for batch in batches:
            decoded = [None if ids is None else b"".join(map(of, ids.values.to_pylist())) for ids in batch.column(ids_col)]
            yield _with(batch, names, decoded=pa.array(decoded, pa.binary()))

    return df.mapInArrow(run, schema)
