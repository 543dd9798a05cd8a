"""Phrases whose words belong together, counted with suffix automata.

A shard, some megabytes of text, becomes codes of words, and these become a generalised suffix automaton cut at ``depth`` words: its strings of each
length in order, each with its prefix, its last word and its suffix link, which is the transition of its prefix's link by the last word. Each place
counts for the longest string that ends there, and counts go down the links, longest first: that is how often each string ends anywhere. A string that counts as
often as its link is of the link's state. The automaton then lists its strings with their counts.

Texts are read once for each length and once more:

1. For a length, tasks send a hash and a small count of each string whose prefix and link may be frequent, in sorted blocks by bins of hashes. A bin's are
   added up; hashes with ``least`` or more set a bit of a filter of fixed size (FILTER bits, 16 MB), which goes to all tasks. Counts that are sent end at
   a number over ``least``: a sum that reaches ``least`` does so either way.
2. The last time, tasks send the strings themselves where the filter has their bit, with whole counts, in sorted blocks by bins of strings. Their sums are
   exact: what only shares a hash is sent in vain.

The filter is a fixed number of bits: over far more frequent phrases than bits it lets everything pass, which costs rows to shuffle and no result. Candidates'
parts are frequent too, so their counts are joined from the same table. A candidate goes where a longer one with half its count holds it; then
the one that is a word longer at that end, whose prefix or suffix link it is, has at least that count and is a candidate, so that these are looked at alone.

Defined results: a null text is empty, a null language is ``und``, as are texts of that name; repeated texts count as often as they stand; a piece of
any length is kept whole (cuts of long texts lie between pieces); ties in rank go to the higher count, then the smaller phrase by bytes; an
empty table, or one without phrases that are frequent, gives an empty result; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradus.llm.bpe import _chunks
from gradus.llm.chaining import BLOCKS, _blocks, _by_part, _gathered, _groups, _mixed
from gradus.llm.store import settle

DEPTH, LEAST, TOP = 3, 10, 2000
#: Bytes of text of an automaton, unless a piece is longer.
SHARD = 1 << 21
#: Bits of the filter.
FILTER = 1 << 27
#: Bits of a hash that are counted, strings whose hashes are put together before they are sent, and bins of hashes for each partition of a shuffle.
HASH, HELD, BINS = 44, 3 << 20, 4
#: Strings that are put together before they are sent, and how they are compressed.
KEPT, CODEC = 3 << 18, "zstd"
#: Shares of a language that are ranked by themselves first.
SHARES = 64

_BREAK, _END = b"\xff", b"\xfe"  # no bytes of UTF-8
_FOLDED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + 10 * _BREAK)


class _Codes(dict):
    """Codes of a language's words, given out as the words come."""

    def __init__(self, lang: str, known: list[tuple[str, bytes]]):
        super().__init__({_BREAK: -1})
        self.lang, self.known = lang, known

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self.known)
        self.known.append((self.lang, word))
        return code


def _parts(text: bytes, most: int) -> Iterator[bytes]:
    """The folded text in parts of about ``most`` bytes that end where a piece does."""
    folded, at = text.translate(_FOLDED), 0
    while len(folded) - at > most:
        end = folded.rfind(_BREAK, at, at + most)
        end = end if end >= 0 else folded.find(_BREAK, at + most)
        if end < 0:
            break
        yield folded[at : end + 1]
        at = end + 1
    yield folded[at:]


def shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[tuple[str, bytes]], np.ndarray]]:
    """(words with their languages by code, codes with -1 between pieces) of some megabytes of text at a time, from batches (lang, text BINARY)."""
    known, langs, held, size = [], {}, [], 0
    for batch in _chunks(batches, "text", most):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for part in _parts(text or b"", most):
                if lang not in langs:
                    langs[lang] = _Codes(lang, known)
                tokens = part.replace(_BREAK, b" \xff ").split()
                tokens.append(_BREAK)
                held.append(np.fromiter(map(langs[lang].__getitem__, tokens), np.int64, len(tokens)))
                size += len(part) + 1
                if size >= most:
                    yield known, np.concatenate(held)
                    known, langs, held, size = [], {}, [], 0
    if held:
        yield known, np.concatenate(held)


class Automaton:
    """The suffix automaton of all pieces, cut at ``depth``. By length less 1: ``prefix`` and ``word`` (what a string is), ``link`` and ``count``."""

    def __init__(self, codes: np.ndarray, n_words: int, depth: int):
        none = np.zeros(0, np.int64)
        self.prefix, self.word, self.link = [np.zeros(n_words, np.int64)], [np.arange(n_words)], [np.zeros(n_words, np.int64)]
        ends, at, last, keys = np.flatnonzero(codes >= 0), codes, [], [np.arange(n_words)]
        for length in range(1, depth + 1):
            if length > 1:  # a string goes on by a word, or ends with its piece
                key = at[ends - 1] * n_words + codes[ends]
                found, place = np.unique(key, return_inverse=True) if len(key) else (none, none)
                prefix, word = found // max(1, n_words), found % max(1, n_words)
                link = np.searchsorted(keys[-1], self.link[-1][prefix] * n_words + word) if length > 2 else word
                keys.append(found)
                for own, new in ((self.prefix, prefix), (self.word, word), (self.link, link)):
                    own.append(new)
                at = np.full(len(codes), -1)
                at[ends] = place
            going = np.append(False, at[:-1] >= 0)[ends]  # not for the first string of this length of a piece
            last.append(at[ends] if length == depth else at[ends[~going]])
            ends = ends[going]
        self.count = [np.bincount(x, minlength=len(k)) for x, k in zip(last, keys)]
        for length in range(depth - 1, 0, -1):
            self.count[length - 1] += np.bincount(self.link[length], self.count[length], len(keys[length - 1])).astype(np.int64)

    def hashes(self, words: np.ndarray) -> list[np.ndarray]:
        """A hash for each string, from those of the words."""
        out = [words]
        for prefix, word in zip(self.prefix[1:], self.word[1:]):
            out.append(_mixed(out[-1][prefix], words[word]))
        return out


def _word_hashes(known: list[tuple[str, bytes]]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.array([xxh3_64_intdigest(lang.encode() + b"\0" + word) for lang, word in known], np.uint64)


def _has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = ((hashes >> np.uint64(64 - HASH)) % np.uint64(FILTER)).astype(np.int64)
    return bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def _hashed(texts: DataFrame, length: int, least: int, bits: np.ndarray | None, shard: int, bins: int) -> DataFrame:
    """Rows (part, kind, data): by bin the sorted hashes, each with its count in the low bits, of the strings of ``length`` whose prefix and suffix may be
    frequent. The first time words come along."""
    low = least.bit_length()
    shared = None if bits is None else texts.sparkSession.sparkContext.broadcast(bits)

    def block(held: list[np.ndarray]) -> pa.RecordBatch:
        x = np.sort(np.concatenate(held))
        first, _ = _groups(x >> np.uint64(low))
        count = np.minimum(np.add.reduceat((x & np.uint64((1 << low) - 1)).astype(np.int64), first), (1 << low) - 1) if len(x) else np.zeros(0, np.int64)
        x = x[first] >> np.uint64(low) << np.uint64(low) | count.astype(np.uint64)
        return _blocks((x >> np.uint64(low)) * np.uint64(bins) >> np.uint64(HASH), 0, x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for known, codes in shards(batches, shard):
            found = Automaton(codes, len(known), length)
            hashes = found.hashes(_word_hashes(known))
            for n in range(length) if shared is None else [length - 1]:
                h, count = hashes[n], found.count[n]
                if shared is not None:
                    good = _has(shared.value, hashes[n - 1])
                    good = good[found.prefix[n]] & good[found.link[n]]
                    h, count = h[good], count[good]
                held.append(h >> np.uint64(64 - HASH) << np.uint64(low) | np.minimum(count, (1 << low) - 1).astype(np.uint64))
                size += len(h)
            if size > HELD:
                yield block(held)
                held, size = [], 0
        if held:
            yield block(held)

    return texts.mapInArrow(run, BLOCKS)


def _bits(hashed: DataFrame, least: int) -> np.ndarray:
    """The filter of the hashes whose counts add up to ``least``: at most FILTER bits come to the driver."""
    low = least.bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (x,) in _by_part(batches, np.uint64):
            x = np.sort(x)
            first, _ = _groups(x >> np.uint64(low))
            often = np.add.reduceat((x & np.uint64((1 << low) - 1)).astype(np.int64), first) >= least
            yield pa.RecordBatch.from_arrays([pa.array((x[first[often]] >> np.uint64(low)).astype(np.int64) % FILTER)], names=["at"])

    bit = F.col("at") + 1
    out = np.zeros(FILTER >> 3, np.uint8)
    often = _gathered(hashed).mapInArrow(run, "at long")
    for row in often.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect():
        own = np.frombuffer(row.bits, np.uint8)
        out[(row.bucket - 1) * len(own) : row.bucket * len(own)] = own
    return out


def _listed(texts: DataFrame, depth: int, bits: np.ndarray, shard: int, bins: int) -> DataFrame:
    """Rows (part, n, size, data): by bin the counts of the strings that may be frequent, and these, in order, compressed. A string begins with its language
    and a mark; without a phrase after it, it counts how many words the language has."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def blocks(held: dict[bytes, int]) -> pa.RecordBatch:
        from xxhash import xxh3_64_intdigest

        keys = sorted(held)
        part = np.fromiter((xxh3_64_intdigest(k) % bins for k in keys), np.int64, len(keys))
        order = np.argsort(part, kind="stable")
        starts, sizes = _groups(part[order])
        data = []
        for a, n in zip(starts.tolist(), sizes.tolist()):
            own = [keys[i] for i in order[a : a + n].tolist()]
            data.append(np.fromiter((held[k] for k in own), np.int64, n).tobytes() + _BREAK.join(own))
        held.clear()
        columns = [pa.array(part[order][starts]), pa.array(sizes, pa.int32()), pa.array(list(map(len, data)), pa.int32()), pa.array([pa.compress(d, CODEC, asbytes=True) for d in data], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["part", "n", "size", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for known, codes in shards(batches, shard):
            found = Automaton(codes, len(known), depth)
            hashes = found.hashes(_word_hashes(known))
            spelt, first = [word for _, word in known], [lang.encode() + _END + word for lang, word in known]
            for (lang, _), n in zip(known, found.count[0].tolist()):
                key = lang.encode() + _END
                held[key] = held.get(key, 0) + n
            for n in range(depth):
                at = own = np.flatnonzero(_has(shared.value, hashes[n]))
                words = []
                for k in range(n, -1, -1):
                    words.append([(spelt if k else first)[i] for i in found.word[k][at].tolist()])
                    at = found.prefix[k][at]
                for key, count in zip(map(b" ".join, zip(*words[::-1])), found.count[n][own].tolist()):
                    held[key] = held.get(key, 0) + count
            if len(held) > KEPT:
                yield blocks(held)
        if held:
            yield blocks(held)

    return texts.mapInArrow(run, "part long, n int, size int, data binary")


def _summed(listed: DataFrame, least: int) -> DataFrame:
    """Rows (lang, phrase BINARY, words, n) of the strings whose counts add up to ``least``."""

    def rows(held: dict[bytes, int]) -> pa.RecordBatch:
        often = [(*k.split(_END, 1), n) for k, n in held.items() if n >= least or k.endswith(_END)]
        langs, phrases, counts = zip(*often) if often else ((), (), ())
        columns = [pa.array(langs, pa.binary()), pa.array([p or None for p in phrases], pa.binary()), pa.array([p.count(b" ") + 1 if p else 0 for p in phrases], pa.int32()), pa.array(counts, pa.int64())]
        held.clear()
        return pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "words", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:
            for part, n, size, data in zip(*(batch.column(c).to_pylist() for c in ("part", "n", "size", "data"))):
                if part != now and held:
                    yield rows(held)
                now, data = part, pa.decompress(data, size, CODEC, asbytes=True)
                for key, count in zip(data[8 * n :].split(_BREAK), np.frombuffer(data, np.int64, n).tolist()):
                    held[key] = held.get(key, 0) + count
        if held:
            yield rows(held)

    return _gathered(listed).mapInArrow(run, "lang binary, phrase binary, words int, n long")


def counted(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, lang_col: str = "lang", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """Rows (lang, phrase, words, n) of all phrases of up to ``depth`` words that a language has ``least`` times; those without a phrase count the language's
    words. The table is written in the shared folder."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    bits, bins = None, min(BINS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 << (64 - HASH))
    for length in range(min(2, depth), depth + 1):
        new = _bits(_hashed(texts, length, least, bits, shard, bins), least)
        bits = new if bits is None else bits | new
    rows = _summed(_listed(texts, depth, bits, shard, bins), least)
    return settle(rows.select(F.col("lang").cast("string").alias("lang"), F.col("phrase").cast("string").alias("phrase"), "words", "n"))


def mined(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, top: int = TOP, lang_col: str = "lang", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two to ``depth`` words that no longer one stands for."""
    table = counted(docs, depth, least, lang_col, text_col, shard)
    known = table.where("phrase is not null")
    of = lambda name, n: known.select(F.col("lang").alias(f"{name}_lang"), F.col("phrase").alias(f"{name}_phrase"), F.col("n").alias(n))
    on = lambda name: (F.col("lang") == F.col(f"{name}_lang")) & (F.col(name) == F.col(f"{name}_phrase"))
    cut = known.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    part = lambda n: F.call_function("substring_index", F.col("phrase"), F.lit(" "), n)  # noqa: E731  the first n words, or the last -n
    cut = cut.withColumns({"first": part(F.col("k")), "rest": part(F.col("k") - F.col("words"))})
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    cut = cut.join(of("first", "l"), on("first")).join(of("rest", "r"), on("rest")).withColumns({"up": (whole("a") * whole("a")).cast("decimal(31,0)") * F.lit(1000000).cast("decimal(7,0)"), "down": whole("l") * whole("r")})
    scored = cut.select("lang", "phrase", "a", F.struct(F.expr("up div down").alias("score"), "k", "l", "r").alias("cut"), F.lit(None).cast("long").alias("longer"))
    ends = F.explode(F.array(part(F.col("words") - 1), part(1 - F.col("words"))))
    longer = known.where("words > 2").select("lang", ends.alias("phrase"), F.lit(None).cast("long").alias("a"), F.lit(None).cast(scored.schema["cut"].dataType).alias("cut"), F.col("n").alias("longer"))
    joined = scored.union(longer).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min("cut").alias("cut"), F.max("longer").alias("longer"))
    left = joined.where("a is not null and (longer is null or 100 * longer < 50 * a)").select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = left.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*best))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    totals = table.where("phrase is null").select(F.col("lang").alias("t_lang"), F.col("n").alias("n"))
    return ranked.join(totals, F.col("lang") == F.col("t_lang")).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
