"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text's features are hashed words and their first letters (log counts, scaled to length 1 a text) and the shares of a few word shapes. One
weight vector serves all grades; ordered thresholds t_0 < t_1 < ... cut its score s: P(grade <= k) = 1 / (1 + exp(s - t_k)). The expected
grade and the tail probability P(grade >= g) select.

The fit takes a bounded sample of the labelled rows (``rows``, by the hash of their ids, the same at every run) in one task; scoring goes
over all texts, batch by batch, with the weights (1 MB at 2**18 features) broadcast.

Defined results: a null text is empty; a text without words scores on the constant feature alone; labels that are null or whose id no
text has take no part; repeated labels or ids count as often as they stand; with no usable label the score is 0 and all thresholds are
0, 1, ...; result columns replace input columns of the same name.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hashed features; the first SHAPES of them are kept for shapes.
FEATURES, SHAPES = 1 << 18, 8
#: Rows of the sample that the fit takes at most.
SAMPLE_ROWS = 12_000
PREFIX = 4
#: Bytes of text that are turned into features at a time, but for longer texts.
CHUNK = 1 << 20

BASE = 0x9E3779B97F4A7C15 | 1
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_UPPER, _SYMBOL, _STOP = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_SYMBOL[[ord(c) for c in "#*$%&|<>{}[]~^=_+@\\"]] = True
_STOP[[ord(c) for c in "!?"]] = True
_powers = [np.ones(1, np.uint64)] * 2


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of BASE and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            _powers[i] = np.append(np.uint64(1), np.cumprod(np.full(n - 1, base, np.uint64)))
    return _powers[0][:n], _powers[1][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ x >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)) >> np.uint64(20)


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, feature, value) of the features that are not 0, by text, then feature. The hash of a word is a polynomial in its
    bytes that is read off running sums over all texts at once: sums up to its end, less sums up to its start, shifted to one place."""
    encoded = [(t or "").encode() for t in texts]
    sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
    data = np.frombuffer(b" ".join(encoded) + b" ", np.uint8)
    ends = np.cumsum(sizes + 1)
    inside = np.append(_WORD[data], False)
    edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0))
    starts, stops = edges[::2], edges[1::2]
    text_of = np.searchsorted(ends, starts, side="right")
    power, back = _power(len(data) + 1)
    sums = np.append(np.uint64(0), np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * power[:-1]))
    hashed = lambda a, b: (sums[b] - sums[a]) * back[a]  # noqa: E731  shifts a word to place 0
    word = hashed(starts, stops)
    short = np.minimum(stops, starts + PREFIX)
    room = np.uint64(FEATURES - SHAPES)
    both = np.concatenate([_mixed(word), _mixed(hashed(starts, short) ^ np.uint64(0x5851F42D4C957F2D))]) % room + np.uint64(SHAPES)
    keys = np.sort(np.concatenate([text_of, text_of]).astype(np.uint64) << np.uint64(20) | both)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(keys)))
    of, feature = (keys[first] >> np.uint64(20)).astype(np.int64), (keys[first] & np.uint64((1 << 20) - 1)).astype(np.int64)
    value = np.log1p(counts)
    value /= np.sqrt(np.bincount(of, value**2, len(texts)))[of]
    n_words = np.bincount(text_of, minlength=len(texts))
    per_word = lambda x: np.minimum(x / np.maximum(n_words, 1), 1.0)
    byte_text = np.repeat(np.arange(len(texts)), sizes + 1)
    number = lambda mask: np.bincount(byte_text[mask[data]], minlength=len(texts))
    uppers = np.append(0, np.cumsum(_UPPER[data]))
    loud = (uppers[stops] - uppers[starts] > 1) & (2 * (uppers[stops] - uppers[starts]) > stops - starts)
    again = np.append(False, (word[1:] == word[:-1]) & (text_of[1:] == text_of[:-1])) if len(word) else np.zeros(0, bool)
    of_words = lambda mask: np.bincount(text_of[mask], minlength=len(texts))
    shapes = np.stack([np.ones(len(texts)), per_word(of_words(loud)), per_word(of_words(again)), per_word(number(_SYMBOL)), per_word(number(_STOP)),
                       np.minimum(np.log1p(n_words), 3) / 3, (n_words < 20) * 1.0, per_word(of_words(stops - starts > 30))], 1)
    i, j = np.nonzero(shapes)
    of, feature, value = np.concatenate([i, of]), np.concatenate([j, feature]), np.concatenate([shapes[i, j], value])
    order = np.argsort(of, kind="stable")
    return of[order], feature[order], value[order].astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        of, feature, value = features(texts)
        return np.bincount(of, value * self.weights[feature], len(texts))

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... by row."""
        return _sigmoid(scores[:, None] - self.thresholds)


def fit_ordinal(of: np.ndarray, feature: np.ndarray, value: np.ndarray, grades: np.ndarray, n_grades: int, epochs: int = 40, rate: float = 3.0, batch: int = 256, decay: float = 1e-5, least_texts: int = 10) -> Model:
    """Adagrad on the log likelihood. Features of fewer than ``least_texts`` texts keep weight 0, as they only tell texts of the sample
    apart. Texts come in a fixed shuffled order; gaps between thresholds stay positive as they are exponents."""
    common = np.bincount(feature, minlength=FEATURES)[feature] >= least_texts
    of, feature, value = of[common], feature[common], value[common]
    n, weights, seen = len(grades), np.zeros(FEATURES, np.float64), np.full(FEATURES, 1e-6)
    low, gaps = -1.0, np.zeros(max(0, n_grades - 2))
    cuts = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int64)
    rng = np.random.default_rng(7)
    cut_seen = np.full(1 + len(gaps), 1e-6)
    for _ in range(epochs if n else 0):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            rows = order[at : at + batch]
            lengths = cuts[rows + 1] - cuts[rows]
            places = np.repeat(cuts[rows] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
            row = np.repeat(np.arange(len(rows)), lengths)
            f, v = feature[places], value[places]
            s = np.bincount(row, v * weights[f], len(rows))
            t = np.concatenate([[-np.inf], low + np.concatenate([[0], np.cumsum(np.exp(gaps))]), [np.inf]])
            y = grades[rows]
            a, b = np.where(y == n_grades - 1, 1.0, _sigmoid(np.clip(t[y + 1], -1e9, 1e9) - s)), np.where(y == 0, 0.0, _sigmoid(np.clip(t[y], -1e9, 1e9) - s))
            p = np.maximum(a - b, 1e-9)
            ds = a + b - 1
            g = np.bincount(f, v * ds[row], FEATURES) / len(rows) if len(f) > FEATURES // 8 else None
            if g is None:
                used, inverse = np.unique(f, return_inverse=True)
                g = np.bincount(inverse, v * ds[row], len(used)) / len(rows)
            else:
                used = np.flatnonzero(g)
                g = g[used]
            g -= decay * weights[used]
            seen[used] += g * g
            weights[used] += rate * g / np.sqrt(seen[used])
            dt = np.zeros(n_grades + 1)
            np.add.at(dt, y + 1, a * (1 - a) / p)
            np.add.at(dt, y, -b * (1 - b) / p)
            dt = dt[1:-1] / len(rows)
            step = np.concatenate([[dt.sum()], [dt[k + 1 :].sum() * np.exp(gaps[k]) for k in range(len(gaps))]])
            cut_seen += step**2
            step = 0.1 * rate * step / np.sqrt(cut_seen)
            low, gaps = low + step[0], np.clip(gaps + step[1:], -5, 3)
    if not n:
        return Model(weights.astype(np.float32), np.arange(n_grades - 1, dtype=np.float64))
    return Model(weights.astype(np.float32), low + np.concatenate([[0], np.cumsum(np.exp(gaps))]))


def fit(docs: DataFrame, labels: DataFrame, grade: Column, n_grades: int, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> Model:
    """A model of ``grade`` (0 to n_grades - 1, of the columns of ``labels``) from ``rows`` labelled texts at most. Ids are of any type; those that are
    no whole numbers are told by hash."""
    chosen = labels.select(F.col(id_col).alias("q_id"), grade.cast("int").alias("q_grade")).where("q_id is not null and q_grade is not null")
    chosen = chosen.orderBy(F.xxhash64("q_id"), "q_id", "q_grade").limit(rows)
    number = F.col("q_id").cast("long") if isinstance(labels.schema[id_col].dataType, T.IntegralType) else F.xxhash64("q_id")
    texts = docs.select(F.col(id_col).alias("q_doc"), F.col(text_col).alias("q_text")).join(F.broadcast(chosen), F.col("q_doc") == F.col("q_id")).select(number.alias("q_number"), "q_grade", "q_text")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 2):
                of, feature, value = features(part.column(2).to_pylist())
                at = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(part)))]).astype(np.int32))
                columns = [part.column(0), part.column(1), pa.ListArray.from_arrays(at, pa.array(feature.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(value))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "grade", "feature", "value"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, grades, lengths, feature, value = [], [], [], [], []
        for b in batches:
            ids.append(b.column(0).to_numpy())
            grades.append(b.column(1).to_numpy())
            lengths.append(np.diff(b.column(2).offsets.to_numpy()))
            feature.append(b.column(2).flatten().to_numpy())
            value.append(b.column(3).flatten().to_numpy())
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        ids, grades, lengths, feature, value = join(ids, np.int64), join(grades, np.int64), join(lengths, np.int64), join(feature, np.int32), join(value, np.float32)
        order = np.lexsort((lengths, grades, ids))  # the same order, however the rows came
        starts = np.cumsum(lengths) - lengths
        places = np.repeat(starts[order] - np.cumsum(lengths[order]) + lengths[order], lengths[order]) + np.arange(lengths.sum())
        of = np.repeat(np.arange(len(order)), lengths[order])
        good = np.clip(grades[order], 0, n_grades - 1).astype(np.int64)
        model = fit_ordinal(of, feature[places], value[places], good, n_grades)
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps((model.weights, model.thresholds))]})

    # an id may stand for any number of texts, so the bound holds again after the join
    bounded = texts.mapInArrow(featured, "id long, grade int, feature array<int>, value array<float>").orderBy(F.xxhash64("id"), "id", "grade", F.xxhash64("feature", "value")).limit(rows)
    found = bounded.coalesce(1).mapInArrow(fitted, "model binary").collect()
    return Model(*pickle.loads(found[0].model))


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    from gradus.llm.bpe import _chunks

    yield from _chunks(iter([batch]), batch.schema.names[column], CHUNK)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with expected_grade DOUBLE and tails ARRAY<DOUBLE>: P(grade >= 1), P(grade >= 2), ..."""
    more = {"expected_grade": T.DoubleType(), "tails": T.ArrayType(T.DoubleType())}
    schema = T.StructType([*[f for f in docs.schema.fields if f.name not in more], *[T.StructField(k, v) for k, v in more.items()]])
    names, shared = schema.names, docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, batch.schema.names.index(text_col)):
                tails = shared.value.tails(shared.value.scores(part.column(text_col).to_pylist()))
                at = pa.array((np.arange(len(part) + 1) * tails.shape[1]).astype(np.int32))
                columns = {c: part.column(c) for c in part.schema.names} | {"expected_grade": pa.array(tails.sum(1)), "tails": pa.ListArray.from_arrays(at, pa.array(tails.ravel()))}
                yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return docs.mapInArrow(run, schema)


#: The rating of the tables here: a point for quality, a point for not being toxic.
GRADES, GOOD = 3, 2
#: Least probability of the best grade that is accepted.
ACCEPT = 0.8


def rating() -> Column:
    return F.col("quality") + 1 - F.col("toxic")
