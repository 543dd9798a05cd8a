"""Quality rules as a short-circuit cascade.

Each task takes a bounded sample, the first texts that it reads. On it the order is built rule by rule: each rule that is left is run on the texts that
the rules taken so far keep, with the measures that those have made at hand, which gives its cost (seconds) and the share that it
rejects where it would run; the one with the most rejection per cost comes next. So a table is read once, and sources that differ get orders of
their own. The cascade stops at a document's first rejection. The order changes the time only: a document is kept if no rule rejects it.

Defined results: a null text is empty; words are runs of anything but the six ASCII white-space characters; rows are judged one by one, so
repeated rows get equal results; texts of any length are judged in whole, the last resort being a worker's memory for one text; an empty
table gives an empty result; the columns of the input are kept, result columns replace input columns of the same name.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SYMBOLS, SPACES = b"#*$%&|<>", " \t\n\r\x0b\x0c"
#: Texts of a task's sample, on which cost and selectivity are estimated.
SAMPLE = 48


class Text:
    """A text whose measures are taken when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def data(self) -> bytes:
        return self.text.encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.data) - len(self.data.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [line for line in self.text.split("\n") if line.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        """Lines with a word that equal an earlier one."""
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in three-word windows that the text has twice or more, the first ones included."""
        w = self.words
        windows = list(zip(w, w[1:], w[2:]))
        if len(set(windows)) == len(windows):
            return 0
        seen: dict[tuple, int] = {}
        for x in windows:
            seen[x] = seen.get(x, 0) + 1
        n, covered = 0, -1
        for i, x in enumerate(windows):
            if seen[x] > 1:
                n += i + 2 - max(covered, i - 1)
                covered = i + 2
        return n

    @cached_property
    def n_capitals(self) -> int:
        return sum(map(str.isupper, self.text)) if self.text.upper() == self.text else 0


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


#: The base rules.
BASE = (
    Rule("few_words", lambda t: t.n_words < 50),
    Rule("repeats", lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
)
#: Rules that the method adds. Ordinary prose is far from all of them.
MORE = (
    Rule("symbols", lambda t: 5 * t.n_symbols > t.n_words),
    Rule("duplicate_lines", lambda t: 2 * t.n_dup_lines > max(len(t.lines), 1)),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 20 * t.n_words),
    Rule("shouting", lambda t: 2 * t.n_capitals > t.word_chars),
)
RULES = BASE + MORE
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def estimate(texts: Sequence[str | None], rules: Sequence[Rule] = RULES) -> list[tuple[str, float, float]]:
    """(rule, seconds a text, share rejected) in the order of the cascade, of a sample of texts. Figures are of the texts that the rules before keep."""
    taken, left = [], list(rules)
    while left:
        found = []
        for rule in left:
            alive = [t for t in map(Text, texts) if not any(r.rejects(t) for r, *_ in taken)]
            began = time.perf_counter()
            rejected = sum(bool(rule.rejects(t)) for t in alive)
            found.append((rule, (time.perf_counter() - began) / max(1, len(alive)), rejected / max(1, len(alive))))
        taken.append(max(found, key=lambda f: f[2] / max(f[1], 1e-9)))
        left.remove(taken[-1][0])
    return [(r.name, cost, share) for r, cost, share in taken]


def ordered(rules: Sequence[Rule], estimates: Sequence[tuple[str, float, float]]) -> list[Rule]:
    """The rules by rejection per cost, highest first; equal ones as given."""
    worth = {name: share / max(cost, 1e-9) for name, cost, share in estimates}
    return sorted(rules, key=lambda r: -worth.get(r.name, 0.0))


def cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", measures: Sequence[str] = (), estimates: Sequence[tuple] | None = None, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with kept BOOLEAN and the ``measures`` asked for. Each task goes by the order of its own sample, or all by the given estimates of each rule alone."""
    more = {**{m: T.LongType() for m in measures}, "kept": T.BooleanType()}
    schema = T.StructType([*[f for f in docs.schema.fields if f.name not in more], *[T.StructField(k, v) for k, v in more.items()]])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = None if estimates is None else ordered(rules, estimates)
        for batch in batches:
            rows = []
            if order is None and len(batch):
                by_name = {r.name: r for r in rules}
                order = [by_name[name] for name, *_ in estimate(batch.column(text_col)[:sample].to_pylist(), rules)]
            for value in batch.column(text_col):
                t = Text(value.as_py())
                kept = not any(rule.rejects(t) for rule in order)
                rows.append((*[getattr(t, m) for m in measures], kept))
            columns = {c: batch.column(c) for c in batch.schema.names}
            for i, m in enumerate([*measures, "kept"]):
                columns[m] = pa.array([r[i] for r in rows], pa.bool_() if m == "kept" else pa.int64())
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return docs.mapInArrow(run, schema)
