"""Token sequences with the places of their options, and batches of them as padded arrays."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.operators.questions import LEAST


@dataclass(frozen=True)
class Marks:
    """Ids of the tokens that stand around the parts of a sequence, of what stands for a cut, and of padding."""

    state: int
    question: int
    open: int
    close: int
    decide: int
    cut: Sequence[int] = ()
    pad: int = 0


def query_size(question: Column, options: Column) -> Column:
    """Tokens of everything but the state."""
    return F.size(question) + F.aggregate(options, F.lit(3), lambda n, o: n + F.size(o) + 2)


def fits(state: Column, question: Column, options: Column, longest: int, marks: Marks, least: int = LEAST) -> Column:
    """Whether the question and the options are seen whole, with the state or ``least`` tokens of it and the cut."""
    return F.lit(longest) - query_size(question, options) >= F.least(F.size(state), F.lit(least + len(marks.cut)))


def assembled(rows: DataFrame, longest: int, marks: Marks, state: str = "state", question: str = "question", options: str = "options") -> DataFrame:
    """``rows`` with ids ARRAY<INT> and closes ARRAY<INT>, the places (from 0) of the tokens that close the options. A sequence over ``longest`` loses the
    middle of its state. Rows of which not enough would be seen have nulls."""
    s, q, o = F.col(state), F.col(question), F.col(options)
    ints = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<int>")
    room = F.col("c_room")
    keep = room - len(marks.cut)
    head = F.floor(keep / 2).cast("int")
    cut = F.concat(F.slice(s, F.lit(1), head), ints(marks.cut), F.slice(s, F.size(s) - (keep - head) + 1, keep - head))
    listed = F.flatten(F.transform(o, lambda x: F.concat(ints([marks.open]), x, ints([marks.close]))))
    made = rows.withColumns({"c_room": F.lit(longest) - query_size(q, o), "c_fits": fits(s, q, o, longest, marks)})
    made = made.withColumn("c_state", F.when(F.col("c_fits"), F.when(F.size(s) > room, cut).otherwise(s)))
    begin = F.size("c_state") + F.size(q) + 1
    closes = F.transform(o, lambda x, i: F.aggregate(F.slice(o, F.lit(1), i + 1), begin, lambda n, y: n + F.size(y) + 2))
    ids = F.concat(ints([marks.state]), F.col("c_state"), ints([marks.question]), q, listed, ints([marks.decide]))
    return made.withColumns({"ids": ids, "closes": F.when(F.col("c_state").isNotNull() & q.isNotNull(), closes)}).drop("c_room", "c_fits", "c_state")


def skipped(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows (keys, n, skipped): how many rows of :func:`assembled` there are, and how many have no sequence, as not enough of them would be seen."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("ids").isNull()).alias("skipped"))


def collated(rows: DataFrame, batch: str, order: str, pad: int = 0) -> DataFrame:
    """A row for each batch: rows ARRAY (the values of ``order``), width and slots (of its longest row and its widest one), and as arrays of arrays ids, there
    (1 where a token is), closes, open (true where an option is) and label, filled up with ``pad``, 0, 0, false and 0. Rows without ids are left out. A
    batch has a bounded number of tokens, which bounds the row."""
    told = F.struct(F.col(order).alias("row"), "ids", "closes", F.col("label").cast("array<double>").alias("label"))
    held = rows.where(F.col("ids").isNotNull()).groupBy(batch).agg(F.array_sort(F.collect_list(told)).alias("r"), F.max(F.size("ids")).alias("width"), F.max(F.size("closes")).alias("slots"))
    filled = lambda of, to, with_: F.transform("r", lambda x: F.concat(of(x), F.array_repeat(with_, F.col(to) - F.size(of(x)))))
    ones = lambda c, value: (lambda x: F.transform(x[c], lambda _: F.lit(value)))
    return held.select(
        batch, F.transform("r", lambda x: x["row"]).alias("rows"), "width", "slots", filled(lambda x: x["ids"], "width", F.lit(pad)).alias("ids"), filled(ones("ids", 1), "width", F.lit(0)).alias("there"),
        filled(lambda x: x["closes"], "slots", F.lit(0)).alias("closes"), filled(ones("closes", True), "slots", F.lit(False)).alias("open"), filled(lambda x: x["label"], "slots", F.lit(0.0)).alias("label"))


def separate(batches: DataFrame, batch: str) -> DataFrame:
    """The rows of batches again: (batch, row, ids, closes, label), without what they were filled up with."""
    each = batches.select(batch, F.explode(F.arrays_zip("rows", "ids", "there", "closes", "open", "label")).alias("b"))
    n, k = F.aggregate("b.there", F.lit(0), lambda a, x: a + x), F.size(F.filter("b.open", lambda x: x))
    return each.select(batch, F.col("b.rows").alias("row"), F.slice("b.ids", F.lit(1), n).alias("ids"), F.slice("b.closes", F.lit(1), k).alias("closes"), F.slice("b.label", F.lit(1), k).alias("label"))
