"""Mixing sources to target weights, with DataFrame functions only.

Each row gets a random key, the MD5 of seed, id and text. The key's leading digits deal the rows of a source into equal ranges, so that the
order (source, key) is a range sort whose bounds are known beforehand: a source with a third of all rows spreads over ``ranges`` groups, and
so do rows without an id. The prefix sum of the sizes is distributed: sums by range, a running sum over those few sums, a running sum
inside each range. A source whose budget is ``e`` times its size and a rest takes every row ``e`` times and, in key order, once more the words
before the cut, which falls at the exact budget: the row that it falls in is taken in part.

Defined results: a null text has size 0 and takes 0; a null source is a source of its own, last in order; equal rows are dealt one by one
(they share key and size, so that it does not matter which is which); an empty table gives an empty result; texts of any length count in whole;
other columns are not looked at, whatever their names. A budget is cut to whole words.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def budgets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """From (m_source, m_source_size), a row for each source: adds m_target. The sources in code-point order, null last, get ``weights``
    in turn and share ``share`` of the total; no target passes ``most`` times its source's size, what is over is shared again by weight.

    That is a water level: sources in order of size by weight are full up to some place, and the rest get the level times their weight.
    The table has one row for each named source, as many as the caller has weights to give."""
    turn = F.array(*[F.lit(float(w)) for w in weights])
    everything, by_fill = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("m_fill", "m_rank")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("m_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("m_source"))))
    filled = (
        ranked.withColumn("m_weight", F.element_at(turn, ((F.col("m_rank") - 1) % len(weights) + 1).cast("int")))
        .withColumn("m_cap", most * F.col("m_source_size"))
        .withColumn("m_fill", F.col("m_cap") / F.col("m_weight"))
        .withColumn("m_budget", share * F.sum("m_source_size").over(everything))
        .withColumn("m_open", F.sum("m_weight").over(everything) - F.coalesce(F.sum("m_weight").over(before), F.lit(0.0)))
        .withColumn("m_here", (F.col("m_budget") - F.coalesce(F.sum("m_cap").over(before), F.lit(0.0))) / F.col("m_open"))
    )
    level = F.min(F.when(F.col("m_fill") >= F.col("m_here"), F.struct("m_fill", "m_rank", "m_here"))).over(everything)
    target = F.least(F.col("m_cap"), F.coalesce(level["m_here"], F.lit(float("inf"))) * F.col("m_weight"))
    return filled.select("m_source", "m_source_size", target.alias("m_target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS,
        share: float = 1.5, most: float = 2.0, ranges: int = 256, seed: int = 17) -> DataFrame:
    """Rows (id_col, size, source_size, target, copies, taken, mix_key): the mix takes ``taken`` words of the row; ``copies`` are the whole copies that
    come nearest to that: the row in which the cut falls counts once more if half of it is taken. ``mix_key`` tells equal ids apart together with
    the id. Reruns agree: nothing depends on how rows are dealt to tasks."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("~")), F.lit(":"), F.coalesce(F.col(text_col), F.lit(""))).cast("binary"))
    slim = docs.select(
        F.col(id_col).alias("m_id"), F.col(source_col).alias("m_source"), words(F.col(text_col)).alias("m_size"), key.alias("m_key")
    ).withColumn("m_range", F.floor(F.conv(F.substring("m_key", 1, 6), 16, 10).cast("long") * ranges / (1 << 24)).cast("int"))
    by_range = slim.groupBy("m_source", "m_range").agg(F.sum("m_size").alias("m_sum"))
    before = Window.partitionBy("m_source").orderBy("m_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_range.withColumn("m_offset", F.coalesce(F.sum("m_sum").over(before), F.lit(0)))
    targets = budgets(by_range.groupBy("m_source").agg(F.sum("m_sum").alias("m_source_size")), weights, share, most)
    t = targets.withColumnRenamed("m_source", "t_source")
    plan = offsets.join(t, F.col("m_source").eqNullSafe(F.col("t_source"))).select("m_source", "m_range", "m_offset", "m_source_size", "m_target")
    p = plan.withColumnRenamed("m_source", "p_source").withColumnRenamed("m_range", "p_range")
    inside = Window.partitionBy("m_source", "m_range").orderBy("m_key", "m_id", "m_size").rowsBetween(Window.unboundedPreceding, -1)
    placed = slim.withColumn("m_before", F.coalesce(F.sum("m_size").over(inside), F.lit(0))).join(
        p, F.col("m_source").eqNullSafe(F.col("p_source")) & (F.col("m_range") == F.col("p_range"))
    )
    whole = F.when(F.col("m_source_size") > 0, F.floor(F.col("m_target") / F.col("m_source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.floor(F.col("m_target") - whole * F.col("m_source_size")).cast("long")
    part = F.greatest(F.least(rest - F.col("m_offset") - F.col("m_before"), F.col("m_size")), F.lit(0))
    copies = F.when(F.col("m_size") > 0, whole + F.when(2 * part >= F.col("m_size"), 1).otherwise(0)).otherwise(F.lit(0)).cast("long")
    return placed.select(
        F.col("m_id").alias(id_col), F.col("m_size").alias("size"), F.col("m_source_size").alias("source_size"), F.col("m_target").alias("target"),
        copies.alias("copies"), (whole * F.col("m_size") + part).alias("taken"), F.col("m_key").alias("mix_key"),
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of ``docs``, whole, each as often as ``copies`` says, with the columns of ``docs``. Rows of size 0 take no words and are not in the
    mix. Rows are told by id, source and text, and equal ones by a number among them."""
    told = F.md5(F.to_json(F.struct(F.col(id_col).alias("i"), F.col(source_col).alias("s"), F.col(text_col).alias("t"))))
    number = lambda key: F.row_number().over(Window.partitionBy(key).orderBy(F.lit(0)))
    slim = docs.select(told.alias("x_row"), F.col(text_col).alias("x_text"), F.col(source_col).alias("x_source"))
    taken = mix(slim, "x_row", "x_text", "x_source", **how).select(F.col("x_row").alias("y_row"), "copies").withColumn("y_no", number("y_row"))
    full = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("x_doc"), told.alias("x_row")).withColumn("x_no", number("x_row"))
    joined = full.join(taken.where("copies > 0"), (F.col("x_row") == F.col("y_row")) & (F.col("x_no") == F.col("y_no")))
    return joined.select("x_doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("x_doc.*")
