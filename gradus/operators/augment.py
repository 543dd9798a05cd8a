"""Variants of samples for training: orders of options, fewer options, a none option; weighted draws and the learning rate."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.functions import row
from gradus.operators.metrics import first_max

NONE_TEXT = "None of the above"


def _chance(salt: str, key: Column) -> Column:
    """A number in [0, 1) from the key."""
    return row.bucket(F.concat(F.lit(f"{salt}:"), key), 1_000_000) / 1_000_000.0


def _certain(label: Column) -> Column:
    return F.array_max(label) >= 1.0


def _kept(pairs: Column) -> dict[str, Column]:
    return {"options": F.transform(pairs, lambda p: p["options"]), "label": F.transform(pairs, lambda p: p["label"])}


def reordered(samples: DataFrame, key: Column) -> DataFrame:
    """Options in a seeded order, the label with them."""
    return samples.withColumns(_kept(row.shuffled(F.arrays_zip("options", "label"), key)))


def fewer_options(samples: DataFrame, key: Column, chance: float) -> DataFrame:
    """With ``chance``, 1 to n - 2 of the wrong options go. Rows with two options or a soft label stay as they are."""
    pairs = F.arrays_zip("options", "label")
    n = F.size("options")
    gone = row.bucket(F.concat(F.lit("gone:"), key), 1_000_003) % F.greatest(n - 2, F.lit(1)) + 1
    wrong = row.shuffled(F.filter(F.transform("label", lambda y, i: F.when(y < 1.0, i)), lambda i: i.isNotNull()), F.concat(F.lit("count:"), key))
    drop = F.when(_certain(F.col("label")) & (n > 2) & (_chance("drop", key) < chance), F.slice(wrong, F.lit(1), gone)).otherwise(F.array().cast("array<int>"))
    # set aside before the two lists are cut by it, so that both are cut alike
    made = samples.withColumn("f_drop", drop)
    return made.withColumns(_kept(F.filter(pairs, lambda p, i: ~F.array_contains("f_drop", i)))).drop("f_drop")


def without_answer(samples: DataFrame, key: Column, chance: float, none: str = NONE_TEXT) -> DataFrame:
    """With ``chance`` the true option's text gives way to a none option, which keeps the label. Soft labels and rows that have a none option
    stay as they are."""
    there = F.exists("options", lambda o: o["text"] == none)
    place = first_max(F.col("label")) - 1
    swapped = F.transform("options", lambda o, i: F.struct(o["id"].alias("id"), F.when(i == place, none).otherwise(o["text"]).alias("text")))
    return samples.withColumn("options", F.when(_certain(F.col("label")) & ~there & (_chance("none", key) < chance), swapped).otherwise(F.col("options")))


def encoded_length(question: Column, options: Column) -> Column:
    """Tokens of a row but for its state: question ARRAY, options ARRAY<ARRAY>, two marks for each option and three more."""
    return F.size(question) + F.aggregate(options, F.lit(0), lambda a, o: a + F.size(o) + 2) + 3


def fits(state: Column, question: Column, options: Column, longest: int, least: int = 16) -> Column:
    """Whether at least ``least`` tokens of the state and a mark (or all of it) have room."""
    return F.lit(longest) - encoded_length(question, options) >= F.least(F.size(state), F.lit(least + 1))


def learning_rate(step: Column, warmup: int, steps: int) -> Column:
    """Up in a line for ``warmup`` steps, then a cosine down to 0 at ``steps``."""
    done = F.least((step - warmup) / float(max(1, steps - warmup)), F.lit(1.0))
    return F.when(step < warmup, (step + 1) / float(max(1, warmup))).otherwise(0.5 * (1 + F.cos(done * math.pi)))


def drawn(samples: DataFrame, row_id: str, draws: int, alpha: float = 0.5, seed: str = "0", shares: int = 256) -> DataFrame:
    """``samples`` with draws BIGINT: ``draws`` draws with replacement, a dataset's chance in proportion to n**alpha, its rows alike.

    A draw picks a share of a dataset (a hash cuts each into ``shares``, so that none is one task) and a place in it, by the draw's
    hash; places that were drawn are counted before they meet the rows. What is joined to the draws is a row for each share."""
    share = samples.withColumn("d_share", row.bucket(F.concat(F.lit("share:"), F.coalesce(F.col(row_id).cast("string"), F.lit(""))), shares))
    sizes = share.groupBy("dataset", "d_share").agg(F.count("*").alias("n"))
    totals = sizes.groupBy("dataset").agg(F.sum("n").alias("total"))
    weight = F.col("n") / F.col("total") * F.pow("total", F.lit(alpha))
    up = Window.orderBy("dataset", "d_share")
    ends = sizes.join(totals, "dataset").withColumn("w", weight).withColumn("to", F.sum("w").over(up)).withColumn("high", F.col("to") / F.max("to").over(Window.partitionBy()))
    ends = ends.withColumn("low", F.coalesce(F.lag("high").over(up), F.lit(0.0)))
    # cells of the unit interval tie a draw to the few shares that meet its cell
    cells = 4096
    ends = ends.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1)))))
    u = row.bucket(F.concat(F.lit(f"draw:{seed}:"), F.col("id").cast("string")), 1 << 30) / float(1 << 30)
    made = samples.sparkSession.range(draws).withColumn("u", u).withColumn("u_cell", F.floor(F.col("u") * cells))
    hit = made.join(ends, (F.col("u_cell") == F.col("cell")) & (F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")))
    place = row.bucket(F.concat(F.lit(f"place:{seed}:"), F.col("id").cast("string")), 1 << 30) % F.col("n") + 1
    counts = hit.groupBy(F.col("dataset").alias("h_dataset"), F.col("d_share").alias("h_share"), place.alias("h_place")).agg(F.count("*").alias("draws"))
    placed = share.withColumn("d_at", F.row_number().over(Window.partitionBy("dataset", "d_share").orderBy(row_id)))
    met = placed.join(counts, (F.col("dataset") == F.col("h_dataset")) & (F.col("d_share") == F.col("h_share")) & (F.col("d_at") == F.col("h_place")))
    return met.drop("h_dataset", "h_share", "h_place", "d_share", "d_at")
