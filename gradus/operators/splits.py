"""The split algebra: canonical splits, disjoint groups without duplicates, carving of missing splits, caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.functions import row
from gradus.operators.numbered import smallest

#: Percent carved for each missing split from train, or for test and validation of data without train.
CARVED, RESPLIT = 5, 10


def canonical(split: Column) -> Column:
    """dev, val and validation are validation, test is test, all other names train."""
    return F.when(split.isin("dev", "val", "validation"), "validation").when(split == "test", "test").otherwise("train")


def regroup(samples: DataFrame) -> DataFrame:
    """``samples`` with the columns target (the split that a row ends in), home and from: duplicates dropped, the held-out copy kept; a
    group whole in its most held-out split; missing splits carved by the hash of the group or content.

    Of each content, told by a hash, the first row is taken by an aggregate, and the most held-out split of a group is one joined back: both are
    combined before anything moves, so that many copies or a large group are no single task's rows. The flags of which splits exist are
    one row for each dataset, of the same rows that are kept, so that their shuffle serves both."""
    prio = F.when(F.col("split") == "test", 0).when(F.col("split") == "validation", 1).otherwise(2)
    key = row.group_key(F.col("group"), F.col("state"), F.col("question"))
    content = F.md5(F.to_json(F.struct("state", "question", "options", "label")).cast("binary"))
    keyed = samples.withColumn("from", F.col("split")).withColumn("split", canonical(F.col("split"))).withColumns({"prio": prio, "g_key": key, "content": content})
    first = F.struct("prio", "pos", "from", "g_key")
    home = keyed.groupBy("dataset", "g_key").agg(F.min("prio").alias("home"))
    whole = keyed.groupBy("dataset", "content").agg(F.min_by(F.struct(*[c for c in keyed.columns if c not in ("dataset", "content")]), first).alias("r"))
    placed = whole.select("dataset", "content", "r.*").join(home, ["dataset", "g_key"])
    there = placed.groupBy("dataset").agg(*[F.max(F.when(F.col("home") == i, 1).otherwise(0)).alias(f"has_{s}") for i, s in enumerate(("test", "val", "train"))])
    b = row.bucket(row.held_out_key(F.col("group"), F.col("state"), F.col("question")))
    test_cut = F.when(F.col("has_test") == 0, CARVED).otherwise(0)
    target = (
        F.when((F.col("has_train") == 0) & (b < RESPLIT), "test").when((F.col("has_train") == 0) & (b < 2 * RESPLIT), "validation").when(F.col("has_train") == 0, "train")
        .when(F.col("home") == 0, "test").when(F.col("home") == 1, "validation")
        .when(b < test_cut, "test").when((F.col("has_val") == 0) & (b < test_cut + CARVED), "validation").otherwise("train")
    )
    return placed.join(there, "dataset").withColumn("target", target).drop("content")


def counts(samples: DataFrame) -> DataFrame:
    """Rows (dataset, from_split, to_split, n): where the rows that are kept went."""
    return regroup(samples).groupBy("dataset", F.col("split").alias("from_split"), F.col("target").alias("to_split")).agg(F.count("*").alias("n"))


def cap(samples: DataFrame, most: int, split: str = "split") -> DataFrame:
    """At most ``most`` rows of each dataset and split, those of the smallest content hash; the source's order stays in pos."""
    content = row.sha1(F.concat_ws("\x1f", "state", "question", F.col("pos").cast("string")))
    return smallest(samples, ("dataset", split), content, most, "pos")


def without_shared(samples: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Drops rows whose ``key`` a more held-out split has: test over validation over train. A key's most held-out split is one row, combined
    before it moves; rows without a key share none."""
    prio = F.when(F.col(split) == "test", 0).when(F.col(split) == "validation", 1).otherwise(2)
    home = samples.where(F.col(key).isNotNull()).groupBy(F.col("dataset").alias("w_d"), F.md5(F.col(key).cast("string").cast("binary")).alias("w_k")).agg(F.min(prio).alias("w_h")).where("w_h < 2")
    keyed = samples.withColumns({"w_p": prio, "w_c": F.md5(F.col(key).cast("string").cast("binary"))})
    lower = (F.col("dataset") == F.col("w_d")) & (F.col("w_c") == F.col("w_k")) & (F.col("w_p") > F.col("w_h"))
    return keyed.join(home, lower, "left_anti").drop("w_p", "w_c")


def split_by(key: Column, tenths: dict[str, int]) -> Column:
    """A split by content: of ten buckets of the key's hash the first go to the splits of ``tenths`` in order, the rest to train. A null key
    counts as empty."""
    b, low, out = row.bucket(F.coalesce(key, F.lit("")), 10), 0, F.lit("train")
    for name, n in tenths.items():
        out = F.when((b >= low) & (b < low + n), name).otherwise(out)
        low += n
    return out
