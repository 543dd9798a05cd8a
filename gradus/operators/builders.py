"""Builders of sample rows, one for each way in which sources turn into state, question, options and label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.functions import row
from gradus.operators import rings


def sample(df: DataFrame, dataset: str, state: Column, question: Column, options: Column, label: Column, pos: Column, split: Column | None = None, group: Column | None = None) -> DataFrame:
    """The sample row; label is an id of the options (a string) or a distribution over them."""
    shaped = df.select(
        F.lit(dataset).alias("dataset"), (F.lit("train") if split is None else split).alias("split"), pos.cast("long").alias("pos"), F.coalesce(state, F.lit("")).alias("state"),
        question.alias("question"), options.alias("options"), label.alias("label"), (F.lit(None).cast("string") if group is None else group).alias("group"),
    )
    if dict(shaped.dtypes)["label"] == "string":
        shaped = shaped.withColumn("label", row.one_hot(F.col("options"), F.col("label")))
    return shaped.withColumn("type", row.kind(F.col("options"))).select(*row.SAMPLE)


def class_names(df: DataFrame, column: str) -> list[str]:
    """The distinct values in order: the answers of a dataset, a set that its author can read. More than 1,000 raise an error."""
    names = sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(1001).collect())
    if len(names) > 1000:
        raise ValueError(f"{column} has more than 1,000 values")
    return names


def yes_no(df: DataFrame, dataset: str, state: Column, question: Column, truth: Column, pos: Column, **more) -> DataFrame:
    return sample(df, dataset, state, question, row.options_of(["yes", "no"]), F.when(truth, "yes").otherwise("no"), pos, **more)


def one_of_each(df: DataFrame, dataset: str, state: Column, phrase: Column, candidates: Sequence[str], truth: Column, negatives: int, seed: Column, pos: Column, **more) -> DataFrame:
    """Flat map: a yes row for the true candidate and ``negatives`` no rows for others, in seeded order. phrase has the candidate in
    column ``candidate``."""
    others = F.slice(row.shuffled(F.filter(F.array(*[F.lit(c) for c in candidates]), lambda c: c != truth), seed), 1, negatives)
    flat = df.withColumn("candidate", F.explode(F.concat(F.array(truth), others)))
    return yes_no(flat, dataset, state, phrase, F.col("candidate") == truth, pos, **more)


def votes(df: DataFrame, item: str, answer: str, answers: Sequence[str]) -> DataFrame:
    """Rows (item, label): shares of the votes for ``answers`` in their order. Votes are counted by item and answer before items meet."""
    per = df.where(F.col(answer).isin(*answers)).groupBy(item, answer).agg(F.count("*").alias("n"))
    held = per.groupBy(item).agg(F.map_from_entries(F.collect_list(F.struct(answer, "n"))).alias("by"), F.sum("n").alias("total"))
    share = F.transform(F.array(*[F.lit(a) for a in answers]), lambda a: (F.coalesce(F.col("by")[a], F.lit(0)) / F.col("total")).cast("float"))
    return held.select(item, share.alias("label"))


def text_choice(rows: DataFrame, candidates: DataFrame, row_id: str, answer: str, candidate: str, tier: str | None = None, most: int = row.MAX_DISTRACTORS) -> DataFrame:
    """``rows`` with texts ARRAY<STRING> and place INT: the answer among up to ``most`` distinct others in seeded order.

    candidates: (row_id, candidate and, if given, tier): pairs from a bounded join. Blank ones and repeats of the answer or each other, up
    to case and outer spaces, go; those of the lowest tier come first, in the order of a seeded hash. Rows with no distractor are dropped."""
    folded = lambda c: F.lower(F.trim(c))
    pairs = candidates.join(rows.select(F.col(row_id).alias("t_id"), F.col(answer).alias("t_answer")), F.col(row_id) == F.col("t_id"))
    pairs = pairs.where((F.trim(candidate) != "") & (folded(F.col(candidate)) != folded(F.col("t_answer"))))
    order = [F.col(tier)] if tier else []
    h = row.sha1(F.concat(F.lit("distractors:"), F.col(row_id).cast("string"), F.lit(":"), F.col(candidate)))
    fresh = pairs.withColumn("t_h", h).withColumn("t_copy", F.row_number().over(Window.partitionBy(row_id, folded(F.col(candidate))).orderBy(*order, "t_h", candidate))).where("t_copy = 1")
    ranked = fresh.withColumn("t_n", F.row_number().over(Window.partitionBy(row_id).orderBy(*order, "t_h"))).where(F.col("t_n") <= most)
    wrong = ranked.groupBy(F.col(row_id).alias("t_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("t_n", candidate))), lambda x: x[candidate]).alias("t_wrong"))
    return _placed(rows.join(wrong, F.col(row_id) == F.col("t_id")), row_id, answer).drop("t_id", "t_wrong")


def bounded_candidates(rows: DataFrame, pool: DataFrame, row_id: str, key: str, pool_id: str, candidate: str, circle: int = rings.CIRCLE, reach: int = 24) -> DataFrame:
    """Pairs (row_id, from_id, candidate) of what :func:`rings.circled` draws; pairs grow with the rows, not with their square."""
    drawn = rings.circled(rows.select(row_id, key), pool, row_id, key, pool_id, candidate, reach, circle)
    return drawn.select(row_id, F.explode("drawn").alias("d")).select(row_id, F.col("d.id").alias("from_id"), F.col("d.entry").alias(candidate))


def drawn_choice(rows: DataFrame, row_id: str, answer: str, drawn: Column, most: int = row.MAX_DISTRACTORS) -> DataFrame:
    """As :func:`text_choice`, of candidates that each row has as a short array of texts."""
    folded = lambda c: F.lower(F.trim(c))
    keyed = F.transform(drawn, lambda c: F.struct(row.sha1(F.concat(F.lit("distractors:"), F.col(row_id).cast("string"), F.lit(":"), c)).alias("h"), c.alias("c"), folded(c).alias("f")))
    good = F.sort_array(F.filter(keyed, lambda x: (F.trim(x["c"]) != "") & (x["f"] != folded(F.col(answer)))))
    first_of = lambda g: row.bound(F.transform(g, lambda x: x["f"]), lambda fs: F.filter(g, lambda x, i: F.array_position(fs, x["f"]) == i + 1))
    wrong = F.transform(F.slice(row.bound(good, first_of), 1, most), lambda x: x["c"])
    # exploded from an array of one or none, so that rows are told without computing it twice
    made = rows.select("*", F.explode(F.filter(F.array(wrong), lambda w: F.size(w) > 0)).alias("t_wrong"))
    return _placed(made, row_id, answer).drop("t_wrong")


def _placed(rows: DataFrame, row_id: str, answer: str) -> DataFrame:
    texts = row.shuffled(F.concat(F.array(answer), F.col("t_wrong")), F.concat(F.lit("options:"), F.col(row_id).cast("string")))
    return rows.withColumn("texts", texts).withColumn("place", F.array_position("texts", F.col(answer)).cast("int"))


def own_options(df: DataFrame, dataset: str, state: Column, question: Column, texts: Column, place: Column, pos: Column, **more) -> DataFrame:
    """Options from an array of the row, lettered by place; ``place`` counts from 1. Rows whose place is not in the array, and rows with more
    texts than letters, are dropped."""
    fine = df.withColumns({"b_texts": texts, "b_place": place}).where((F.size("b_texts") <= len(row.LETTERS)) & F.col("b_place").between(1, F.size("b_texts")))
    return sample(fine, dataset, state, question, row.lettered(F.col("b_texts")), F.substring(F.lit(row.LETTERS), F.col("b_place").cast("int"), F.lit(1)), pos, **more)


def pool_choice(rows: DataFrame, row_id: str, key: str, answer: str, split: str = "split", most: int = row.MAX_DISTRACTORS) -> DataFrame:
    """``rows`` with texts and place: the answer among answers of train rows with the same key, so that no held-out answer is a wrong option.
    The pool has each answer of a key once; candidates are those of :func:`rings.circled`."""
    pool = rows.where(F.col(split) == "train").select(key, F.col(answer).alias("p_answer")).distinct()
    drawn = rings.circled(rows, pool, row_id, key, "p_answer", "p_answer", 24)
    return drawn_choice(drawn, row_id, answer, F.transform("drawn", lambda d: d["entry"]), most).drop("drawn")


def recorded(df: DataFrame, group: Column) -> DataFrame:
    """Rows (payload, group): a source's row as one struct, with the group that every sample made of it takes on."""
    return df.select(F.struct(*df.columns).alias("payload"), group.alias("group"))
