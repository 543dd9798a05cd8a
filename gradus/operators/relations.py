"""Joins by which sources become samples: judged passages, rows of held-out splits, values that stand once, pairs by place, texts within texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.functions import row

#: Words of a key by which a text within texts is looked for, and characters of one where the text has too few words.
KEY_WORDS, KEY_CHARS = 5, 8


def judged(topics: DataFrame, judgments: DataFrame, corpus: DataFrame) -> DataFrame:
    """Rows (topic, query, passages ARRAY<STRUCT<passage, text, relevance>>, relevant) from (topic, query), (topic, passage, relevance) and
    (passage, text). Of a passage judged twice the higher relevance stands. Topics with a blank query, no judgment or a blank passage are left
    out; a passage that the corpus lacks and a relevance other than 0 and 1 raise an error. The passages of a topic are one row's array."""
    per = judgments.groupBy("topic", "passage").agg(F.max("relevance").alias("relevance")).join(corpus, "passage", "left")
    text = F.when(F.col("text").isNull(), F.raise_error(F.concat(F.lit("no such passage: "), F.col("passage").cast("string")))).otherwise(F.col("text"))
    relevance = F.when(F.col("relevance").isin(0, 1), F.col("relevance")).otherwise(F.raise_error(F.lit("relevance is 0 or 1")))
    held = per.select("topic", F.struct("passage", text.alias("text"), relevance.cast("int").alias("relevance")).alias("p"))
    listed = held.groupBy("topic").agg(F.array_sort(F.collect_list("p")).alias("passages"))
    fine = (F.trim("query") != "") & F.forall("passages", lambda p: F.trim(p["text"]) != "")
    return topics.join(listed, "topic").where(fine).withColumn("relevant", F.exists("passages", lambda p: p["relevance"] == 1))


def judged_choice(rows: DataFrame, none: str, most: int = row.MAX_DISTRACTORS) -> DataFrame:
    """``rows`` of :func:`judged` with texts and place: one relevant passage, if there is one, among up to ``most`` others and a none option, in
    seeded order; place is that of the relevant one or of none. Topics with one text under two judgments or fewer than two passages go."""
    of = lambda r: F.array_sort(F.array_distinct(F.transform(F.filter("passages", lambda p: p["relevance"] == r), lambda p: p["text"])))
    seed = F.concat("query", F.lit("\n"), F.array_join(F.array_sort(F.array_distinct(F.transform("passages", lambda p: p["text"]))), "\n"))
    made = rows.withColumns({"j_good": of(1), "j_bad": of(0), "j_seed": seed}).where(~F.arrays_overlap("j_good", "j_bad"))
    right = F.slice(row.shuffled(F.col("j_good"), F.col("j_seed")), 1, 1)
    made = made.withColumns({"j_right": right, "j_all": F.concat(right, F.slice(row.shuffled(F.col("j_bad"), F.col("j_seed")), 1, most))}).where(F.size("j_all") >= 2)
    made = made.withColumn("texts", row.shuffled(F.concat("j_all", F.array(F.lit(none))), F.concat(F.lit("options:"), F.col("j_seed"))))
    answer = F.coalesce(F.get("j_right", F.lit(0)), F.lit(none))
    return made.withColumn("place", F.array_position("texts", answer).cast("int")).drop("j_good", "j_bad", "j_seed", "j_right", "j_all")


def without_seen(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows of :func:`judged` whose query and passages none of ``seen``, the rows of a more held-out split, has."""
    passages = seen.select(F.explode("passages.passage").alias("passage")).distinct()
    hit = rows.select("topic", F.explode("passages.passage").alias("passage")).join(passages, "passage", "left_semi").select("topic").distinct()
    return rows.join(seen.select("query").distinct(), "query", "left_anti").join(hit, "topic", "left_anti")


def without_either(rows: DataFrame, columns: tuple[str, str], held: DataFrame) -> DataFrame:
    """Rows of which neither column has a value that one of the two columns of ``held`` has."""
    values = reduce(DataFrame.union, [held.select(F.col(c).alias("held_value")) for c in columns]).distinct()
    return reduce(lambda df, c: df.join(values, F.col(c) == F.col("held_value"), "left_anti"), columns, rows)


def standing_once(rows: DataFrame, *keys: Column) -> DataFrame:
    """Rows of which each key is that of no other row. Keys are counted by hash before rows move, so that a frequent one is no large group."""
    for key in keys:
        keyed = rows.withColumn("o_key", F.md5(key.cast("binary")))
        once = keyed.groupBy("o_key").agg(F.count("*").alias("n")).where("n = 1").select("o_key")
        rows = keyed.join(once, "o_key", "left_semi").drop("o_key")
    return rows


def first_halves(rows: DataFrame, place: str, value: str) -> DataFrame:
    """``rows`` with first_value: the value at the same place of the first half, for two halves that say the same in one order. place counts from 0."""
    half = rows.agg(F.floor(F.count("*") / 2).alias("half"))
    counted = rows.crossJoin(F.broadcast(half))  # one row
    first = counted.where(F.col(place) < F.col("half")).select(F.col(place).alias("h_place"), F.col(value).alias("first_value"))
    return counted.join(first, F.pmod(place, "half") == F.col("h_place")).drop("half", "h_place")


def without_contained(rows: DataFrame, row_id: str, text: str, items: DataFrame, item: str) -> DataFrame:
    """Rows whose text holds none of the items as it stands. Null texts stay, null items are left out, an empty item is in every text.

    A text that holds an item holds its inner words as whole words, so rows and items meet by a hash of the second to sixth word; items of fewer
    than seven words by as many as there are inside, items without an inner word by their first characters. Which lengths there are is at most
    :data:`KEY_WORDS` + :data:`KEY_CHARS` + 1 numbers; for each the rows are read once. Only ids and hashes move, and what meets is looked at
    in the text, so that a hash that stands for two keys does no harm."""
    known = items.where(F.col(item).isNotNull()).select(F.col(item).alias("c_item")).distinct()
    known = known.select("c_item", F.split("c_item", r"\s+").alias("c_words")).withColumn("c_inner", F.least(F.size("c_words") - 2, F.lit(KEY_WORDS)))
    known = known.withColumn("c_size", F.when(F.col("c_inner") > 0, F.col("c_inner")).otherwise(-F.least(F.length("c_item"), F.lit(KEY_CHARS))))
    met = []
    for (size,) in known.select("c_size").distinct().collect():
        own = known.where(F.col("c_size") == size)
        if size > 0:
            keys = own.select("c_item", F.xxhash64(*[F.get("c_words", F.lit(i + 1)) for i in range(size)]).alias("c_key"))
            shifted = F.arrays_zip(*[(F.col("c_w") if i == 0 else F.slice("c_w", i + 1, 1 << 30)).alias(f"w{i}") for i in range(size)])
            flat = rows.select(row_id, F.split(text, r"\s+").alias("c_w")).select(row_id, F.inline(shifted))
            flat = flat.where(f"w{size - 1} is not null").select(row_id, F.xxhash64(*[f"w{i}" for i in range(size)]).alias("c_key"))
        else:
            keys = own.select("c_item", F.xxhash64(F.left("c_item", F.lit(-size))).alias("c_key"))
            at = F.sequence(F.lit(1), F.greatest(F.length(text) + size + 1, F.lit(1)))
            flat = rows.select(row_id, F.explode(F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.substring(F.col(text), i, F.lit(-size)))))).alias("c_key"))
        met.append(flat.join(keys, "c_key").select(F.col(row_id).alias("c_id"), "c_item"))
    if not met:
        return rows
    near = reduce(DataFrame.union, met).groupBy("c_id").agg(F.collect_set("c_item").alias("c_items"))
    held = F.coalesce(F.exists("c_items", lambda i: F.contains(F.col(text), i)), F.lit(False))
    return rows.join(near, F.col(row_id).eqNullSafe(F.col("c_id")), "left").where(~held).drop("c_id", "c_items")
