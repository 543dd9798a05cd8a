"""Sharding by fixed virtual slots, with DataFrame functions only.

Records are hashed into ``slots`` slots that never change. Bytes are added up by slot, and a small table with a row for each slot says which
shard holds it. Growing or rebalancing edits that table, a new version beside the old ones: a shard gives up its lightest slots, as far as it has more than
its share, and these go, heaviest first, to the shard with the least bytes. The other slots, and so their records, stay where they are.

Sums by slot and by part of a slot have a fixed number of rows (``slots`` times ``parts``), whatever the input; only these are broadcast, and
only the ``slots`` rows of the map are folded in one row. Records that have one id and text are counted before they are moved, and each copy hashes
with its number, so that a record with a third of all rows spreads over the slots. A place in a shard is a prefix sum of counts by part, and a number inside
the part.

Defined results: a null text has no bytes, size 1 and the checksum of nothing, 0; a null id is an id like any other; equal records take the places that
fall to them in any order, as they cannot be told apart; an empty table gives an empty result and a map by slot numbers; a record heavier than a shard's
share leaves the other shards level; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradus.llm.store import settle

SHARDS, SLOTS, PARTS = 16, 4096, 8


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _hash(copy: Column) -> Column:
    return F.xxhash64(F.coalesce(F.col("s_id").cast("string"), F.lit("~")), "s_text", copy)


def _slim(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    text = F.col(text_col)
    return [F.col(id_col).alias("s_id"), size_of(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("s_text")]


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, parts: int = PARTS) -> DataFrame:
    """Rows (s_id, size, text_crc32, s_key, virtual_slot, s_part), one for each row of ``docs``."""
    counted = docs.select(*_slim(docs, id_col, text_col)).groupBy("s_id", "size", "text_crc32", "s_text").count()
    each = counted.select("s_id", "size", "text_crc32", "s_text", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))).alias("copy"))
    key = each.select("s_id", "size", "text_crc32", _hash(F.col("copy")).alias("s_key"))
    return key.withColumns({"virtual_slot": F.pmod("s_key", F.lit(slots)).cast("int"), "s_part": F.pmod(F.shiftright("s_key", 32), F.lit(parts)).cast("int")})


def first_map(spark: SparkSession, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Rows (virtual_slot, shard): the slots in turn, as nothing is known of their bytes."""
    return spark.range(slots).select(F.col("id").cast("int").alias("virtual_slot"), (F.col("id") % shards).cast("int").alias("shard"))


def rebalanced(mapping: DataFrame, held: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The edited map: ``held`` has the bytes of each slot that has any. A shard beyond ``shards`` gives up all its slots."""
    known = mapping.join(held.select(F.col("virtual_slot").alias("h_slot"), "bytes"), F.col("virtual_slot") == F.col("h_slot"), "left").select("virtual_slot", "shard", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    share = F.sum("bytes").over(Window.partitionBy(F.lit(0))) / shards
    filled = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot"))
    judged = known.withColumns({"m_share": share, "m_filled": filled}).withColumn("stays", (F.col("shard") < shards) & (F.col("m_filled") <= F.col("m_share")))
    loads = F.map_from_entries(F.collect_list(F.when(F.col("stays"), F.struct("shard", "m_filled"))))
    heaviest = judged.where("stays").groupBy("shard").agg(F.max("m_filled").alias("m_filled"), F.lit(True).alias("stays")).agg(loads.alias("loads"))
    freed = judged.where("not stays").agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "virtual_slot"))).alias("free"))
    level = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.coalesce(F.try_element_at("loads", s), F.lit(0)).cast("long"))

    def put(state: Column, slot: Column) -> Column:
        least = F.array_position(state["level"], F.array_min(state["level"])) - 1
        level = F.transform(state["level"], lambda n, s: F.when(s == least, n - slot["less"]).otherwise(n))
        return F.struct(level.alias("level"), F.concat(state["placed"], F.array(least.cast("int"))).alias("placed"))

    folded = freed.join(heaviest).select("free", F.aggregate("free", F.struct(level.alias("level"), F.expr("cast(array() as array<int>)").alias("placed")), put)["placed"].alias("placed"))
    moved = folded.select(F.explode(F.arrays_zip(F.col("free.virtual_slot").alias("virtual_slot"), F.col("placed").alias("shard"))).alias("m")).select("m.virtual_slot", "m.shard")
    return judged.where("stays").select("virtual_slot", "shard").union(moved)


def store_map(mapping: DataFrame, path: str, version: int) -> None:
    """Adds a version beside those at ``path``; one that exists already is an error."""
    mapping.coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Rows (virtual_slot, shard, version) of a version, the latest one if none is named."""
    stored = spark.read.parquet(path)
    wanted = F.lit(version) if version is not None else F.lit(stored.agg(F.max("version")).first()[0])
    return stored.where(F.col("version") == wanted)


def placed(own: DataFrame, mapping: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows (id_col, size, text_crc32, shard, slot, virtual_slot) of ``records``: slot is the row's place in its shard, from 0 without a gap."""
    counts = own.groupBy("virtual_slot", "s_part").agg(F.count("*").alias("n")).join(mapping.select("virtual_slot", "shard"), "virtual_slot")
    before = Window.partitionBy("shard").orderBy("virtual_slot", "s_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("virtual_slot", "s_part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("s_before"))
    inside = F.row_number().over(Window.partitionBy("virtual_slot", "s_part").orderBy("s_key", "s_id", "size", "text_crc32"))
    numbered = own.withColumn("s_number", inside - 1)
    # as many rows as there are parts of slots at most
    out = numbered.join(F.broadcast(offsets), ["virtual_slot", "s_part"])
    return out.select(F.col("s_id").alias(id_col), "size", "text_crc32", "shard", (F.col("s_before") + F.col("s_number")).cast("long").alias("slot"), "virtual_slot")


def write_shards(docs: DataFrame, mapping: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> None:
    """Writes ``docs``, whole, as Parquet in a folder for each shard (a column shard_no of ``docs`` is replaced). Rows of one id and text meet in a task, which numbers the copies."""
    copy = F.row_number().over(Window.partitionBy("s_id", "s_text").orderBy(F.lit(0))).cast("long")
    keyed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("s_doc"), *_slim(docs, id_col, text_col)).withColumn("copy", copy)
    m = mapping.select(F.col("virtual_slot").alias("m_slot"), F.col("shard").alias("shard_no"))
    dealt = keyed.join(F.broadcast(m), F.pmod(_hash(F.col("copy")), F.lit(slots)).cast("int") == F.col("m_slot"))
    dealt.select(*[F.col("s_doc")[c].alias(c) for c in docs.columns if c != "shard_no"], "shard_no").write.partitionBy("shard_no").parquet(path)


def sharded(docs: DataFrame, map_path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Places the rows of ``docs`` by a map at ``map_path``: version 1 deals the slots in turn, version 2 is levelled by their bytes."""
    spark = docs.sparkSession
    own = settle(records(docs, id_col, text_col))
    store_map(first_map(spark, shards), map_path, 1)
    held = own.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"))
    store_map(rebalanced(load_map(spark, map_path, 1), held, shards), map_path, 2)
    return placed(own, load_map(spark, map_path, 2), id_col)
