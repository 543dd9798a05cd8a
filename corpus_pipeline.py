"""From raw documents to token ids: each stage takes what its predecessor kept, as written to Parquet and read again.

Stages: the quality classifier drops what it rejects; of each group of near copies one document stays; secrets in the texts are
replaced; sources are mixed to their target weights, which repeats documents; the texts are encoded.

A stage's function takes (spark, docs, sf_dir). All but the last return the columns of ``docs``, whatever further ones it has. An empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradus.llm import bpe, mixing, quality_model, secret_scan, simhash
from gradus.llm.queries import rank_file, table
from gradus.llm.store import released, remove, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _renamed(docs: DataFrame) -> DataFrame:
    """Columns under names that no operator gives."""
    return docs.withColumnsRenamed({c: f"own_{c}" for c in docs.columns})


def _own(made: DataFrame, docs: DataFrame) -> DataFrame:
    return made.select(*[F.col(f"own_{c}").alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that have the best grade with the probability asked for. The model is fitted on labelled texts of ``docs``.

    A null text is judged like an empty one; repeated rows fare alike; without labels no document reaches the probability, and all go; other columns stay as they are."""
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"), quality_model.rating(), quality_model.GRADES)
    good = F.element_at("tails", quality_model.GOOD) >= quality_model.ACCEPT
    return _own(quality_model.score(_renamed(docs), model, "own_text").where(good), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: the one of the smallest id, then the smallest hash of the text; rows without an id come last.

    Ids are of any type, others than whole numbers in the order of their texts. Rows of one id and text are one document, of which any row stays; null, empty and
    word-less texts are near copies of each other; other columns stay as they are."""
    whole = isinstance(docs.schema["doc_id"].dataType, T.IntegralType)
    ordered = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0") if whole else F.col("doc_id").cast("string")
    key = F.concat(F.when(F.col("doc_id").isNull(), "1").otherwise(F.concat(F.lit("0"), ordered)), F.lit("\x00"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    first = simhash.near_duplicates(docs.select(key.alias("kept_row"), "text"), "kept_row").where("kept_row = component").select(F.col("kept_row").alias("kept")).distinct()
    told = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("kept_doc"), key.alias("kept_row"))
    return told.join(first, F.col("kept_row") == F.col("kept")).dropDuplicates(["kept_row"]).select("kept_doc.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; n_chars follows.

    All rows stay. A text without a secret stays as it is, a null one null; n_chars changes with its text alone; other columns stay as they are."""
    scanned = secret_scan.scan(_renamed(docs), id_col="own_doc_id", text_col="own_text")
    text = secret_scan.redacted(F.coalesce(F.col("own_text"), F.lit("")), F.col("spans"))
    found = F.size("spans") > 0
    # the new text is a column before its length is taken: two aggregates of one lambda in a projection can mix up their variables
    new = scanned.withColumn("own_text", F.when(found, text).otherwise(F.col("own_text")))
    return _own(new.withColumn("own_n_chars", F.when(found, F.length("own_text").cast("long")).otherwise(F.col("own_n_chars"))), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for.

    Null, empty and word-less texts take no words and are not in the mix; a null source is a source; rows that are equal in id, source and text get as many
    copies together as the mix gives them; other columns stay as they are."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows (doc_id, source, n_tokens, ids), one for each row of ``docs``. A null text is empty, an empty one has no tokens; other columns go."""
    return bpe.encode(docs.select("doc_id", "source", "text"), rank_file()).select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_dedup), ("secret scan", secrets), ("source mix", mix), ("byte-level BPE", encode)]
#: SQL cannot express the classifier; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``. What a stage returns is written in the shared folder and read as the next one's input."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
        with released(spark):  # what a stage has written on its way goes with it, and its input once its output is there
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
