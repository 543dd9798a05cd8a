"""Comparison of runs over rows (entry, dataset, metric columns, benchmark)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def common(scores: DataFrame) -> DataFrame:
    """The datasets that every entry has."""
    n = scores.select("entry").distinct().agg(F.count("*").alias("n_entries"))
    per = scores.groupBy("dataset").agg(F.count_distinct("entry").alias("n"))
    return scores.join(per.join(F.broadcast(n), F.col("n") == F.col("n_entries")).select("dataset"), "dataset")


def leaderboard(scores: DataFrame, metric: str = "accuracy", higher: bool = True) -> DataFrame:
    """Rows (benchmark, entry, macro, mean_rank, wins, median): ties share the average rank, wins count ties. A dataset without a value makes the
    macro NaN; such a value has no rank, wins nothing and is left out of the median."""
    known = F.nanvl(F.col(metric).cast("double"), F.lit(None).cast("double"))
    value = known if higher else -known
    own = Window.partitionBy("dataset")
    ranked = common(scores).withColumn("v", value).withColumns({
        "rank": F.when(F.col("v").isNotNull(), F.rank().over(own.orderBy(F.desc_nulls_last("v"))) + (F.count("*").over(Window.partitionBy("dataset", "v")) - 1) / 2),
        "won": (F.col("v") == F.max("v").over(own)).cast("long")})
    return ranked.groupBy("benchmark", "entry").agg(F.avg(F.coalesce(metric, F.lit(float("nan")))).alias("macro"), F.avg("rank").alias("mean_rank"), F.coalesce(F.sum("won"), F.lit(0)).alias("wins"), F.percentile(known, 0.5).alias("median"))


def wide(scores: DataFrame, entries: list[str], metric: str = "accuracy") -> DataFrame:
    """Datasets by entries."""
    return common(scores).groupBy("dataset").pivot("entry", entries).agg(F.first(metric))


def ordered(board: DataFrame, metric: str = "macro", higher: bool = True) -> DataFrame:
    """Best first inside each group, entries without a value last, equal ones by name."""
    value = F.nanvl(F.col(metric), F.lit(None).cast("double"))
    return board.orderBy("benchmark", F.desc_nulls_last(value) if higher else F.asc_nulls_last(value), "entry")


def described(scores: DataFrame, info: DataFrame, part: str = "test") -> DataFrame:
    """``scores`` with topic, type and group. info: (dataset, topic, type, benchmark). A dataset's group is "benchmark" if a saved flag says so,
    ``part`` if saved flags deny it; without a saved flag the info's flag stands, without both ``part``. Unknown topics and types are "?"."""
    saved = scores.groupBy("dataset").agg(F.bool_or("benchmark").alias("s_flag"))
    known = saved.join(info.withColumnRenamed("benchmark", "i_flag"), "dataset", "left")
    group = F.when(F.coalesce("s_flag", "i_flag", F.lit(False)), "benchmark").otherwise(part)
    told = known.select("dataset", F.coalesce("topic", F.lit("?")).alias("topic"), F.coalesce("type", F.lit("?")).alias("type"), group.alias("group"))
    return scores.join(told, "dataset")


def entries(spark: SparkSession, folder: str, part: str = "test") -> DataFrame:
    """Rows (entry, run, stage, dataset, metrics MAP<STRING, STRING>) of all runs under ``folder``: a folder for each run with run.json, which lists
    its stages, and <stage>-<part>.json, which has the metrics of each dataset; for the last stage last-<part>.json stands in. Macro
    rows are left out, as are stages without a file."""
    files = spark.read.text(f"{folder}/*/*.json", wholetext=True).select(
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("run"), F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("file"), F.col("value").alias("body"))
    stages = files.where("file = 'run'").select("run", F.from_json("body", "stages array<string>")["stages"].alias("stages"))
    asked = stages.select("run", F.posexplode("stages").alias("at", "stage"), F.size("stages").alias("n"))
    names = F.when(F.col("at") == F.col("n") - 1, F.array(F.col("stage"), F.lit("last"))).otherwise(F.array("stage"))
    tried = asked.select("run", "stage", F.posexplode(names).alias("rank", "name")).withColumn("file", F.concat("name", F.lit(f"-{part}")))
    found = tried.join(files, ["run", "file"]).groupBy("run", "stage").agg(F.min_by("body", "rank").alias("body"))
    flat = found.select("run", "stage", F.explode(F.from_json("body", "map<string,map<string,string>>")).alias("dataset", "metrics"))
    return flat.where(~F.col("dataset").isin("macro", "benchmark_macro")).select(F.concat("run", F.lit(" / "), "stage").alias("entry"), "run", "stage", "dataset", "metrics")


def text_rows(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds line: the row as one of a table with bars, a dash for what is missing."""
    return df.withColumn("line", F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c.cast("string"), F.lit("-")) for c in columns.values()]), F.lit(" |")))


def text_head(columns: dict[str, Column], numbers: tuple[str, ...] = ()) -> list[str]:
    """The two lines over :func:`text_rows`; columns of numbers are set to the right."""
    return [f"| {' | '.join(columns)} |", "|" + "|".join("---:" if c in numbers else "---" for c in columns) + "|"]
