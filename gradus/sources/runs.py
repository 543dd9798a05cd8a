"""What a run leaves behind: predictions as JSON lines, metrics as one JSON object by stage and part, and run.json, which lists the stages."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.sources import scratch

#: What a line of predictions has.
PREDICTED = "options array<string>, probs array<double>, label array<double>"
_KEYS = ("run", "stage", "part", "dataset")


def save_predictions(rows: DataFrame, folder: str) -> None:
    """Lines {options, probs, label} of rows (run, stage, part, dataset and these). What is evaluated again replaces its own lines and no others."""
    lines = rows.select(*_KEYS, *[F.col(c) for c in ("options", "probs", "label")])
    lines.write.partitionBy(*_KEYS).option("partitionOverwriteMode", "dynamic").mode("overwrite").json(f"{folder}/predictions")


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (run, stage, part, dataset, options, probs, label) of all lines; a filter by run, stage, part or dataset reads those alone."""
    keys = ", ".join(f"{k} string" for k in _KEYS)
    return spark.read.schema(f"{PREDICTED}, {keys}").json(f"{folder}/predictions")


def save_metrics(metrics: DataFrame, folder: str, part: str, columns: Sequence[str]) -> None:
    """``<folder>/<run>/<stage>-<part>.json`` of rows (run, stage, dataset, columns): an object with the metrics of each dataset; what is missing is left
    out. Stages that run.json lacks come last in it. A file is written at once, and run.json after it. A file has a line for each dataset of a stage, which
    are few; they pass the driver one file at a time."""
    spark = metrics.sparkSession
    told = F.struct(F.col("dataset"), F.to_json(F.struct(*columns)).alias("m"))
    files = metrics.groupBy("run", "stage").agg(F.sort_array(F.collect_list(told)).alias("rows"))
    for r in files.orderBy("run", "stage").toLocalIterator():
        scratch.put(spark, f"{folder}/{r.run}/{r.stage}-{part}.json", json.dumps({x.dataset: json.loads(x.m) for x in r.rows}, indent=2))
        at = f"{folder}/{r.run}/run.json"
        known = json.loads(spark.read.text(at, wholetext=True).first()[0]) if scratch.exists(spark, at) else {}
        if r.stage not in known.get("stages", []):
            scratch.put(spark, at, json.dumps(known | {"stages": [*known.get("stages", []), r.stage]}, indent=2))
