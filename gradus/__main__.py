"""``python -m gradus``: list, prepare, eval, thresholds, compare over Parquet tables."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gradus.config import layered, read
from gradus.operators import compare, metrics, selection, splits
from gradus.sources import runs, tables

#: Settings of the commands, for -s name=value.
DEFAULTS = {"prepare": {"most": 25000}, "compare": {"metric": "accuracy", "higher": True}}


def command_line() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="gradus")
    parser.add_argument("-c", "--config", help="JSON or TOML file of settings")
    parser.add_argument("-s", "--set", action="append", default=[], metavar="NAME=VALUE")
    commands = parser.add_subparsers(dest="command", required=True)
    named = commands.add_parser("list", help="built datasets and their rows")
    named.add_argument("path")
    prepare = commands.add_parser("prepare", help="sample rows to regrouped, capped, saved splits")
    prepare.add_argument("samples")
    prepare.add_argument("path")
    prepare.add_argument("names", nargs="*")
    for name, what in (("eval", "metrics of predictions (dataset, probs, label, benchmark)"), ("thresholds", "sweep over rows (p, gold)"), ("compare", "leaderboard of rows (entry, dataset, metrics, benchmark)")):
        own = commands.add_parser(name, help=what)
        own.add_argument("rows")
        own.add_argument("path", nargs="?", help="where the result is written; of eval with --run, a folder of runs")
        if name == "eval":
            own.add_argument("--run", help="writes the metrics as <path>/<run>/<stage>-<part>.json")
            own.add_argument("--stage", default="last")
            own.add_argument("--part", default="test")
    return parser


def prepared(samples, most: int):
    """The samples in the splits that they end in, capped after carving."""
    placed = splits.regroup(samples).withColumn("split", F.col("target")).select(*samples.columns)
    return splits.cap(placed, most)


def main(arguments: list[str] | None = None) -> None:
    args = command_line().parse_args(arguments)
    file = read(args.config) if args.config else None
    settings = layered(DEFAULTS, file, args.set)
    spark = SparkSession.builder.appName("gradus").getOrCreate()
    if args.command == "list":
        tables.manifest(spark, args.path).orderBy("dataset", "split").show(1000, False)
        return
    if args.command == "prepare":
        samples = spark.read.parquet(args.samples)
        if args.names:
            selection.resolved(args.names, [r[0] for r in samples.select("dataset").distinct().collect()])
            samples = samples.where(F.col("dataset").isin(*args.names))
        tables.save(prepared(samples, settings["prepare"]["most"]), args.path)
        return
    rows = spark.read.parquet(args.rows)
    if args.command == "eval":
        per = metrics.by_dataset(rows, ("dataset", "benchmark"))
        out = per.drop("benchmark").unionByName(metrics.macro(per, F.col("benchmark")), allowMissingColumns=True)
    elif args.command == "thresholds":
        out = metrics.thresholds(rows)
    else:
        out = compare.leaderboard(rows, **settings["compare"])
    if args.command == "eval" and args.run:
        told = out.withColumns({"run": F.lit(args.run), "stage": F.lit(args.stage)})
        runs.save_metrics(told, args.path or ".", args.part, [c for c in out.columns if c != "dataset"])
    elif args.path:
        out.write.parquet(args.path)
    else:
        out.show(1000, False)


if __name__ == "__main__":
    main()
