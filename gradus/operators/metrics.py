"""Metrics of option scorers over rows (dataset, probs, label): probabilities are ragged arrays, a null one counts as uniform."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.functions.row import bound
from gradus.sources import scratch

#: Bins of the calibration error, and cut-offs of the threshold sweep in steps of 0.05.
BINS, STEPS = 15, 20
#: Ranges of scores from 0 to 1 that are ordered apart; scores beyond go to the outer ranges.
RANGES = 4096


def first_max(x: Column) -> Column:
    return F.array_position(x, F.array_max(x))


def answered(probs: Column, n: Column) -> Column:
    return F.coalesce(probs, F.array_repeat(1.0 / n, n))


def nll(probs: Column, label: Column) -> Column:
    """Soft negative log likelihood of probabilities that are raised to 1e-9 at least and then add up to 1 again."""
    def of(raised: Column, total: Column) -> Column:
        terms = F.zip_with(raised, label, lambda p, y: F.when(y == 0, 0.0).otherwise(-y * F.ln(p / total)))
        return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)

    return bound(F.transform(probs, lambda p: F.greatest(p, F.lit(1e-9))), lambda raised: bound(_sum(raised), lambda total: of(raised, total)))


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def tempered(logits: Column, temperature: float | Column = 1.0) -> Column:
    t = F.lit(temperature) if not isinstance(temperature, Column) else temperature
    weights = bound(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp((x - top) / t)))
    return bound(weights, lambda ws: bound(_sum(ws), lambda total: F.transform(ws, lambda w: w / total)))


def scored(predictions: DataFrame) -> DataFrame:
    """Adds p, hit (argmax of probs is that of label, first of equals), conf and nll."""
    p = answered(F.col("probs"), F.size("label"))
    return predictions.withColumn("p", p).withColumns({"hit": (first_max(F.col("p")) == first_max(F.col("label"))).cast("double"), "conf": F.array_max("p"), "nll": nll(F.col("p"), F.col("label")), "was": F.col("probs").isNotNull().cast("double")})


def by_dataset(predictions: DataFrame, keys: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """Rows (keys, n, accuracy, nll, ece, answered). Bins are summed first, so that the second grouping has BINS rows a dataset."""
    bins = scored(predictions).withColumn("bin", F.ceil(F.col("conf") * BINS)).groupBy(*keys, "bin").agg(
        F.count("*").alias("m"), F.sum("hit").alias("h"), F.sum("conf").alias("c"), F.sum("nll").alias("l"), F.sum("was").alias("w"))
    gap = F.when(F.col("bin") >= 1, F.abs(F.col("c") - F.col("h"))).otherwise(0.0)
    total = F.sum("m")
    return bins.groupBy(*keys).agg(total.alias("n"), (F.sum("h") / total).alias("accuracy"), (F.sum("l") / total).alias("nll"), (F.sum(gap) / total).alias("ece"), (F.sum("w") / total).alias("answered"))


def macro(metrics: DataFrame, benchmark: Column) -> DataFrame:
    """Unweighted means over datasets, apart for benchmarks and the rest."""
    name = F.when(benchmark, "benchmark_macro").otherwise("macro")
    return metrics.groupBy(name.alias("dataset")).agg(F.sum("n").alias("n"), *[F.avg(c).alias(c) for c in ("accuracy", "nll", "ece")])


def thresholds(binary: DataFrame, p: str = "p", gold: str = "gold") -> DataFrame:
    """Rows (threshold, tp, fp, fn, tn, precision, recall, f1, positive_rate): a row of scores is counted once, by the highest cut-off it
    reaches; running sums over the few cut-offs give the rest."""
    level = F.floor(F.round(F.col(p) * STEPS, 9)).cast("int")
    counted = binary.where(F.col(p).isNotNull()).groupBy(F.least(level, F.lit(STEPS - 1)).alias("level")).agg(F.sum(F.col(gold).cast("long")).alias("pos"), F.count("*").alias("all"))
    steps = binary.sparkSession.range(0, STEPS).select(F.col("id").cast("int").alias("step"))
    full = steps.join(counted, F.col("step") == F.col("level"), "left").fillna(0, ["pos", "all"])
    above, every = Window.partitionBy(F.lit(0)).orderBy(F.desc("step")), Window.partitionBy(F.lit(0))
    t = full.withColumns({"tp": F.sum("pos").over(above), "n_up": F.sum("all").over(above), "n_pos": F.sum("pos").over(every), "n": F.sum("all").over(every)}).where("step > 0")
    t = t.withColumns({"fp": F.col("n_up") - F.col("tp"), "fn": F.col("n_pos") - F.col("tp")}).withColumn("tn", F.col("n") - F.col("n_up") - F.col("fn"))
    ratio = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    t = t.withColumns({"precision": ratio(F.col("tp"), F.col("n_up")), "recall": ratio(F.col("tp"), F.col("n_pos")), "positive_rate": ratio(F.col("n_up"), F.col("n"))})
    f1 = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))  # 0 without a hit, null only where nothing is gold or predicted
    return t.select(F.round(F.col("step") / STEPS, 2).alias("threshold"), "tp", "fp", "fn", "tn", "precision", "recall", f1.alias("f1"), "positive_rate")


def best_f1(sweep: DataFrame) -> DataFrame:
    return sweep.agg(F.max_by("threshold", F.when(F.col("f1").isNotNull(), F.struct("f1", -F.col("threshold")))).alias("best_f1_threshold"))


def average_precision(binary: DataFrame, keys: tuple[str, ...], p: str = "p", gold: str = "gold") -> DataFrame:
    """Area under precision by recall, equal scores in one step. Equal scores are summed first; steps are ordered inside ranges of the score, and
    what the higher ranges of a key hold is added from their sums, at most ``RANGES`` rows a key, so that no key is one task's."""
    per = binary.groupBy(*keys, p).agg(F.count("*").alias("m"), F.sum(F.col(gold).cast("long")).alias("pos"))
    per = per.withColumn("a_range", F.least(F.greatest(F.floor(F.col(p) * RANGES), F.lit(0)), F.lit(RANGES - 1)).cast("int"))
    higher = Window.partitionBy(*keys).orderBy(F.desc("a_range")).rowsBetween(Window.unboundedPreceding, -1)
    sums = per.groupBy(*keys, "a_range").agg(F.sum("m").alias("a_m"), F.sum("pos").alias("a_pos"))
    above = sums.select(*keys, "a_range", *[F.coalesce(F.sum(c).over(higher), F.lit(0)).alias(f"{c}_up") for c in ("a_m", "a_pos")])
    down = Window.partitionBy(*keys, "a_range").orderBy(F.desc(p))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*keys, "a_range")]
    met = per.alias("l").join(above.alias("r"), same).select("l.*", "r.a_m_up", "r.a_pos_up")
    run = met.withColumns({"up": F.sum("m").over(down) + F.col("a_m_up"), "tp": F.sum("pos").over(down) + F.col("a_pos_up")})
    return run.groupBy(*keys).agg(F.sum("m").alias("n"), F.sum("pos").alias("n_pos"), F.try_divide(F.sum(F.col("pos") * F.col("tp") / F.col("up")), F.sum("pos")).alias("average_precision"))


def fit_temperature(rows: DataFrame, low: float = -3.0, high: float = 3.0, points: int = 9, rounds: int = 6) -> float:
    """The temperature of least mean NLL of (logits, label): a grid of log T in one aggregate, then finer grids around the best. The rows are
    written once, so that what makes them is not done again for each grid."""
    spark, own = rows.sparkSession, rows.select("logits", "label")
    path = scratch.folder(spark, "logits")
    own.write.parquet(path)
    kept = spark.read.schema(own.schema).parquet(path)
    try:
        for _ in range(rounds):
            grid = [low + (high - low) * i / (points - 1) for i in range(points)]
            losses = kept.agg(*[F.avg(nll(tempered(F.col("logits"), float(2.718281828459045**g)), F.col("label"))).alias(f"g{i}") for i, g in enumerate(grid)]).first()
            if losses[0] is None:
                return 1.0
            best = min(range(points), key=lambda i: losses[i])
            low, high = grid[max(0, best - 1)], grid[min(points - 1, best + 1)]
    finally:
        scratch.remove(spark, path)
    return float(2.718281828459045 ** ((low + high) / 2))


def by_kind(predictions: DataFrame, *kinds: str) -> DataFrame:
    """Macro means over datasets by each of ``kinds`` (such as type, topic, benchmark) apart and over all: rows (kind, value, datasets, n,
    accuracy, nll, ece), in one pass over the metrics of the datasets."""
    per = by_dataset(predictions, ("dataset", *kinds)).withColumn("k", F.explode(F.array(F.struct(F.lit("all").alias("kind"), F.lit("all").alias("value")), *[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in kinds])))
    return per.groupBy("k.kind", "k.value").agg(F.count("*").alias("datasets"), F.sum("n").alias("n"), *[F.avg(c).alias(c) for c in ("accuracy", "nll", "ece")])


def yes_probability(options: Column, probs: Column) -> Column:
    """P(yes) of a two-way row (yes or да); null where no option says yes."""
    yes = F.filter(F.arrays_zip(options.alias("o"), probs.alias("p")), lambda x: F.lower(F.trim(x["o"]["text"])).isin("yes", "да"))
    return F.get(F.transform(yes, lambda x: x["p"]), F.lit(0))


def positives(rows: DataFrame, positive: str = "yes") -> DataFrame:
    """Rows (dataset, p, gold) of two-way rows (dataset, options, probs, label): the probability of the first option that says yes (or, for
    "no", of the first that does not) and whether its label is half or more. A row that was not answered has a null p, so that those who
    sweep thresholds can leave it out and count it; rows without such an option are left out."""
    says = lambda o: F.lower(F.trim(o["text"])).isin("yes", "да") == F.lit(positive == "yes")
    at = F.array_position(F.transform("options", says), True)
    return rows.withColumn("p_at", at).where("p_at > 0").select("dataset", F.get("probs", F.col("p_at") - 1).alias("p"), (F.get("label", F.col("p_at") - 1) >= 0.5).alias("gold"))


def binary_summary(binary: DataFrame, keys: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """Rows (keys, n, skipped, base_rate): answered rows, those that were not, and the share of gold among the answered."""
    there = F.col("p").isNotNull()
    return binary.groupBy(*keys).agg(F.count_if(there).alias("n"), F.count_if(~there).alias("skipped"), F.avg(F.when(there, F.col("gold").cast("double"))).alias("base_rate"))


def renormalised(probs: Column) -> Column:
    """Shares that add up to 1; even ones if all are 0."""
    total = F.aggregate(probs, F.lit(0.0), lambda a, p: a + p)
    return F.transform(probs, lambda p: F.when(total > 0, p / total).otherwise(1.0 / F.size(probs)))


def chosen(number: Column, n: Column) -> Column:
    """The answer "option k" as one-hot probabilities; null where k is none of 1 to ``n``."""
    return F.when(number.between(1, n), F.transform(F.sequence(F.lit(1), n), lambda i: F.when(i == number, 1.0).otherwise(0.0)))


def focal(probs: Column, label: Column, gamma: float = 2.0) -> Column:
    """Cross-entropy whose terms weigh (1 - p) ** gamma."""
    terms = F.zip_with(probs, label, lambda p, y: F.when(y == 0, 0.0).otherwise(-y * F.pow(F.greatest(1 - p, F.lit(0.0)), F.lit(gamma)) * F.ln(F.greatest(p, F.lit(1e-9)))))
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def proper_score(probs: Column, label: Column, spherical: float = 0.0) -> Column:
    """The log score, floored at ln(0.0001), and ``spherical`` times the spherical score."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    log = total(F.zip_with(probs, label, lambda p, y: y * F.ln(F.greatest(p, F.lit(1e-4)))))
    norm = F.greatest(F.sqrt(total(F.transform(probs, lambda p: p * p))), F.lit(1e-12))
    return log + F.lit(spherical) * total(F.zip_with(probs, label, lambda p, y: p * y)) / norm


def advantage(rewards: DataFrame, group: str, reward: str = "reward") -> DataFrame:
    """Adds advantage: the reward less its group's mean, over the group's deviation."""
    # the few numbers of a group are aggregated and joined back, so that a large group stays spread
    per = rewards.groupBy(F.col(group).alias("a_group")).agg(F.avg(reward).alias("a_mean"), F.coalesce(F.stddev_samp(reward), F.lit(0.0)).alias("a_dev"))
    met = rewards.join(per, F.col(group).eqNullSafe(F.col("a_group")))
    return met.withColumn("advantage", (F.col(reward) - F.col("a_mean")) / (F.col("a_dev") + 1e-6)).drop("a_group", "a_mean", "a_dev")


def best_step(history: DataFrame, by: str = "nll") -> DataFrame:
    """Of each run the step of least ``by``, the first of equals."""
    return history.groupBy("run").agg(F.min_by("step", F.struct(by, "step")).alias("step"), F.min(by).alias(by))
