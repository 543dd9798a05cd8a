"""Policy loss of option scorers: logits are disturbed a few times a row, and what scores above the row's mean draws the logits towards it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.functions import row
from gradus.operators.metrics import nll, proper_score, tempered


def uniform(digits: Column) -> Column:
    """A number between 0 and 1, neither of them, from 13 hexadecimal digits."""
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def normal(seed: Column) -> Column:
    """A draw of the normal distribution by the hash of ``seed``, by Box and Muller's formula."""
    of = lambda h: F.sqrt(-2 * F.ln(uniform(F.substring(h, 1, 13)))) * F.cos(2 * math.pi * uniform(F.substring(h, 14, 13)))
    return row.bound(row.sha1(seed), of)


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def deviation(values: Column) -> Column:
    """Of a sample; 0 for one value."""
    around = lambda m: F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - m) * (x - m))
    return F.when(F.size(values) > 1, F.sqrt(row.bound(mean(values), around) / (F.size(values) - 1))).otherwise(0.0)


def noise(seed: Column, draws: int, n: Column, sigma: Column | float) -> Column:
    """``draws`` arrays of ``n`` normal numbers of deviation ``sigma``, each less its mean, since a shift of all logits changes nothing."""
    drawn = lambda g: F.transform(F.sequence(F.lit(1), n), lambda o: normal(F.concat_ws(":", seed, g.cast("string"), o.cast("string"))) * sigma)
    centred = lambda x: row.bound(mean(x), lambda m: F.transform(x, lambda v: v - m))
    return F.transform(F.sequence(F.lit(1), F.lit(draws)), lambda g: row.bound(drawn(g), centred))


def sigma_at(step: int, steps: int, start: float, end: float) -> float:
    """Deviation of the noise, in a line from ``start`` to ``end``."""
    return start + (end - start) * step / max(1, steps - 1)


def policy(rows: DataFrame, seed: Column, draws: int, sigma: float, spherical: float = 0.0, cross_entropy: float = 0.0, logits: str = "logits", label: str = "label") -> DataFrame:
    """``rows`` with noise, rewards, advantages and loss. All draws of a row are arrays of it: no row is multiplied, and nothing moves. A row without logits
    has nulls."""
    made = rows.withColumn("noise", F.when(F.size(logits) > 0, noise(seed, draws, F.size(logits), sigma)))
    made = made.withColumn("p_q", F.transform("noise", lambda e: tempered(F.zip_with(F.col(logits), e, lambda z, v: z + v))))
    made = made.withColumn("rewards", F.transform("p_q", lambda q: proper_score(q, F.col(label), spherical))).withColumns({"p_mean": mean(F.col("rewards")), "p_dev": deviation(F.col("rewards"))})
    made = made.withColumn("advantages", F.transform("rewards", lambda r: (r - F.col("p_mean")) / (F.col("p_dev") + 1e-6)))
    likely = F.transform("noise", lambda e: -F.aggregate(e, F.lit(0.0), lambda a, v: a + v * v) / (2 * sigma * sigma))
    loss = -mean(F.zip_with("advantages", likely, lambda a, p: a * p))
    if cross_entropy:
        loss = loss + cross_entropy * nll(tempered(F.col(logits)), F.col(label))
    return made.withColumn("loss", loss).drop("p_q", "p_mean", "p_dev")
