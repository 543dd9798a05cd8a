"""The ordinal classifier against plain sums, on labels that the fit has not seen, with ids of any type; the order of the rule cascade."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.llm import quality_model, rules

DATA = "/root/testdata/sf0.1"


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{DATA}/labels.parquet")


@pytest.fixture(scope="module")
def halved(tables):
    """A model of every second label, and the texts of the others that are no copies of texts that it has seen."""
    docs, labels = tables
    model = quality_model.fit(docs, labels.where("doc_id % 2 = 0"), quality_model.rating(), quality_model.GRADES)
    seen = {r.text for r in docs.join(labels.where("doc_id % 2 = 0"), "doc_id").collect()}
    other = [r for r in docs.join(labels.where("doc_id % 2 = 1"), "doc_id").withColumn("grade", quality_model.rating()).collect() if r.text not in seen]
    return model, other


def test_unseen_labels(spark, halved):
    model, other = halved
    assert len(other) > 1500
    scored = {r.doc_id: r for r in quality_model.score(spark.createDataFrame([(r.doc_id, r.text) for r in other], "doc_id long, text string"), model).collect()}
    kept = {i: r.tails[quality_model.GOOD - 1] >= quality_model.ACCEPT for i, r in scored.items()}
    good, bad = [r.doc_id for r in other if r.grade == 2], [r.doc_id for r in other if r.grade < 2]
    assert sum(kept[i] for i in good) >= 0.97 * len(good) and sum(kept[i] for i in bad) <= 0.15 * len(bad)
    off = [abs(scored[r.doc_id].expected_grade - r.grade) for r in other]
    assert sum(off) / len(off) < 0.25


def test_probabilities_by_plain_sums(spark, halved):
    """200 rows: scores, tails, expected grades, and a likelihood that no shift of thresholds or scale of weights betters by much."""
    model, other = halved
    rows = other[:200]
    scored = {r.doc_id: r for r in quality_model.score(spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string"), model).collect()}
    t = model.thresholds.tolist()
    assert t == sorted(t)
    sums = {}
    for r in rows:
        of, feature, value = quality_model.features([r.text])
        assert set(of.tolist()) == {0} and len(set(feature.tolist())) == len(feature)
        sums[r.doc_id] = s = sum(float(model.weights[f]) * float(v) for f, v in zip(feature, value))
        tails = [sigmoid(s - x) for x in t]
        p = [a - b for a, b in zip([1.0, *tails], [*tails, 0.0])]
        assert abs(sum(p) - 1) < 1e-9 and min(p) >= 0
        got = scored[r.doc_id]
        assert np.allclose(got.tails, tails, atol=1e-5) and abs(got.expected_grade - sum(k * x for k, x in enumerate(p))) < 1e-5

    def likelihood(shift, scale):
        total = 0.0
        for r in rows:
            tails = [1.0, *[sigmoid(scale * sums[r.doc_id] - x - shift) for x in t], 0.0]
            total += math.log(max(tails[r.grade] - tails[r.grade + 1], 1e-12))
        return total / len(rows)

    own = likelihood(0, 1)
    share = [sum(r.grade == k for r in rows) / len(rows) for k in range(3)]
    assert own > 0.5 * sum(x * math.log(x) for x in share if x)  # far better than the shares of the grades alone
    assert all(likelihood(*x) < own + 0.05 for x in ((0.3, 1), (-0.3, 1), (0, 0.8), (0, 1.2)))


def test_ids_of_any_type(spark, tables):
    docs, labels = (df.limit(250) for df in tables)
    named = lambda df: df.withColumn("doc_id", F.concat(F.lit("n"), F.col("doc_id").cast("string")))
    fit = lambda d, x: quality_model.fit(d, x, quality_model.rating(), quality_model.GRADES)
    one, two = fit(named(docs), named(labels)), fit(named(docs).repartition(5), named(labels).repartition(3))
    assert np.array_equal(one.weights, two.weights) and np.any(one.weights)
    small = fit(docs.withColumn("doc_id", F.col("doc_id").cast("int")), labels.withColumn("doc_id", F.col("doc_id").cast("int")))
    assert np.array_equal(small.weights, fit(docs, labels).weights)
    parts = fit(docs.withColumn("doc_id", F.struct("doc_id")), labels.withColumn("doc_id", F.struct("doc_id")))
    assert np.any(parts.weights)


def test_odd_texts(spark, halved):
    model, _ = halved
    long = "some words of a very long text and more " * 100_000
    rows = [(1, None), (1, None), (2, ""), (3, " \n "), (4, long), (5, "é" * 70_000), (6, "\x00\x01")]
    got = [(r.doc_id, r.expected_grade) for r in quality_model.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()]
    assert len(got) == 7 and all(0 <= g <= 2 for _, g in got)
    same = {round(g, 9) for i, g in got if i in (1, 2)}
    assert len(same) == 1
    assert quality_model.score(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_rules_by_rejection_per_cost():
    """The rule that rejects most for its time comes first; figures of the later ones are of what it keeps."""
    def slow(t):
        time.sleep(0.002)
        return t.n_words % 2 == 0

    own = [rules.Rule("slow", slow), rules.Rule("quick", lambda t: t.n_words % 2 == 0), rules.Rule("never", lambda t: False)]
    rng = random.Random(1)
    texts = [" ".join("w" for _ in range(rng.randrange(1, 40))) for _ in range(40)] + [None]
    order = rules.estimate(texts, own)
    assert order[0][0] == "quick" and 0.2 < order[0][2] < 0.8
    assert {name: share for name, _, share in order[1:]} == {"slow": 0.0, "never": 0.0}
    assert rules.estimate([], own) and len(rules.estimate([None], own)) == 3


def test_cascade_stops_at_the_first_rejection(spark):
    docs = spark.createDataFrame([(i, "a b " * (i % 60)) for i in range(300)], "id int, text string").repartition(3)
    for estimates in (None, [("repeats", 1.0, 0.9), ("few_words", 1.0, 0.1)]):
        kept = {r.id: r.kept for r in rules.cascade(docs, rules.BASE, estimates=estimates).collect()}
        assert kept == {i: False for i in range(300)}
    once = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)))], "id int, text string")
    assert [r.kept for r in rules.cascade(once).collect()] == [True]
