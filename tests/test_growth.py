"""What must not be computed again for every item, row or copy: it decides how the time of large tables grows."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from gradus.functions import row
from gradus.operators import metrics, questions, rings, specs, structured
from gradus.plans import annotated


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_of_a_state_are_split_once(spark):
    rows = [(1, "Der Hund und the ere", ["de: und", "en: the ere", None, "fr"]), (2, "", ["yes", "no"]), (3, None, ["yes", "no"])]
    df = spark.createDataFrame(rows, "id long, state string, texts array<string>").select("id", questions.overlap_probs(F.col("state"), F.col("texts")).alias("p"))
    plain = df.where("id > 1").orderBy("id").collect()
    assert plain[0].p == [0.5, 0.5] and plain[1].p == [None, None]
    whole = spark.createDataFrame([(1, rows[0][1], ["de: und", "en: the ere", "fr"])], "id long, state string, texts array<string>")
    assert whole.select(questions.overlap_probs(F.col("state"), F.col("texts")).alias("p")).first().p == [2 / 6, 3 / 6, 1 / 6]
    assert optimized(df).count("split(lower(") == 2  # the state's and the options'


@pytest.mark.parametrize("entries", [1, 5, 14, 15, 300, 2500])
def test_rows_meet_stretches_of_circles(spark, entries):
    reach, sha1 = 7, lambda x: hashlib.sha1(str(x).encode()).hexdigest()
    number = lambda x: int(sha1(x)[:15], 16)
    pool = spark.range(entries).selectExpr("'a' as k", "id as e", "concat('t', id) as t")
    rows = spark.createDataFrame([(i, "b" if i == 99 else None if i == 98 else "a") for i in range(100)], "r long, k string")
    drawn = rings.circled(rows, pool, "r", "k", "e", "t", reach)
    shares = -(-entries // 1000)
    circles = [sorted((e for e in range(entries) if number(e) % shares == s), key=sha1) for s in range(shares)]
    for r, k, got in drawn.collect():
        ring = circles[number(r) % shares] if k == "a" else []
        start = number(f"{r}:at") % len(ring) if ring else 0
        assert [d.id for d in got] == [ring[(start + i) % len(ring)] for i in range(1, min(reach, len(ring)) + 1)]
        assert [d.entry for d in got] == [f"t{d.id}" for d in got]
    assert "c_block" in optimized(drawn)  # a row is joined to twice the reach at most, not to a whole circle


def test_cells_are_exploded_once(spark):
    cell = "value string, is_header boolean, column_span int, row_span int"
    line = lambda head, *values: [(v, head, 1, 1) for v in values]
    table = [line(True, " name ", "n"), line(False, "x", "1"), line(False, "y", "2"), line(False, "z  z", "")]
    torn = [line(True, "name", "NAME"), *table[1:]]
    df = spark.createDataFrame([(1, table), (2, torn), (3, None)], f"id long, t array<array<struct<{cell}>>>")
    made = structured.table_cells(df, "id", F.col("t"))
    assert sorted(map(tuple, made.collect())) == [(1, 0, 1, "n", "name", "x", "1", ["2", ""]), (1, 1, 1, "n", "name", "y", "2", ["1", ""])]
    plan = optimized(made)
    assert plan.count("Generate explode") == 1 and plan.count("regexp_replace(") == 2  # headers and other rows


def lineitem(spark, folder, rows) -> str:
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


#: Orders of two lines, of equal ones, of one, with nulls, of lines without a key column, without an id, and of too many lines.
LINES = [(1, 2, 7, "N"), (1, 1, 9, "N"), (2, 1, 5, "A"), (2, 1, 5, "A"), (3, 1, 5, "A"), (4, 1, None, "R"), (4, 2, 8, None), (5, 1, 3, " x "), (5, 1, 3, "y"),
         (None, 1, 4, "N"), (None, 2, 4, "N"), *[(6, i, i, "N") for i in range(40)]]


def test_order_tables_are_built_once(spark, tmp_path):
    made = annotated.u_table(spark, lineitem(spark, tmp_path, LINES))
    text = lambda *lines: "\n".join(["Table: order", "line | part | flag", *lines])
    assert sorted(map(tuple, made.collect()), key=repr) == sorted([
        (1, 0, text("1 | 9 | fN", "2 | 7 | fN")), (2, None, text("1 | 5 | fA", "1 | 5 | fA")), (4, 0, text("1 | fR", "2 | 8")), (5, 2, text("1 | 3 | f x", "1 | 3 | fy")),
        (None, 0, text("1 | 4 | fN", "2 | 4 | fN"))], key=repr)
    plan = optimized(made)
    assert plan.count("sort_array(") == 1 and plan.count("regexp_replace(") == 2


def test_names_of_classes_become_slugs_once(spark):
    told = {"classes": {"source": "o", "kind": "classes", "state": "s", "answer": "a", "pos": "id", "options": {"No": "no"}}}
    df = spark.createDataFrame([(1, "x", "No"), (2, "y", "yes "), (3, "z", None)], "id long, s string, a string")
    made = specs.compiled(specs.from_settings(told), {"o": df})
    got = made.select("pos", F.to_json("options").alias("options"), "label", "type").orderBy("pos").collect()
    options = '[{"id":"no","text":"no"},{"id":"yes","text":"yes "}]'
    assert [tuple(r) for r in got] == [(1, options, [1.0, 0.0], "noul"), (2, options, [0.0, 1.0], "noul")]
    assert optimized(made.select("options")).count("regexp_replace(") == 0
    kinds = spark.range(1).select(*[row.kind(row.options_of(o)) for o in (["yes", "no"], ["no|yes"], ["no", "yes", "x"], ["a", "b"])]).first()
    assert tuple(kinds) == ("noul", "noul", "choice", "choice")


def test_temperature_reads_its_rows_once(spark):
    made = spark.sparkContext.accumulator(0)
    rows = [([0.0, 1.0, 3.0], [0.0, 0.0, 1.0]), ([2.0, 0.5, 0.0], [0.0, 1.0, 0.0]), ([1.0, 1.0], [0.5, 0.5]), (None, [1.0]), ([], []), ([None, 1.0], [1.0, 0.0]), ([None, 1.0], [0.0, 0.0]), ([1.0], None), ([5.0, 0.0], [None, 1.0])]

    def told(r):
        made.add(1)
        return r

    shape = "logits array<double>, label array<double>"
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(told), shape)
    got = metrics.fit_temperature(df)
    assert made.value == len(rows)

    def loss(z, y, t):
        if z is None or y is None or any(v is None for v in y):
            return None
        w = [math.exp((x - max(v for v in z if v is not None)) / t) if None not in z else None for x in z]
        p = [max(x / sum(w), 1e-9) if x is not None else 1e-9 for x in w]
        return sum(-b * math.log(a / sum(p)) for a, b in zip(p, y) if b)

    low, high = -3.0, 3.0
    for _ in range(6):
        grid = [low + (high - low) * i / 8 for i in range(9)]
        told_losses = [[loss(z, y, math.exp(g)) for z, y in rows] for g in grid]
        best = min(range(9), key=lambda i: sum(x for x in told_losses[i] if x is not None))
        low, high = grid[max(0, best - 1)], grid[min(8, best + 1)]
    assert got == pytest.approx(math.exp((low + high) / 2), rel=1e-9)
    assert metrics.fit_temperature(spark.createDataFrame([], shape)) == metrics.fit_temperature(spark.createDataFrame([(None, [1.0])], shape)) == 1.0
    one = df.select(metrics.nll(metrics.tempered(F.col("logits"), 2.0), F.col("label")).alias("l"))
    assert [r.l for r in one.collect()] == pytest.approx([loss(z, y, 2.0) for z, y in rows])
    assert [optimized(one).lower().count(x) for x in ("exp(", "array_max(")] == [1, 1]
