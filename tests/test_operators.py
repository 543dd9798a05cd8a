import json
import random
import re

import pytest
from pyspark.sql import functions as F

from gradus import config
from gradus.functions import parse, row
from gradus.operators import augment, builders, compare, load, metrics, questions, relations, selection, splits, structured
from gradus.sources import tables

SHAPE = "dataset string, split string, pos long, state string, question string, options array<struct<id:string,text:string>>, label array<float>, group string, type string"


def test_spans_of_tags(spark):
    tokens = "a b c d e f g".split()
    tags = ["I-x", "B-x", "I-x", "I-y", "B-y", "O", "B-x"]
    df = spark.createDataFrame([(tokens, tags), ([], [])], "t array<string>, g array<string>")
    got = [[(s.kind, s.text) for s in r[0]] for r in df.select(row.spans_of_tags(F.col("t"), F.col("g"))).collect()]
    assert got == [[("x", "b c"), ("y", "e"), ("x", "g")], []]
    whole = spark.createDataFrame([(tokens, tags), (tokens, ["B-x", "I-x", "O", "B-y", "I-y", "O", "O"]), (tokens, ["B-x"]), ([], []), (None, None)], df.schema)
    got = [r[0] and [(s.kind, s.text) for s in r[0]] for r in whole.select(row.spans_of_tags(F.col("t"), F.col("g"), True)).collect()]
    assert got == [[], [("x", "a b"), ("y", "d e")], [], [], None]


def test_orders_of_a_generator(spark):
    def order(seed, items):
        out = list(items)
        random.Random(seed).shuffle(out)
        return out

    cases = [("a", list("abcdefg")), ("1:é", list("xyz")), ("b", []), ("c", ["p", "p", None])]
    df = spark.createDataFrame([*cases, (None, ["x"]), ("d", None)], "s string, v array<string>")
    got = [r[0] for r in df.select(row.generator_shuffled(F.col("v"), F.col("s"))).collect()]
    assert got == [*[order(s, v) for s, v in cases], None, None]


def test_soft_labels_have_a_share_for_each_option(spark):
    two = row.options_of(["yes", "no"])
    assert spark.range(1).select(row.distribution(two, F.array(F.lit(0.25), F.lit(0.75)))).first()[0] == [0.25, 0.75]
    with pytest.raises(Exception, match="as many shares as options: 1 for 2"):
        spark.range(1).select(row.distribution(two, F.array(F.lit(1.0)))).collect()


def test_tags_that_stand_alone(spark):
    df = spark.createDataFrame([("dentist or surgeon",), ("surgeon or urologist",), ("none",), (None,)], "t string")
    got = [r[0] for r in df.select(parse.tagged(F.col("t"), {"surgeon": "surg", "urologist": "urol"}, {"dentist": "^dent", "both": "^d"})).collect()]
    assert got == [["dentist"], ["surgeon", "urologist"], [], []]


def test_positives(spark):
    rows = [("a", [("y", " Yes "), ("n", "no")], [0.3, 0.7], [0.5, 0.5]), ("a", [("n", "нет"), ("y", "да")], [0.6, 0.4], [1.0, 0.0]), ("a", [("y", "yes"), ("n", "no")], None, [1.0, 0.0]), ("a", [("y", "yes")], [1.0], [1.0])]
    df = spark.createDataFrame(rows, "dataset string, options array<struct<id:string,text:string>>, probs array<double>, label array<double>")
    flat = lambda positive: [tuple(r)[1:] for r in metrics.positives(df, positive).collect()]
    assert flat("yes") == [(0.3, True), (0.4, False), (None, True), (1.0, True)] and flat("no") == [(0.7, True), (0.6, True), (None, False)]
    assert metrics.binary_summary(metrics.positives(df, "no")).collect() == [("a", 2, 1, 1.0)]


def test_shared_keys_go_from_the_less_held_out(spark):
    rows = [("d", 1, "test", "k"), ("d", 2, "train", "k"), ("d", 3, "validation", "k"), ("d", 4, "train", "m"), ("d", 5, "train", "m"), ("e", 6, "train", "k"), ("d", 7, "test", None), ("d", 8, "train", None)]
    df = spark.createDataFrame(rows, "dataset string, i int, split string, key string")
    assert sorted(r.i for r in splits.without_shared(df, "key").collect()) == [1, 4, 5, 6, 7, 8]
    parts = [r[0] for r in spark.range(3000).select(splits.split_by(F.col("id").cast("string"), {"test": 1, "validation": 2})).collect()]
    assert [round(parts.count(s) / 3000, 1) for s in ("test", "validation", "train")] == [0.1, 0.2, 0.7]


def test_histories_of_turns(spark):
    frame = lambda v: [("s", {"slot": [v]})]
    rows = [(1, 2, "USER", "c", frame("y")), (1, 0, "USER", "a", frame("x")), (1, 1, "SYSTEM", "b", []), (1, 3, "USER", None, frame("y")), (2, 0, "USER", None, frame("none"))]
    df = spark.createDataFrame(rows, "dialogue int, turn int, speaker string, utterance string, frames array<struct<service:string,slot_values:map<string,array<string>>>>")
    got = sorted((r.dialogue, r.turn, r["values"], r.history) for r in structured.dialogue_slots(df).collect())
    assert got == [(1, 0, ["x"], "USER: a"), (1, 2, ["y"], "USER: a\nSYSTEM: b\nUSER: c")]


def test_u_spans_gives_every_turn(spark):
    from gradus.plans.queries import QUERIES

    data = "/root/testdata/sf0.001"
    turns = lambda df: sorted(map(tuple, df.select("conv_id", "turn").collect()))
    want = turns(spark.read.parquet(f"{data}/conversations.parquet"))
    assert turns(QUERIES["u_spans"](spark, data)) == want and any(t for _, t in want)


def test_mentions(spark):
    df = spark.createDataFrame([("The other the, THE then.", "the")], "a string, b string")
    assert df.select(row.mentions(F.col("a"), F.col("b"))).first()[0] == 3


def test_unknown_label_raises(spark):
    df = spark.range(1).select(row.one_hot(row.options_of(["a", "b"]), F.lit("c")))
    with pytest.raises(Exception, match="no such option"):
        df.collect()


def test_regroup_keeps_groups_whole(spark):
    rng, rows = random.Random(3), []
    for i in range(300):
        rows.append(("d", rng.choice(["train", "dev", "test", "train_r1"]), i, f"s{rng.randrange(80)}", "q", [("a", "a"), ("b", "b")], [1.0, 0.0], rng.choice([None, "", f"g{rng.randrange(40)}"]), "choice"))
    got = splits.regroup(spark.createDataFrame(rows, SHAPE)).collect()
    best = {}
    prio = {"test": 0, "validation": 1, "train": 2}
    name = lambda s: {"dev": "validation", "test": "test"}.get(s, "train")
    key = lambda r: r[7] or "state:" + r[3]
    home = {}
    for r in rows:
        home[key(r)] = min(home.get(key(r), 2), prio[name(r[1])])
    for r in sorted(rows, key=lambda r: (prio[name(r[1])], r[2])):
        best.setdefault(r[3], r)
    assert {g.pos for g in got} == {r[2] for r in best.values()}
    assert all(prio[g.target] == home[key(rows[g.pos])] for g in got)


def test_class_names_are_whole_or_an_error(spark):
    assert builders.class_names(spark.range(1000), "id") == list(range(1000))
    with pytest.raises(ValueError, match="1,000"):
        builders.class_names(spark.range(1001), "id")


def test_text_choice_bounds_and_folds(spark):
    rows = spark.createDataFrame([(1, "Yes"), (2, "only")], "id long, answer string")
    pairs = [(1, w) for w in ["yes ", "no", "NO", "", "maybe", "never"]] + [(2, "ONLY")]
    got = builders.text_choice(rows, spark.createDataFrame(pairs, "id long, other string"), "id", "answer", "other", most=2).collect()
    assert len(got) == 1 and len(got[0].texts) == 3 and got[0].texts[got[0].place - 1] == "Yes"


def test_bounded_candidates_grow_with_rows(spark):
    rows = spark.range(500).select(F.col("id"), F.lit("k").alias("key"))
    pool = rows.select("key", F.col("id").alias("pid"), F.col("id").cast("string").alias("text"))
    n = builders.bounded_candidates(rows, pool, "id", "key", "pid", "text", reach=5).groupBy("id").count()
    assert n.agg(F.max("count"), F.min("count")).first() == (5, 5)


def test_average_precision_with_ties(spark):
    data = [("d", random.Random(i).randrange(5) / 4, random.Random(i + 99).random() < 0.3) for i in range(60)]
    got = metrics.average_precision(spark.createDataFrame(data, "d string, p double, gold boolean"), ("d",)).first().average_precision
    want = tp = up = 0
    for p in sorted({x[1] for x in data}, reverse=True):
        own = [x[2] for x in data if x[1] == p]
        tp, up = tp + sum(own), up + len(own)
        want += sum(own) * tp / up
    assert got == pytest.approx(want / tp)


def test_packed_batches_keep_the_budget(spark):
    df = spark.range(300).select("id", (F.pmod(F.col("id") * 37, F.lit(50)) + 1).cast("int").alias("size"))
    got = load.packed(df, "size", 200).groupBy("shard", "batch").agg((F.max("size") * F.count("*")).alias("cost"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in got) == 300 and all(r.cost <= 200 or r.n == 1 for r in got)


def test_no_import_of_the_optional_subpackage():
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "gradus"
    for p in root.rglob("*.py"):
        if p.parent.name != "llm":
            assert not re.search(r"gradus\.llm|from \.+llm", p.read_text())


def test_fragments_are_the_regex_boundaries(spark):
    texts = ["One. Two! Three", "a.\n\nb", "", "no end", "Is it? 5 yes.  Да. нет", "x. y. Z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for (got,), t in zip(df.select(parse.fragments(F.col("t"))).collect(), texts):
        ends = [0, *(m.end() for m in re.finditer(r"(?<=[.!?])\s+(?=[А-ЯЁA-Z0-9])|\n+", t)), len(t)]
        assert [(f.start, f.end, f.text) for f in got] == [(a, b, t[a:b].strip()) for a, b in zip(ends, ends[1:])]


def test_alias_groups_reach_through_others(spark):
    df = spark.createDataFrame([(list("abcdef"), [("a", "b"), ("c", "d"), ("d", "b")])], "i array<string>, l array<struct<subject:string,object:string>>")
    got = {frozenset(g) for g in df.select(parse.alias_groups(F.col("i"), F.col("l"))).first()[0]}
    assert got == {frozenset("abcd"), frozenset("e"), frozenset("f")}


def test_unique_objects(spark):
    text = "Ann works at Acme in Rome. Bob likes Oslo. Ann met Acme Ltd."
    ents = [("T1", "P", 0, "Ann"), ("T2", "ORG", 13, "Acme"), ("T3", "LOC", 21, "Rome"), ("T4", "P", 27, "Bob"), ("T5", "LOC", 37, "Oslo"), ("T6", "ORG", 51, "Acme Ltd")]
    lines = [f"{i}\t{k} {a} {a + len(t)}\t{t}" for i, k, a, t in ents] + ["T7\tLOC 0 3;4 6\tx", "R1\tIN Arg1:T1 Arg2:T3", "R2\tIN Arg1:T4 Arg2:T5", "R3\tAT Arg1:T1 Arg2:T2", "R4\tIN Arg1:T9 Arg2:T5", "R5\tIN Arg1:T1 Arg2:T3", "R6\tOTHER Arg1:T1 Arg2:T3"]
    df = spark.createDataFrame([(1, text, "\n".join(lines)), (2, text, ""), (3, None, None)], "id long, text string, notes string")
    got = {(r.kind, r.subject, r.object, tuple(r.others)) for r in structured.unique_objects(df, "id", "text", "notes", ["IN", "AT"], ["SAME"]).collect()}
    assert got == {("IN", "Ann", "Rome", ("Oslo",)), ("IN", "Bob", "Oslo", ("Rome",)), ("AT", "Ann", "Acme", ())}


def test_plain_table_rejects(spark):
    def cells(*values, head=False, span=1):
        return [(v, head, span, 1) for v in values]

    good = [cells("a", "b", head=True), cells("1", "x"), cells("2", " y  z ")]
    bad = [[], good[:2], [cells("a", "A", head=True), *good[1:]], [good[0], cells("1", "x", span=2), good[2]], [good[0], cells("1"), good[2]], [cells("a", "", head=True), *good[1:]], [cells("a", "b"), *good[1:]]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([good, *bad, None])], "i int, t array<array<struct<value:string,is_header:boolean,column_span:int,row_span:int>>>")
    got = [r[0] for r in df.select(parse.plain_table(F.col("t")), "i").orderBy("i").collect()]
    assert got[0].headers == ["a", "b"] and got[0].rows == [["1", "x"], ["2", "y z"]] and got[1:] == [None] * 8


def test_plain_table_of_odd_cells(spark):
    cell = lambda v, head=False, wide=1, high=1: (v, head, wide, high)
    heads, one, two = [cell("a", True), cell(" B\n", True)], [cell("K"), cell("1")], [cell(None), cell("")]
    fine = [([heads, one, two], (["a", "B"], [["K", "1"], [None, ""]], None)), ([heads, one, one], (["a", "B"], [["K", "1"]] * 2, None)),
            ([heads, [cell("1"), cell("x")], [cell("2"), cell("y")]], (["a", "B"], [["1", "x"], ["2", "y"]], 1)), ([heads, [cell("K"), cell("x")], [cell("\u212a"), cell("y")]], (["a", "B"], [["K", "x"], ["\u212a", "y"]], 1)),
            ([heads, *[[cell(str(i)), cell("0")] for i in range(39)]], (["a", "B"], [[str(i), "0"] for i in range(39)], 0))]
    odd = [[heads, one, [cell("2"), None]], [heads, one, None], [heads, [one[0]], [*two, one[1]]], [heads, one, [cell("2", None), cell("3")]], [heads, one, [cell("2", wide=None), cell("3")]],
           [heads, one, [cell("2", high=None), cell("3")]], [heads, one, [cell("2", high=2), cell("3")]], [heads, one, [cell("2", True), cell("3")]], [[cell("a", None), heads[1]], one, two],
           [[cell(None, True), heads[1]], one, two], [heads, *[one] * 40], [[], [], []], [None, None, None]]
    for whole in ("int", "bigint"):
        df = spark.createDataFrame([(i, t) for i, t in enumerate([*[t for t, _ in fine], *odd])], f"i int, t array<array<struct<value:string,is_header:boolean,column_span:{whole},row_span:{whole}>>>")
        got = df.select("i", parse.plain_table(F.col("t")).alias("p")).select("i", "p", parse.key_column(F.col("p")).alias("key")).orderBy("i").collect()
        assert [(r.p.headers, r.p.rows, r.key) for r in got[: len(fine)]] == [want for _, want in fine]
        assert [(r.p, r.key) for r in got[len(fine):]] == [(None, None)] * len(odd)


def test_evidence(spark):
    text = "Rome is old. Oslo is cold. Rome is big.\nIt rains."
    rows = [(1, text, "Q", [(27, "Rome")]), (2, text, "Q", [(3, "Rome")]), (3, text, " ", [(0, "Rome")]), (4, "One.", "Q", [(0, "One")]), (5, None, "Q", None)]
    df = spark.createDataFrame(rows, "id int, c string, q string, s array<struct<start:int,text:string>>")
    got = structured.evidence(df, F.col("c"), F.col("q"), F.col("s")).collect()
    assert len(got) == 1 and got[0].texts[got[0].place - 1] == "Rome is big." and sorted(got[0].texts) == ["It rains.", "Oslo is cold.", "Rome is big."]


def test_fewer_options_keep_the_answer(spark):
    options, label = [(c, c) for c in "abcde"], [0.0, 0.0, 1.0, 0.0, 0.0]
    df = spark.createDataFrame([(i, options, label) for i in range(300)] + [(300, options, [0.2] * 5), (301, options[:2], [1.0, 0.0])], "i int, options array<struct<id:string,text:string>>, label array<double>")
    got = augment.fewer_options(df, F.col("i").cast("string"), 0.5).orderBy("i").collect()
    sizes = [len(r.options) for r in got]
    assert sizes[300:] == [5, 2] and set(sizes[:300]) == {2, 3, 4, 5} and 100 < sizes[:300].count(5) < 200
    assert all(len(r.options) == len(r.label) and r.options[r.label.index(1.0)].id == "c" for r in got[:300])


def test_drawn_counts(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, "big").otherwise("small").alias("dataset"), "id")
    got = augment.drawn(df, "id", 4000, alpha=0.5, shares=4).groupBy("dataset").agg(F.sum("draws")).collect()
    n = dict(map(tuple, got))
    assert sum(n.values()) == 4000 and n["big"] / 4000 == pytest.approx(0.75, abs=0.03)  # 30 to 10


def test_archives_and_saved_splits(spark, tmp_path):
    import io
    import tarfile
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/one.jsonl", "﻿".encode() + b'{"k": 1}\r\n\n{"k": 2}')
        z.writestr("x/two.txt", "no")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("three.jsonl")
        info.size = 8
        t.addfile(info, io.BytesIO(b'{"k": 3}'))
    got = tables.json_members(spark, f"{tmp_path}/*[pz]", "k int").collect()
    assert sorted((r.member, r.k) for r in got) == [("three.jsonl", 3), ("x/one.jsonl", 1), ("x/one.jsonl", 2)]
    rows = [("d", "train", i, f"s{i}", "q", [("a", "a"), ("b", "b")], [1.0, 0.0], None, "choice") for i in range(3)]
    tables.save(spark.createDataFrame(rows, SHAPE), f"{tmp_path}/out")
    assert sorted((r.split, r.n) for r in tables.manifest(spark, f"{tmp_path}/out").collect()) == [("test", 0), ("train", 3), ("validation", 0)]
    assert tables.load(spark, f"{tmp_path}/out", "d", "test").count() == 0 and tables.load(spark, f"{tmp_path}/out", "d", "train").count() == 3


def test_settings_and_names():
    assert config.layered({"a": {"b": 1, "c": "x"}}, {"a": {"b": 2}}, ["a.c=y", "a.b=3"]) == {"a": {"b": 3, "c": "y"}}
    with pytest.raises(ValueError, match="no such setting: a.d"):
        config.layered({"a": {"b": 1}}, None, ["a.d=1"])
    assert selection.for_training([], ["x", "y"], {"y"}) == ["x"]
    with pytest.raises(ValueError, match="held out"):
        selection.for_training(["y"], ["x", "y"], {"y"})


def test_command_line(spark, tmp_path, capsys):
    from gradus.__main__ import main

    rows = [("d", "train", i, f"s{i}", "q", [("a", "a"), ("b", "b")], [1.0, 0.0], None, "choice") for i in range(200)]
    spark.createDataFrame(rows, SHAPE).write.parquet(f"{tmp_path}/in")
    main(["-s", "prepare.most=100", "prepare", f"{tmp_path}/in", f"{tmp_path}/out", "d"])
    main(["list", f"{tmp_path}/out"])
    assert "validation" in capsys.readouterr().out
    n = {r.split: r.n for r in tables.manifest(spark, f"{tmp_path}/out").collect()}
    assert n["train"] == 100 and n["test"] > 0 and n["validation"] > 0


def test_f1_without_hits(spark):
    """0 where nothing is hit, null where nothing is gold or predicted."""
    rows = [(0.97, False), (0.3, True), (0.2, False)]
    got = {round(r.threshold, 2): r for r in metrics.thresholds(spark.createDataFrame(rows, "p double, gold boolean")).collect()}
    assert got[0.5].tp == 0 and got[0.5].f1 == 0 and abs(got[0.25].f1 - 2 / 3) < 1e-9
    none = metrics.thresholds(spark.createDataFrame([(0.1, False)], "p double, gold boolean")).collect()
    assert all(r.f1 is None for r in none if r.threshold > 0.1)


def test_small_keys_keep_their_candidates(spark):
    rows = spark.createDataFrame([(i, f"k{i % 7}") for i in range(20)], "id long, key string")
    pool = spark.createDataFrame([(100 + i, f"k{i % 7}", f"t{i}") for i in range(20)], "pid long, key string, text string")
    got = builders.bounded_candidates(rows, pool, "id", "key", "pid", "text").groupBy("id").count().collect()
    assert {r.id: r["count"] for r in got} == {i: 3 if i % 7 < 6 else 2 for i in range(20)}
    many = builders.bounded_candidates(rows, pool, "id", "key", "pid", "text", circle=1, reach=1)
    assert many.count() == many.select("id").distinct().count() <= 20


def test_settings_of_groups():
    base = {"a": {"b": 1, "c": {}}, "d": [1]}
    assert config.layered(base, {"a": {"b": None}}, ['a={"b": 5}', "d=x y"]) == {"a": {"b": 5, "c": {}}, "d": "x y"} and base["a"]["b"] == 1
    with pytest.raises(ValueError, match="not name=value"):
        config.layered(base, None, ["a.b"])


def test_answers_of_the_baseline_add_up(spark):
    rows = spark.createDataFrame([("", None), ("a red hat", [("x", "red"), ("y", ""), ("z", "red hat")]), ("b", [("x", "q"), ("y", "q")])], "state string, criteria array<struct<key:string,text:string>>")
    probs = rows.withColumn("texts", questions.criteria_texts(F.col("criteria"))).withColumn("probs", questions.overlap_probs(F.col("state"), F.col("texts")))
    got = probs.select("texts", "probs", questions.shaped(F.col("criteria"), F.col("probs")).alias("a")).collect()
    assert all(abs(sum(r.probs) - 1) < 1e-9 for r in got)
    assert got[0].texts == ["yes", "no"] and got[0].a.noul == 0.5 and got[0].a.choice is None
    assert got[1].texts == ["x: red", "y", "z: red hat"] and got[1].a.choice == "z" and got[1].a.noul is None
    assert got[2].a.choice == "x" and got[2].a.confidence == 0.5
    with pytest.raises(Exception, match="at least 2 criteria"):
        spark.createDataFrame([([("x", "")],)], "criteria array<struct<key:string,text:string>>").select(questions.criteria_texts(F.col("criteria"))).collect()


def test_prompts_keep_the_query_whole(spark):
    def cut(n, q, budget):
        df = spark.createDataFrame([(list(map(str, range(n))), ["q"] * q)], "c array<string>, q array<string>")
        return df.select(questions.prompt(F.col("c"), F.col("q"), budget).alias("p")).first().p

    assert cut(0, 5, 5) == ["q"] * 5 and cut(0, 6, 5) is None
    assert cut(30, 4, 34) == [*map(str, range(30)), *["q"] * 4]
    assert cut(30, 4, 21) == [*map(str, range(8)), "\n...\n", *map(str, range(22, 30)), *["q"] * 4]
    assert cut(30, 4, 20) is None


def test_texts_within_texts_of_every_length(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["ab", "abc", "b", "ca", "x\ny", "zz."]) for _ in range(rng.randint(0, 12))) for _ in range(300)] + [None, ""]
    items = [" ".join(rng.choice(["ab", "abc", "b", "ca", "y", "zz."]) for _ in range(n)) for n in (1, 2, 2, 3, 4, 5, 6, 7, 7)] + [None, "x\ny ab", "b c", "abcdefghijkl"]
    docs = spark.createDataFrame([(i if i % 40 else None, t) for i, t in enumerate(texts)], "doc_id int, text string")
    for own in (items, [i for i in items if i and len(i.split()) > 3], []):
        got = relations.without_contained(docs, "doc_id", "text", spark.createDataFrame([(i,) for i in own], "item string"), "item").collect()
        want = [(i if i % 40 else None, t) for i, t in enumerate(texts) if t is None or not any(x is not None and x in t for x in own)]
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    every = relations.without_contained(docs, "doc_id", "text", spark.createDataFrame([("",)], "item string"), "item").collect()
    assert [r.text for r in every] == [None]


def test_judged_topics(spark):
    topics = spark.createDataFrame([(1, "q"), (2, " "), (3, "r"), (4, "s")], "topic int, query string")
    corpus = spark.createDataFrame([(1, "one"), (2, "two"), (3, "one"), (4, " ")], "passage int, text string")
    judge = lambda rows: spark.createDataFrame(rows, "topic int, passage int, relevance int")
    got = relations.judged(topics, judge([(1, 1, 1), (1, 2, 0), (1, 2, 0), (2, 1, 1), (3, 1, 1), (3, 3, 0), (4, 4, 1)]), corpus)
    assert [(r.topic, r.relevant, [tuple(p) for p in r.passages]) for r in got.orderBy("topic").collect()] == [(1, True, [(1, "one", 1), (2, "two", 0)]), (3, True, [(1, "one", 1), (3, "one", 0)])]
    made = relations.judged_choice(got, "none").collect()
    assert [(r.topic, sorted(r.texts), r.texts[r.place - 1]) for r in made] == [(1, ["none", "one", "two"], "one")]
    for bad in ([(1, 9, 1)], [(1, 1, 2)]):
        with pytest.raises(Exception, match="no such passage|relevance"):
            relations.judged(topics, judge(bad), corpus).collect()


def test_runs_are_found(spark, tmp_path):
    for run, stages, files in (("r1", ["a", "b"], ["a-test", "last-test"]), ("r2", ["a"], ["a-test", "last-test", "a-dev"]), ("r3", ["a"], [])):
        (tmp_path / run).mkdir()
        (tmp_path / run / "run.json").write_text(json.dumps({"stages": stages}, indent=1))
        for f in files:
            (tmp_path / run / f"{f}.json").write_text(json.dumps({"d": {"accuracy": 0.5, "from": f}, "macro": {"accuracy": 1}}, indent=1))
    got = compare.entries(spark, str(tmp_path)).orderBy("entry").collect()
    assert [(r.entry, r.dataset, r.metrics["from"], float(r.metrics["accuracy"])) for r in got] == [("r1 / a", "d", "a-test", 0.5), ("r1 / b", "d", "last-test", 0.5), ("r2 / a", "d", "a-test", 0.5)]


def test_board_order_and_table_lines(spark):
    scores = spark.createDataFrame([("a", "d", None, False), ("b", "d", 0.5, False), ("c", "d", 0.7, False), ("a", "e", 1.0, False), ("b", "e", 0.5, False), ("c", "e", 0.7, False)], "entry string, dataset string, accuracy double, benchmark boolean")
    board = compare.ordered(compare.leaderboard(scores)).collect()
    assert [r.entry for r in board] == ["c", "b", "a"] and board[2].macro != board[2].macro and board[2].wins == 1
    columns = {"dataset": F.col("dataset"), "n": F.col("accuracy")}
    assert compare.text_head(columns, ("n",)) == ["| dataset | n |", "|---|---:|"]
    assert {r.line for r in compare.text_rows(scores, columns).collect()} == {"| d | - |", "| d | 0.5 |", "| d | 0.7 |", "| e | 1.0 |", "| e | 0.5 |", "| e | 0.7 |"}


def test_epochs_show_each_row_once(spark):
    rows = spark.range(500).select(F.col("id"), (F.col("id") % 37 + 1).cast("int").alias("size"))
    first, again, second = (load.epoch(rows, "id", "size", 200, n).collect() for n in (0, 0, 1))
    assert sorted(r.id for r in first) == list(range(500))
    batches = {}
    for r in first:
        batches.setdefault((r.shard, r.batch), []).append(r.size)
    assert all(len(b) == 1 or max(b) * len(b) <= 200 for b in batches.values())
    at = lambda rows: {r.id: (r.shard, r.batch) for r in rows}
    assert at(first) == at(again) and at(first) != at(second)


def test_json_values_and_definitions(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n {"k": "x",\n "n": 1}, {"k": "y", "n": 2}]')
    (tmp_path / "b.json").write_text('{"k": "x",\n "n": 3}')
    rows = tables.json_files(spark, f"{tmp_path}/*.json", "k string, n bigint")
    defined = spark.createDataFrame([("x", "ex"), ("x", "ex")], "k string, what string")
    assert sorted((r.file, r.n, r.what) for r in tables.with_definitions(rows, defined, ["k"]).collect()) == [("a.json", 1, "ex"), ("b.json", 3, "ex")]


def test_records_and_own_options(spark):
    rows = spark.createDataFrame([(1, ["p", "q"], 2), (2, ["p"], 2), (3, [str(i) for i in range(27)], 1)], "id int, texts array<string>, place int")
    made = builders.own_options(rows, "d", F.lit("s"), F.lit("q"), F.col("texts"), F.col("place"), F.col("id")).collect()
    assert [(r.pos, [tuple(o) for o in r.options], r.label) for r in made] == [(1, [("A", "p"), ("B", "q")], [0.0, 1.0])]
    assert builders.recorded(rows, F.col("id").cast("string")).where("group = '2'").first().payload.texts == ["p"]
