"""Rings, global order, files that are written and read again, padded batches and noise, against plain Python."""

import json
import random
import zipfile
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gradus.functions import row
from gradus.operators import builders, collate, compare, numbered, policy, rings
from gradus.plans.drawn import p_sampled
from gradus.sources import runs, scratch, tables

DATA = "/root/testdata/sf0.001"
SHAPE = "dataset string, split string, pos long, state string, question string, options array<struct<id:string,text:string>>, label array<float>, group string, type string"


def samples(spark, rows):
    return spark.createDataFrame([(d, s, i, f"s{i}", "q", [("a", "a"), ("b", "b")], [1.0, 0.0], None, "choice") for d, s, i in rows], SHAPE)


def test_numbers_have_no_gap(spark):
    df = spark.createDataFrame([(i % 7, f"x{i}") for i in range(500)], "k int, v string").repartition(9)
    got = sorted((r.number, r.k, r.v) for r in numbered.numbered(df, "k", "v").collect())
    assert [g[0] for g in got] == list(range(500)) and [g[1:] for g in got] == sorted((r.k, r.v) for r in df.collect())
    assert numbered.numbered(df.where("false"), "k").count() == 0


def test_sampled_as_a_generator_does(spark):
    rows = [("a", "train", i) for i in range(300)] + [("b", "train", i) for i in range(40)] + [("b", "test", i * 3) for i in range(90)] + [(None, "test", i) for i in range(70)]
    got = defaultdict(list)
    for r in numbered.sampled(samples(spark, rows).repartition(5), 50).collect():
        got[r.dataset, r.split].append(r.pos)
    for key in {(d, s) for d, s, _ in rows}:
        own = [i for d, s, i in rows if (d, s) == key]
        want = own if len(own) <= 50 else [own[i] for i in sorted(random.Random(0).sample(range(len(own)), 50))]
        assert sorted(got[key]) == want
    own = defaultdict(list)
    for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").orderBy("doc_id").withColumn("b", row.bucket(F.concat(F.lit("split"), F.col("doc_id").cast("string")))).collect():
        own["test" if r.b < 10 else "validation" if r.b < 20 else "train"].append(r.doc_id)
    want = {s: ids if len(ids) <= 50 else [ids[i] for i in sorted(random.Random(0).sample(range(len(ids)), 50))] for s, ids in own.items()}
    got = defaultdict(list)
    for r in p_sampled(spark, DATA).collect():
        got[r.split].append(r.doc_id)
    assert {s: sorted(i) for s, i in got.items()} == want


@pytest.mark.parametrize("most", [1, 40, 1000])
def test_smallest(spark, most):
    rows = [(random.Random(i).choice(["a", "b", None]), i % 90, i) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, v int, i int")
    got = numbered.smallest(df, ("k",), row.sha1(F.col("v").cast("string")), most, "i").collect()
    hashes = {r.v: r.h for r in df.select("v", row.sha1(F.col("v").cast("string")).alias("h")).distinct().collect()}
    want = [r for k in ("a", "b", None) for r in sorted((r for r in rows if r[0] == k), key=lambda r: (hashes[r[1]], r[2]))[:most]]
    assert Counter(map(tuple, got)) == Counter(want)


def fold(lengths, budget):
    out, n, longest, number = [], 0, 0, -1
    for length in lengths:
        if not n or max(longest, length) * (n + 1) > budget:
            n, longest, number = 0, 0, number + 1
        n, longest = n + 1, max(longest, length)
        out.append(number)
    return out


@pytest.mark.parametrize("budget", [1, 60, 500, 100_000])
@pytest.mark.parametrize("kind", ["some", "one length", "mixed order"])
def test_batches_cross_ranges(spark, budget, kind):
    rng = random.Random(budget)
    sizes = [7 if kind == "one length" else rng.choice([None, 0, 1, rng.randrange(1, 30), rng.randrange(1, 300)]) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(sizes)), "id int, size int").repartition(6)
    order = ["id"] if kind == "mixed order" else [F.asc_nulls_first("size"), "id"]
    got = {r.id: r.batch for r in numbered.batches(df, "size", budget, *order).collect()}
    ids = range(1500) if kind == "mixed order" else sorted(range(1500), key=lambda i: (sizes[i] is not None, sizes[i] or 0, i))
    assert [got[i] for i in ids] == fold([sizes[i] or 0 for i in ids], budget)


def test_batches_of_odd_tables(spark):
    df = spark.createDataFrame([(1, 5, 3), (1, 5, 3), (None, None, 4)], "id int, size int, batch int").drop("batch")
    assert sorted(r.batch for r in numbered.batches(df, "size", 10).collect()) == [0, 0, 1]
    assert numbered.batches(df, "size", 15).select("batch").distinct().count() == 1
    assert numbered.batches(df.where("false"), "size", 10).count() == 0


def test_a_range_is_a_function_of_its_start():
    rng = random.Random(2)
    for _ in range(200):
        lengths, budget = [rng.randrange(0, 20) for _ in range(rng.randrange(1, 40))], rng.randrange(1, 120)
        n, longest = rng.randrange(0, 5), rng.randrange(0, 20)
        first, begun, rows, most = numbered.summed_up(lengths, budget)
        number, i, n0, l0 = 0, 0, n, longest
        while i < len(first) and n and max(longest, first[i]) * (n + 1) <= budget:
            n, longest, i = n + 1, max(longest, first[i]), i + 1
        if i < len(begun):
            number, n, longest = begun[i], rows[i], most[i]
        k, m, fresh = n0, l0, 0
        for x in lengths:
            if not k or max(m, x) * (k + 1) > budget:
                k, m, fresh = 0, 0, fresh + 1
            k, m = k + 1, max(m, x)
        assert (number, n, longest) == (fresh, k, m)


def test_circles(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 50}") for i in range(300)] + [(900, None), (901, "none")], "id long, key string")
    pool = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 50}", f"t{i}") for i in range(600)], "pid long, key string, text string")
    got = rings.circled(rows, pool, "id", "key", "pid", "text", 6, circle=40).collect()
    assert len(got) == 302
    for r in got:
        entries = {(p, t) for p, k, t in pool.collect() if k == r.key} if r.id == 900 else None
        assert len({d.id for d in r.drawn}) == len(r.drawn) and (r.id < 900) == bool(r.drawn) and entries in (None, set())
    assert all(len(r.drawn) == 6 for r in got if r.key == "hot")


@pytest.mark.parametrize("n", [400, 800])
def test_rings_jump_over_the_own_group(spark, n):
    """A page with nearly all rows of a shape, and one row of another page: every row finds one; work grows in line with the rows."""
    rows = [(i, "shape", "hot" if i else "other", f"s{i}") for i in range(n)] + [(n + i, f"x{i % 20}", f"p{i % 60}", f"e{i}") for i in range(200)] + [(-1, "alone", "p", "z"), (-2, None, "p", "z"), (-3, "shape", None, "z")]
    df = spark.createDataFrame(rows, "id long, shape string, page string, said string")
    got = {r.id: r for r in rings.ringed(df, df, "id", "shape", "page", "said", 4).collect()}
    assert len(got) == len(rows)
    others = defaultdict(set)
    for _, shape, page, said in rows:
        if shape and page:
            others[shape].add((page, said))
    for i, shape, page, _ in rows:
        far = {x for x in others[shape] if x[0] != page} if shape else set()
        drawn = [(d.id, d.entry) for d in got[i].drawn]
        assert len(drawn) == min(4, len(far)) == len(set(drawn)) and set(drawn) <= far
    assert sum(len(r.drawn) for r in got.values()) <= 4 * len(rows)


def test_tiers_fill_up(spark):
    rows = spark.createDataFrame([(1, "a", "x", 3), (2, "a", "x", 1), (3, "b", "x", 3), (4, "c", "y", 2), (5, "c", "y", None)], "id long, near string, far string, want int").withColumn("body", F.concat(F.lit("t"), F.col("id").cast("string")))
    draw = lambda key: lambda short: rings.circled(short, rows.where("id < 5"), "id", key, "body", "body", 8)
    got = {r.id: [(f.entry, f.tier) for f in r.found] for r in rings.tiered(rows, "want", [draw("near"), draw("far")], lambda e: e != F.col("body")).collect()}
    assert got[1][0] == ("t2", 1) and got[1][1:] == [("t3", 2)] and got[2] == [("t1", 1)]
    assert sorted(got[3]) == [("t1", 2), ("t2", 2)] and got[4] == [] and got[5] == []


def test_drawn_choice_is_text_choice(spark):
    rows = spark.createDataFrame([(1, "Yes"), (2, "no"), (3, "x")], "id long, answer string")
    pairs = [(1, c) for c in ["a", "A ", "b", "yes", " ", "c", "d"]] + [(2, "NO"), (2, "a"), (3, "x ")]
    df = spark.createDataFrame(pairs, "id long, other string")
    lists = df.groupBy("id").agg(F.collect_list("other").alias("o"))
    one = {tuple(r) for r in builders.text_choice(rows, df, "id", "answer", "other", most=3).select("id", F.array_join("texts", "|"), "place").collect()}
    two = {tuple(r) for r in builders.drawn_choice(rows.join(lists, "id"), "id", "answer", F.col("o"), most=3).select("id", F.array_join("texts", "|"), "place").collect()}
    assert one == two and len(one) == 2


def test_members_of_an_archive_are_tasks_apart(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "many.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(200):
            z.writestr(f"d/{i}.jsonl", "\n".join(json.dumps({"k": i, "n": j}) for j in range(i % 4)))
    lines = tables.members(spark, str(tmp_path / "many.zip"), ".jsonl", tasks=8)
    assert lines.select(F.spark_partition_id()).distinct().count() > 4
    got = Counter((r.k, r.n) for r in tables.json_members(spark, str(tmp_path / "many.zip"), "k int, n int").collect())
    assert got == Counter((i, j) for i in range(200) for j in range(i % 4))


def test_plain_tar_is_read_by_places(spark, tmp_path):
    import io
    import tarfile

    with tarfile.open(tmp_path / "a b.tar", "w") as t:
        for name, data in (("one.txt", b"a\r\nb"), ("sub/two.txt", b""), ("sub/three.txt", "é\n".encode()), ("four.bin", b"x")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    got = sorted((r.member, r.line_no, r.line) for r in tables.members(spark, str(tmp_path / "*.tar"), ".txt").collect())
    assert got == [("one.txt", 0, "a"), ("one.txt", 1, "b"), ("sub/three.txt", 0, "é")]


def test_archives_of_stores_that_tasks_cannot_open(spark, tmp_path, monkeypatch):
    import gzip
    import io
    import tarfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/one.txt", "\ufeffa\nb")
        z.writestr("x/two.bin", "no")
    plain = io.BytesIO()
    with tarfile.open(fileobj=plain, mode="w") as t:
        info = tarfile.TarInfo("three.txt")
        info.size = 3
        t.addfile(info, io.BytesIO(b"c\xff\n"))
    (tmp_path / "b.tar.gz").write_bytes(gzip.compress(plain.getvalue()))
    (tmp_path / "c.tar").write_bytes(plain.getvalue())
    read = lambda: Counter((r.member, r.line_no, r.line) for r in tables.members(spark, f"{tmp_path}/*", ".txt").collect())
    by_place = read()
    assert by_place == Counter({("x/one.txt", 0, "a"): 1, ("x/one.txt", 1, "b"): 1, ("three.txt", 0, "c\ufffd"): 2})
    monkeypatch.setattr(tables, "SEEKABLE", ())
    assert read() == by_place


def test_builds_stand_beside_each_other(spark, tmp_path):
    path = str(tmp_path / "built")
    first = [("a", "train", i) for i in range(5)] + [("a", "test", 9)] + [("1", "train", i) for i in range(3)]
    tables.save(samples(spark, first), path)
    tables.save(samples(spark, [("a", "train", 50), ("b", "dev", 1)]), path)
    n = {(r.dataset, r.split): r.n for r in tables.manifest(spark, path).collect()}
    assert n == {("a", "train"): 1, ("a", "test"): 0, ("a", "validation"): 0, ("1", "train"): 3, ("1", "test"): 0, ("1", "validation"): 0, ("b", "dev"): 1, ("b", "train"): 0, ("b", "test"): 0, ("b", "validation"): 0}
    assert [r.pos for r in tables.load(spark, path, "a", "train").collect()] == [50] and tables.load(spark, path, "a", "test").count() == 0
    assert sorted(r.pos for r in tables.load_all(spark, path).where("dataset = '1'").collect()) == [0, 1, 2]
    with pytest.raises(ValueError, match="not built: c"):
        tables.load(spark, path, "c", "train")

    broken = samples(spark, [("a", "train", i) for i in range(60)]).repartition(4).withColumn("state", F.when(F.col("pos") == 41, F.raise_error(F.lit("half-way"))).otherwise(F.col("state")))
    with pytest.raises(Exception, match="half-way"):
        tables.save(broken, path)
    assert [r.pos for r in tables.load(spark, path, "a", "train").collect()] == [50]
    orphans = set(scratch.listed(spark, f"{path}/builds")) - {r.build for r in tables.manifest(spark, path).collect()}
    assert set(tables.sweep(spark, path)) == orphans and tables.load_all(spark, path).count() == 5


def test_prepare_twice(spark, tmp_path):
    from gradus.__main__ import main

    samples(spark, [(d, "train", i) for d in "de" for i in range(120)]).write.parquet(f"{tmp_path}/in")
    main(["prepare", f"{tmp_path}/in", f"{tmp_path}/out"])
    main(["-s", "prepare.most=50", "prepare", f"{tmp_path}/in", f"{tmp_path}/out", "d"])
    n = {(r.dataset, r.split): r.n for r in tables.manifest(spark, f"{tmp_path}/out").collect()}
    assert n["d", "train"] == 50 and n["e", "train"] > 50


def test_runs_as_files(spark, tmp_path):
    from gradus.__main__ import main

    lines = lambda rows: spark.createDataFrame(rows, "run string, stage string, part string, dataset string, options array<string>, probs array<double>, label array<double>")
    two = lambda run, stage, dataset, p: (run, stage, "test", dataset, ["a", "b"], [p, 1 - p], [1.0, 0.0])
    runs.save_predictions(lines([two("r1", "one", "d", 0.9), two("r1", "one", "d", 0.2), two("r1", "one", "e", 0.9), two("r2", "one", "d", 0.4)]), f"{tmp_path}/runs")
    runs.save_predictions(lines([two("r1", "one", "e", 0.1)]), f"{tmp_path}/runs")
    got = sorted((r.run, r.dataset, r.probs[0]) for r in runs.predictions(spark, f"{tmp_path}/runs").collect())
    assert got == [("r1", "d", 0.2), ("r1", "d", 0.9), ("r1", "e", 0.1), ("r2", "d", 0.4)]
    for stage in ("one", "two"):
        rows = spark.createDataFrame([("r1", stage, "d", 0.5, None), ("r1", stage, "e", 0.0, 1.5)], "run string, stage string, dataset string, accuracy double, nll double")
        runs.save_metrics(rows, f"{tmp_path}/runs", "test", ("accuracy", "nll"))
    assert json.loads((tmp_path / "runs/r1/run.json").read_text()) == {"stages": ["one", "two"]}
    assert json.loads((tmp_path / "runs/r1/two-test.json").read_text()) == {"d": {"accuracy": 0.5}, "e": {"accuracy": 0.0, "nll": 1.5}}
    entries = compare.entries(spark, f"{tmp_path}/runs")
    assert sorted((r.entry, r.dataset, r.metrics.get("nll")) for r in entries.collect()) == [("r1 / one", "d", None), ("r1 / one", "e", "1.5"), ("r1 / two", "d", None), ("r1 / two", "e", "1.5")]
    spark.createDataFrame([("d", [0.9, 0.1], [1.0, 0.0], False), ("e", [0.2, 0.8], [1.0, 0.0], True)], "dataset string, probs array<double>, label array<double>, benchmark boolean").write.parquet(f"{tmp_path}/rows")
    main(["eval", f"{tmp_path}/rows", f"{tmp_path}/runs", "--run", "r3", "--stage", "final"])
    body = json.loads((tmp_path / "runs/r3/final-test.json").read_text())
    assert body["d"]["accuracy"] == 1.0 and body["e"]["accuracy"] == 0.0 and set(body) == {"d", "e", "macro", "benchmark_macro"}
    assert {r.entry for r in compare.entries(spark, f"{tmp_path}/runs").collect()} == {"r1 / one", "r1 / two", "r3 / final"}


def test_sequences_and_padding(spark):
    marks = collate.Marks(1, 2, 3, 4, 5, (6,), 0)
    rows = [(1, list(range(100, 103)), [50], [[7], [8, 9]], [1.0, 0.0], 0), (2, list(range(100, 160)), [50, 51], [[7], [], [9]], [0.0, 0.5, 0.5], 0), (3, list(range(100, 160)), [50] * 30, [[7], [8]], [1.0, 0.0], 0), (4, [], [50], [[7], [8]], [1.0, 0.0], 1), (5, None, [1], [[1]], [1.0], 1)]
    df = spark.createDataFrame(rows, "id int, state array<int>, question array<int>, options array<array<int>>, label array<double>, batch int")
    made = {r.id: (r.ids, r.closes) for r in collate.assembled(df, 36, marks).collect()}
    assert made[1] == ([1, 100, 101, 102, 2, 50, 3, 7, 4, 3, 8, 9, 4, 5], [8, 12])
    ids, closes = made[2]
    keep = 36 - (3 + 2 + 8) - 1
    assert ids == [1, *range(100, 100 + keep // 2), 6, *range(160 - (keep - keep // 2), 160), 2, 50, 51, 3, 7, 4, 3, 4, 3, 9, 4, 5] and len(ids) == 36 and [ids[c] for c in closes] == [4, 4, 4]
    assert made[3] == (None, None) and made[4] == ([1, 2, 50, 3, 7, 4, 3, 8, 4, 5], [5, 8]) and made[5] == (None, None)
    batches = collate.collated(collate.assembled(df, 36, marks), "batch", "id")
    got = {r.batch: r for r in batches.collect()}
    assert got[0].rows == [1, 2] and got[0].width == 36 and got[0].slots == 3 and all(len(x) == 36 for x in got[0].ids) and got[0].open == [[True, True, False], [True] * 3] and got[0].label[0] == [1.0, 0.0, 0.0]
    assert sum(got[0].there[0]) == 14 and got[0].there[0][:14] == [1] * 14
    back = {r.row: (r.ids, r.closes, r.label) for r in collate.separate(batches, "batch").collect()}
    assert back == {i: (*made[i], r[4]) for r in rows if made[i := r[0]][0]}


def test_noise(spark):
    drawn = spark.range(4000).select(policy.noise(F.concat(F.lit("s"), F.col("id").cast("string")), 3, F.lit(4), 0.5).alias("e"), policy.normal(F.col("id").cast("string")).alias("x"))
    rows = drawn.collect()
    assert rows == drawn.collect()
    x = [r.x for r in rows]
    assert abs(sum(x) / 4000) < 0.06 and abs(sum(v * v for v in x) / 4000 - 1) < 0.08 and abs(sum(v**3 for v in x) / 4000) < 0.2 and abs(sum(v**4 for v in x) / 4000 - 3) < 0.5
    flat = [v for r in rows for g in r.e for v in g]
    assert all(abs(sum(g)) < 1e-9 and len(g) == 4 for r in rows for g in r.e)
    assert abs(sum(v * v for v in flat) / len(flat) - 0.25 * 3 / 4) < 0.01  # centred over four
    assert len({round(v, 12) for v in flat}) == len(flat)


def test_policy_of_odd_rows(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0], [1.0, 0.0]), (2, [3.0], [1.0]), (3, None, None), (4, [], [])], "id long, logits array<double>, label array<double>")
    got = {r.id: r for r in policy.policy(df, F.col("id").cast("string"), 5, 0.3, 0.5, 0.1).collect()}
    assert len(got[1].rewards) == 5 and abs(sum(got[1].advantages)) < 1e-6 and got[1].loss is not None
    assert got[2].advantages == [0.0] * 5 and got[3].loss is None and got[4].loss is None
    assert policy.sigma_at(0, 11, 1.0, 0.5) == 1.0 and policy.sigma_at(10, 11, 1.0, 0.5) == 0.5
