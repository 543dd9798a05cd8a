"""Centroid clustering, sharding and phrase collocations against brute force, on small and odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.llm import clustering, collocations, queries, sharding

DATA = "/root/testdata/sf0.001"


def lloyd(rows, k, rounds, dim):
    """Every vector against every centroid, in plain integers."""
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    for i in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in kept]
        if i < rounds:
            for n in range(len(centroids)):
                own = [v for (_, v), (_, m) in zip(kept, near) if m == n]
                centroids[n] = [sum(c) // len(own) for c in zip(*own)] if own else centroids[n]
    return Counter((i, n, d) for (i, _), (d, n) in zip(kept, near)), centroids


@pytest.mark.parametrize("k", [1, 5, 40])
def test_clusters(spark, k):
    rng = random.Random(k)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.3, 1.0]) for _ in range(4)]) for i in range(150)]
    rows += [(7, [0.5, 0.5, -0.5, 1.0]), (7, [0.5, 0.5, -0.5, 1.0]), (None, [0.1, 0.2, 0.3, 0.4]), (None, None), (200, [1.0]), (201, [None, 1.0, 1.0, 1.0]), (202, [float("nan")] * 4), (203, [float("inf")] * 4), (204, [])]
    vectors = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<double>, cluster int").repartition(3)
    found, centroids = clustering.clusters(vectors, k, dim=4)
    want, means = lloyd(rows, k, 3, 4)
    assert Counter(tuple(r) for r in found.collect()) == want
    assert centroids.tolist() == means


def test_few_or_no_vectors(spark):
    vectors = spark.createDataFrame([("a", [0.5, 1.0]), ("b", [0.5, 1.0])], "vec_id string, embedding array<float>")
    found, centroids = clustering.clusters(vectors, 16, dim=2)
    assert sorted(tuple(r) for r in found.collect()) == [("a", 0, 0), ("b", 0, 0)] and len(centroids) == 2
    found, centroids = clustering.clusters(vectors.where("false"), 16, dim=2)
    assert found.count() == 0 and len(centroids) == 0
    with pytest.raises(Exception, match="too large"):
        clustering.clusters(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>"), dim=2)[0].count()


def test_scan_stops_strictly_beyond():
    """A centroid at exactly twice the distance is a tie and has to be met; what lies beyond is left alone."""
    x, centroids = np.array([[5, 0]]), np.array([[10, 0], [0, 0], [16, 0]])
    near, least = clustering.scan(x, np.array([0]), centroids)
    assert (near.tolist(), least.tolist()) == ([0], [25])
    near, least = clustering.scan(x, np.array([1]), centroids)
    assert (near.tolist(), least.tolist()) == ([0], [25])


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, shard int, slot string, size int, virtual_slot int")


def level(bytes_of, shards):
    """The fullest and the emptiest shard."""
    sums = Counter()
    for shard, n in bytes_of:
        sums[shard] += n
    return max(sums[s] for s in range(shards)) - min(sums[s] for s in range(shards))


def test_shards(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, "é" * rng.randrange(400), "en", 1, "x", 1, 1) for i in range(900)]
    rows += [(None, None, None, 1, "x", 1, 1)] * 400 + [(4, "same", "en", 1, "x", 1, 1)] * 300 + [(4, "", "en", 1, "x", 1, 1), (2000, "w" * 9000, "en", 1, "x", 1, 1)]
    docs = documents(spark, rows).repartition(5)
    placed = sharding.sharded(docs, str(tmp_path / "map")).collect()
    sizes = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in placed) == sizes
    slots = defaultdict(list)
    for r in placed:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(r["size"] for r in placed) / 16
    assert level([(r.shard, r["size"]) for r in placed if r["size"] < mean], 15 if mean < 9001 else 16) <= mean
    assert max(Counter(r.shard for r in placed if r.doc_id is None).values()) < 100  # copies of one row spread
    again = sharding.sharded(docs.repartition(2), str(tmp_path / "again"))
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, placed))


def test_rebalance(spark, tmp_path):
    rng = random.Random(4)
    held = {i: rng.choice([10, 50, 400]) * rng.randrange(1, 9) for i in range(0, 512, 2)}
    bytes_ = spark.createDataFrame(list(held.items()), "virtual_slot int, bytes long")
    path = str(tmp_path / "map")
    sharding.store_map(sharding.first_map(spark, 8, 512), path, 1)
    first = {r.virtual_slot: r.shard for r in sharding.load_map(spark, path).collect()}
    sharding.store_map(sharding.rebalanced(sharding.load_map(spark, path), bytes_, 8), path, 2)
    sharding.store_map(sharding.rebalanced(sharding.load_map(spark, path), bytes_, 9), path, 3)
    maps = {v: {r.virtual_slot: r.shard for r in sharding.load_map(spark, path, v).collect()} for v in (1, 2, 3)}
    assert maps[1] == first and all(sorted(m) == list(range(512)) for m in maps.values())
    of = lambda m: [(m[s], n) for s, n in held.items()]
    assert level(of(maps[2]), 8) <= min(held.values()) * 2 and level(of(maps[3]), 9) <= min(held.values()) * 2
    moved = sum(n for s, n in held.items() if maps[2][s] != maps[3][s])
    assert moved <= 1.5 * sum(held.values()) / 9
    # what a plain greedy fold gives from what stayed
    share, stays, load = sum(held.values()) / 8, {}, [0] * 8
    for s in range(8):
        for slot in sorted((x for x in first if first[x] == s), key=lambda x: (-held.get(x, 0), x)):
            if load[s] + held.get(slot, 0) > share:
                break
            load[s] += held.get(slot, 0)
            stays[slot] = s
    for slot in sorted((x for x in first if x not in stays), key=lambda x: (-held.get(x, 0), x)):
        s = load.index(min(load))
        load[s] += held.get(slot, 0)
        stays[slot] = s
    assert maps[2] == stays
    with pytest.raises(Exception, match="exist"):
        sharding.store_map(sharding.first_map(spark, 8, 512), path, 3)


def test_shards_as_files(spark, tmp_path):
    rows = [(i % 40, f"text {i % 30}", "en", 1, "x", 1, 1) for i in range(200)] + [(None, None, None, 1, "x", 1, 1)] * 9
    docs, path = documents(spark, rows), str(tmp_path / "map")
    placed = sharding.sharded(docs, path, 4)
    sharding.write_shards(docs, sharding.load_map(spark, path), str(tmp_path / "files"))
    written = spark.read.parquet(str(tmp_path / "files"))
    assert Counter(tuple(r)[:2] for r in written.select(*docs.columns).collect()) == Counter(r[:2] for r in rows)
    count = lambda df, c: Counter((r.doc_id, r[c]) for r in df.select("doc_id", c).collect())
    assert count(written, "shard_no") == count(placed, "shard")


def test_no_records(spark, tmp_path):
    docs = documents(spark, [(1, "a", "en", 1, "x", 1, 1)]).where("false")
    assert sharding.sharded(docs, str(tmp_path / "map")).count() == 0
    assert sharding.load_map(spark, str(tmp_path / "map")).count() == sharding.SLOTS


def test_op12(spark):
    rows = queries.QUERIES["op12_sharding"](spark, DATA).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in rows} == {i: (len(t) + 1, zlib.crc32(t)) for i, t in texts.items()} and len(rows) == len(texts)
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
    largest, mean = max(map(len, texts.values())) + 1, sum(len(t) + 1 for t in texts.values()) / 16
    assert level([(r.shard, r["size"]) for r in rows], 16) <= max(largest, mean)


def phrases(rows, depth, least, top):
    """Counts of all phrases, one by one."""
    counts, totals = Counter(), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for n in range(1, depth + 1):
                for i in range(len(words) - n + 1):
                    counts[lang or "und", tuple(words[i : i + n])] += 1
    often = {p: n for p, n in counts.items() if n >= least and len(p[1]) > 1}
    out = []
    for lang in totals:
        left = []
        for (own, p), a in often.items():
            if own == lang:
                inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: E731, B023
                if not any(x == lang and len(q) > len(p) and inside(q) and 100 * n >= 50 * a for (x, q), n in often.items()):
                    score, k = min((1000000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p)))
                    left.append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(left)[:top])]
    return sorted(out)


@pytest.mark.parametrize("depth, least, top, shard", [(3, 10, 2000, 1 << 22), (4, 3, 7, 300), (2, 10, 50, 60)])
def test_phrases(spark, depth, least, top, shard):
    rng = random.Random(depth)
    words = ["a", "b", "Ab", "é", "É", "x\x1cy", "don't", "中文", " "]
    rows = [(rng.choice(["en", "d\x00e", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ". ", "\n", ",,", "  ", "\x0b", "!"]) for _ in range(rng.randrange(60)))) for _ in range(120)]
    rows += [("en", None), (None, ""), ("fr", " \n.\t"), ("de", "a a a a " * 400), ("de", "long piece " * 200 + "."), ("en", rows[3][1]), ("en", rows[3][1])]
    docs = spark.createDataFrame([(l, t, 1, "z") for l, t in rows], "lang string, text string, n int, phrase string").repartition(3)
    got = sorted(tuple(r) for r in collocations.mined(docs, depth, least, top, shard=shard).collect())
    assert got == phrases(rows, depth, least, top)


def test_no_phrases(spark):
    docs = spark.createDataFrame([("en", "a b c"), (None, None)], "lang string, text string")
    assert collocations.mined(docs).count() == 0 and collocations.mined(docs.where("false")).count() == 0


def test_parts_end_with_pieces():
    text = b"one two. three four five six seven, eight"
    parts = list(collocations._parts(text, 12))
    assert b"".join(parts) == text.translate(collocations._FOLDED)
    assert all(p.endswith(collocations._BREAK) for p in parts[:-1]) and len(parts) == 3


def test_automaton_counts():
    rng = random.Random(1)
    codes = np.array([rng.choice([-1, 0, 1, 2]) for _ in range(400)])
    found = collocations.Automaton(codes, 3, 4)
    pieces = [[int(c) for c in p.split()] for p in " ".join(map(str, codes)).split("-1")]
    for n in range(1, 5):
        want = Counter(tuple(p[i : i + n]) for p in pieces for i in range(len(p) - n + 1))
        strings = [()] * 1
        for level in range(n):
            strings = [((*strings[p], int(w)) if level else (int(w),)) for p, w in zip(found.prefix[level], found.word[level])]
        assert {s: c for s, c in zip(strings, found.count[n - 1].tolist()) if c} == want
