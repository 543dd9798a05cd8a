"""The pipeline's stages against what they are to do, on the smallest tables and odd rows."""

import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gradus.llm import mixing, quality_model, store

DATA = "/root/testdata/sf0.001"
SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
#: What the operators call their columns, and one name of the struct that a stage could pack rows into.
CLASHING = ("spans", "tails", "expected_grade", "component", "fp", "kept_doc", "kept_row", "copies", "x_doc", "ids", "offsets", "size")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, DATA).write.parquet(path)
        out.append((name, docs, docs := spark.read.parquet(path)))
    return out


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, clashing columns."""
    key = 'so token = "abcdefghijkl" it is'
    rows = [(None, None, None, None, None), (None, None, None, None, None), (None, "a b c d e", "en", None, 5), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "x y " * 3000, None, "s", None),
            (3, key, "en", "s", None), (3, key, "en", "s", None), (4, key, "en", "t", 7), (5, "one two three four five six", "en", "t", 7), (6, "one two three four five six", "fr", None, 7)]
    return spark.createDataFrame(rows, SHAPE).withColumns({c: F.concat(F.lit("kept "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in CLASHING})


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_columns_and_rows(stages):
    for name, before, after in stages[:-1]:
        assert after.columns == before.columns, name
    assert stages[0][2].count() < stages[0][1].count()
    ids = [r.doc_id for r in stages[1][2].collect()]
    assert len(ids) == len(set(ids)) and set(ids) <= {r.doc_id for r in stages[0][2].collect()}
    assert stages[2][2].count() == len(ids)


def test_quality_is_the_model(spark, stages):
    """What stays is what a plain sum of weights accepts."""
    _, before, after = stages[0]
    model = quality_model.fit(before, spark.read.parquet(f"{DATA}/labels.parquet"), quality_model.rating(), quality_model.GRADES)
    want = set()
    for r in before.collect():
        of, feature, value = quality_model.features([r.text])
        score = sum(float(v) * float(model.weights[f]) for f, v in zip(feature, value))
        if 1 / (1 + np.exp(model.thresholds[quality_model.GOOD - 1] - score)) >= quality_model.ACCEPT:
            want.add(r.doc_id)
    assert {r.doc_id for r in after.collect()} == want


def test_near_copies_by_brute_force(stages):
    from xxhash import xxh64_intdigest

    _, before, after = stages[1]
    docs = {r.doc_id: (r.text or "").encode() for r in before.collect()}
    prints = {}
    for i, text in docs.items():
        words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in text))
        shingles = [b" ".join(words[j : j + 3]) for j in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        bits = Counter(b for s in shingles for b in range(64) if xxh64_intdigest(s, 42) >> b & 1)
        prints[i] = sum(1 << b for b, n in bits.items() if 2 * n > len(shingles))
    parent = {i: i for i in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in docs:
        for b in docs:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert {r.doc_id for r in after.collect()} == {root(i) for i in docs}


def test_secrets_by_plain_patterns(spark):
    """Texts outside of secrets stay; plain patterns find none in what comes out."""
    before = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    after = stage("secret scan")(spark, before, DATA)
    found = {r.doc_id: r.text for r in after.collect()}
    plain = [r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6,}", r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"]
    changed = 0
    for r in before.collect():
        assert not any(re.search(p, found[r.doc_id]) for p in plain)
        kept = found[r.doc_id].split("[SECRET]")
        changed += len(kept) > 1
        at = 0
        for part in kept:
            assert (at := r.text.find(part, at)) >= 0
            at += len(part)
    assert changed > 0


def test_mix_takes_whole_documents(stages):
    """Each document as often as a plain fold over its source's keys says; words of a source come within half a document of its target for each cut."""
    _, before, after = stages[3]
    got, sizes, sources = Counter(r.doc_id for r in after.collect()), {}, defaultdict(list)
    for r in before.collect():
        sizes[r.doc_id] = len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        sources[r.source].append(r.doc_id)
    targets = {r.source: r.m_target for r in mixing.budgets(before.groupBy(F.col("source").alias("m_source")).agg(F.sum(mixing.words(F.col("text"))).alias("m_source_size"))).withColumnRenamed("m_source", "source").collect()}
    for source, ids in sources.items():
        total, largest = sum(sizes[i] for i in ids), max(sizes[i] for i in ids)
        assert abs(sum(got[i] * sizes[i] for i in ids) - targets[source]) <= largest / 2 + 1
        whole = int(targets[source] // total)
        assert all(got[i] in (whole, whole + 1) for i in ids)


def test_encoded_texts_decode(stages):
    import public_tokenizers
    import tiktoken
    from gradus.llm import bpe
    from gradus.llm.queries import rank_file

    _, before, after = stages[4]
    real = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(rank_file()), special_tokens={})
    want = Counter((r.doc_id, tuple(real.encode_ordinary(r.text or ""))) for r in before.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in after.collect()) == want and all(r.n_tokens == len(r.ids) for r in after.collect())


def told(rows):
    return Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars, *[r[c] for c in CLASHING]) for r in rows)


def test_near_dedup_of_odd_rows(spark, odd):
    got = [(r.doc_id, r.text) for r in stage("SimHash near-dedup")(spark, odd, DATA).collect()]
    texts = Counter(t or "" for _, t in got)
    # one of the texts without words, one of each other text, the smallest id of each; all else as it was
    assert texts == Counter(["", "a b c d e", "x y " * 3000, 'so token = "abcdefghijkl" it is', "one two three four five six"])
    assert {i for i, t in got} == {1, None, 2, 3, 5}
    named = odd.withColumn("doc_id", F.concat(F.lit("n"), F.col("doc_id").cast("string")))
    assert {r.doc_id for r in stage("SimHash near-dedup")(spark, named, DATA).collect()} == {"n1", None, "n2", "n3", "n5"}


def test_secrets_of_odd_rows(spark, odd):
    before, after = odd.collect(), stage("secret scan")(spark, odd, DATA).collect()
    hidden = lambda r: (r.text or "").replace('token = "abcdefghijkl', "[SECRET]")
    want = Counter((r.doc_id, None if r.text is None else hidden(r), r.lang, r.source, len(hidden(r)) if "SECRET" in hidden(r) else r.n_chars, *[r[c] for c in CLASHING]) for r in before)
    assert told(after) == want


def test_mix_of_odd_rows(spark, odd):
    after = told(stage("source mix")(spark, odd, DATA).collect())
    before = told(odd.collect())
    assert set(after) <= set(before) and all((k[1] or "").strip() for k in after) and all(n <= 2 * before[k] for k, n in after.items())
    again = told(stage("source mix")(spark, odd.repartition(3), DATA).collect())
    assert again == after


def test_quality_of_odd_rows(spark, odd):
    after, before = told(stage("quality classifier")(spark, odd, DATA).collect()), told(odd.collect())
    assert all(n == before[k] for k, n in after.items())  # repeated rows fare alike, and nothing changes
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    assert quality_model.fit(odd, labels.where("false"), quality_model.rating(), quality_model.GRADES).thresholds.tolist() == [0.0, 1.0]


def test_encode_of_odd_rows(spark, odd):
    got = Counter((r.doc_id, r.n_tokens > 0) for r in stage("byte-level BPE")(spark, odd, DATA).collect())
    assert got == Counter((r.doc_id, bool(r.text)) for r in odd.collect())


def test_empty_tables(spark, odd):
    for name, run in corpus_pipeline.STAGES:
        assert run(spark, odd.where("false"), DATA).count() == 0, name
    store.clear(spark)


def test_run_leaves_its_last_input_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "shared_folder", lambda _: str(tmp_path))
    monkeypatch.setattr(store, "shared_folder", lambda _: str(tmp_path))
    rows = corpus_pipeline.run(spark, DATA)
    assert len(os.listdir(tmp_path / spark.sparkContext.applicationId)) == 1
    assert rows.count() > 0 and rows.columns == ["doc_id", "source", "n_tokens", "ids"]


