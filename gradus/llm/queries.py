"""The queries of the operators and their SQL. A query applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm import bpe, chaining, chat, clustering, collocations, mixing, quality_model, rules, secret_scan, sharding, simhash, suffix_dedup, topk
from gradus.llm.store import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def rank_file(name: str = "byte_bpe_50k.tiktoken") -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = rank_file()
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks).select("doc_id", "ids")
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return bpe.decode(encoded, ranks).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(ids).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    formatted = chat.render(chat.reconstruct(chat.as_events(rows.unionByName(planted)), dealt=True))
    back = chat.read_back(formatted)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join("loss_texts", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), digest(turns).alias("turns_sha256"), F.length(learnt).cast("long").alias("loss_chars"),
        digest(learnt).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return left.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), digest(F.col("kept")).alias("kept_sha256"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"), quality_model.rating(), quality_model.GRADES)
    scored = quality_model.score(docs, model)
    good = F.element_at("tails", quality_model.GOOD)
    return scored.select("doc_id", "expected_grade", good.alias("p_good"), (good >= quality_model.ACCEPT).alias("kept"))


def op7_substring_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.fuzzy_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [r.kind for r in secret_scan.BASE]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in base]
    return scanned.select("doc_id", *counts, digest(secret_scan.written(F.col("spans"), base)).alias("base_sha256"), secret_scan.written(F.col("spans")).alias("spans"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = rules.cascade(docs, measures=rules.MEASURES)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", *rules.MEASURES, failed.alias("base_failed"), "kept")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt, centroids = clustering.clusters(table(spark, sf_dir, "embeddings"))
    named = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    sums = {r.cluster: int(r.n) for r in dealt.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()}  # a row for each centroid
    of = lambda values: F.element_at(F.array(*map(F.lit, values or [None])), F.col("cluster") + 1)
    inertia = of([sums.get(c, 0) for c in range(len(named))]).cast("long").alias("cluster_inertia")
    return dealt.select("vec_id", "cluster", "distance", inertia, F.lit(sum(sums.values())).cast("long").alias("inertia"), of(named).cast("string").alias("centroid_sha256"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    laid = sharding.sharded(docs, f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}")
    return laid.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mined(table(spark, sf_dir, "documents").select("lang", "text"))


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_simhash, op3_exact_top_k, op4_chat_formatting, op5_suffix_array_dedup, op6_quality_classifier, op7_substring_chaining, op8_source_mix, op9_secret_scan, op10_quality_rules, op11_centroid_clustering, op12_sharding, op13_phrase_collocations)}

SQL: dict[str, str] = {}

_SPACES = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL["op3_exact_top_k"] = """
WITH scaled AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM scaled q JOIN scaled c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

# The template's marks take 23 characters a turn; a backslash is written twice, a control string gets one.
SQL["op4_chat_formatting"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), measured AS (
  SELECT *, len(regexp_extract_all(s, '<\||</?s>|<</?SYS>>|\[/?INST\]')) + length(s) - length(replace(s, '\', '')) + length(s) AS written
  FROM (SELECT *, role || chr(0) || text AS s FROM turns)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(written - 1 + 23) AS BIGINT) AS formatted_chars
FROM measured GROUP BY conv_id
"""

# Sources fill up in order of size by weight; the rest share what is left. A source's whole copies and the words before its cut are taken.
SQL["op8_source_mix"] = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '~') || ':' || coalesce(text, '')) AS k FROM documents
), sources AS (
  SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w, row_number() OVER (ORDER BY source NULLS LAST) AS n
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source)
), filled AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(2 * sum(source_size) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS here
  FROM sources WINDOW before AS (ORDER BY source_size / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (SELECT arg_min(here, 2 * source_size / w) AS level FROM filled WHERE 2 * source_size / w >= here),
targets AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce(level, 'inf'::DOUBLE) * w) AS target FROM filled, level),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM sized
), counted AS (
  SELECT p.doc_id, p.size, t.source_size, t.target, p.earlier, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(least(floor(target - whole * source_size) - earlier, size), 0) AS BIGINT) AS taken FROM counted
"""

# One row for each word and each line of a text; words in windows that stand twice or more are counted by their places.
SQL["op10_quality_rules"] = rf"""
WITH own AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
listed AS (SELECT n, {_WORDS} AS w FROM own),
windows AS (
  SELECT n, i, w[i : i + 2] AS three, count(*) OVER (PARTITION BY n, w[i : i + 2]) AS held
  FROM (SELECT n, w, unnest(generate_series(1, len(w) - 2)) AS i FROM listed WHERE len(w) > 2)
), repeats AS (
  SELECT n, count(DISTINCT place) AS n_repeat_words FROM (SELECT n, unnest([i, i + 1, i + 2]) AS place FROM windows WHERE held > 1) GROUP BY n
), line AS (SELECT n, unnest(string_split(text, chr(10))) AS line FROM own),
lines AS (SELECT n, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM line WHERE trim(line, {_SPACES}) <> '' GROUP BY n),
measured AS (
  SELECT own.doc_id, CAST(len(listed.w) AS BIGINT) AS n_words, CAST(length(translate(own.text, {_SPACES}, '')) AS BIGINT) AS word_chars,
    CAST(length(own.text) - length(translate(own.text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(coalesce(lines.n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(repeats.n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(lines.n_lines, 0) AS n_lines,
    CASE WHEN upper(own.text) = own.text THEN len(regexp_extract_all(own.text, '\p{{Lu}}')) ELSE 0 END AS n_capitals
  FROM own JOIN listed USING (n) LEFT JOIN repeats USING (n) LEFT JOIN lines USING (n)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 5 * n_symbols > n_words OR 2 * n_dup_lines > greatest(n_lines, 1)
    OR NOT (2 * n_words <= word_chars AND word_chars <= 20 * n_words) OR 2 * n_capitals > word_chars) AS kept
FROM measured
"""

# A place whose 400 bytes stand elsewhere takes them all with it; places at most 400 bytes apart make one run.
SQL["op5_suffix_array_dedup"] = """
WITH own AS (SELECT row_number() OVER () AS n, doc_id, encode(coalesce(text, '')) AS b FROM documents),
places AS MATERIALIZED (SELECT n, i, md5_number(array_slice(b, i, i + 399)) AS h FROM (SELECT n, b, unnest(generate_series(1, octet_length(b) - 399)) AS i FROM own)),
repeated AS (SELECT n, i FROM places WHERE h IN (SELECT h FROM places GROUP BY h HAVING count(*) > 1)),
marked AS (SELECT *, i - coalesce(lag(i) OVER (PARTITION BY n ORDER BY i), -400) > 400 AS fresh FROM repeated),
grouped AS (SELECT n, i, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY n ORDER BY i) AS run FROM marked),
runs AS (SELECT n, run, min(i) AS first, max(i) + 399 AS last FROM grouped GROUP BY n, run),
removed AS (SELECT n, sum(last - first + 1) AS n_removed, count(*) AS n_spans FROM runs GROUP BY n),
bounds AS (SELECT n, first, last FROM runs UNION ALL SELECT n, octet_length(b) + 1, NULL FROM own),
gaps AS (SELECT n, coalesce(lag(last) OVER (PARTITION BY n ORDER BY first), 0) + 1 AS first, first - 1 AS last FROM bounds),
kept AS (
  SELECT n, unhex(string_agg(CASE WHEN first <= last THEN hex(array_slice(b, first, last)) ELSE '' END, '' ORDER BY first)) AS kept FROM gaps JOIN own USING (n) GROUP BY n
)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(kept) AS kept_sha256
FROM own JOIN kept USING (n) LEFT JOIN removed USING (n)
"""


def _secrets_sql() -> str:
    """Matches and the texts between them come in the same order, so that running sums of lengths are the places. DuckDB folds letters beyond
    ASCII and knows no vertical tab as a space, and its repeats are bounded: patterns are written so that they mean what the rules mean."""
    cased = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
    names = "|".join([*map(cased, ("password", "passwd", "secret", "token")), f"{cased('api')}_?{cased('key')}"])
    rules = [("assign", rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]
    rules += [(r.kind, r.pattern.replace(r"\s", r"\s\x0B").replace("{0,400}", "*"), r.group, r.least) for r in secret_scan.MORE]
    found = []
    for rank, (kind, pattern, group, least) in enumerate(rules):
        p = "'" + pattern.replace("'", "''") + "'"
        found.append(f"""SELECT n, {rank} AS rank, '{kind}' AS kind, {least} AS least, unnest(generate_series(1, len(m))) AS i, unnest(m) AS m, unnest(c) AS c, unnest(g[1 : len(m)]) AS g
  FROM (SELECT n, regexp_extract_all(text, {p}) AS m, regexp_extract_all(text, {p}, {group}) AS c, string_split_regex(text, {p}) AS g FROM own WHERE regexp_matches(text, {p}))""")
    listed = lambda only: f"coalesce(string_agg(kind || ':' || (till - length(m)) || ':' || till, ',' ORDER BY till - length(m), rank){only}, '')"
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind, *_ in rules[:3])
    return f"""
WITH own AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents), found AS (
  {" UNION ALL ".join(found)}
), placed AS (SELECT *, CAST(sum(length(g) + length(m)) OVER (PARTITION BY n, rank ORDER BY i) AS BIGINT) AS till FROM found),
good AS (SELECT * FROM placed WHERE length(c) >= least)
SELECT doc_id, {counts}, sha256({listed(" FILTER (rank < 3)")}) AS base_sha256, {listed("")} AS spans FROM own LEFT JOIN good USING (n) GROUP BY own.n, doc_id
"""


SQL["op9_secret_scan"] = _secrets_sql()


def _clusters_sql(k: int = 16, rounds: int = 3) -> str:
    """Each round as two steps: the nearest centroid of every vector, the floors of the means."""
    steps = [f"""
WITH own AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY key NULLS LAST, v) - 1 AS c, v FROM (SELECT sha256('1:' || vec_id) AS key, v FROM own) QUALIFY row_number() OVER (ORDER BY key NULLS LAST, v) <= {k}
)"""]
    for i in range(rounds + 1):
        steps.append(f"""d{i} AS (
  SELECT own.n, c, CAST(list_sum(list_transform(range(1, 65), lambda i: (own.v[i] - c{i}.v[i]) * (own.v[i] - c{i}.v[i]))) AS BIGINT) AS d FROM own CROSS JOIN c{i}
), a{i} AS MATERIALIZED (SELECT n, c, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY n ORDER BY d, c) = 1)""")
        if i < rounds:
            steps.append(f"""m{i} AS (
  SELECT c, list(m ORDER BY i) AS v FROM (
    SELECT c, i, CAST(sum(x) - (sum(x) % count(*) + count(*)) % count(*) AS HUGEINT) // count(*) AS m FROM (SELECT a{i}.c, unnest(own.v) AS x, unnest(range(1, 65)) AS i FROM a{i} JOIN own USING (n)) GROUP BY c, i
  ) GROUP BY c
), c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (c))""")
    last = f"a{rounds}"
    return ", ".join(steps) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM {last} JOIN own USING (n) JOIN c{rounds} USING (c)
"""


SQL["op11_centroid_clustering"] = _clusters_sql()

# Counts of all phrases of one to three words within pieces; HUGEINT holds the products.
SQL["op13_phrase_collocations"] = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS s FROM documents
), listed AS (SELECT lang, regexp_extract_all(s, '[^\x20\x09]+') AS w FROM piece),
grams AS (
  SELECT lang, m AS words, array_to_string(w[i : i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM listed, (SELECT unnest([1, 2, 3]) AS m) WHERE len(w) >= m)
), counts AS MATERIALIZED (SELECT lang, words, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE words = 1 GROUP BY lang),
often AS (SELECT * FROM counts WHERE f >= 10),
cuts AS (
  SELECT lang, phrase, f AS a, k, array_to_string(w[: k], ' ') AS first, array_to_string(w[k + 1 :], ' ') AS rest
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(generate_series(1, words - 1)) AS k FROM often WHERE words > 1)
), scored AS (
  SELECT c.lang, c.phrase, a, l.f AS l, r.f AS r, CAST(a::HUGEINT * a * 1000000 // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM cuts c JOIN often l ON l.lang = c.lang AND l.phrase = c.first JOIN often r ON r.lang = c.lang AND r.phrase = c.rest
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1
), inner_ AS (
  SELECT lang, p AS phrase, max(f) AS longer FROM (
    SELECT lang, f, unnest([array_to_string(w[1 : 2], ' '), array_to_string(w[2 : 3], ' ')]) AS p FROM (SELECT lang, f, string_split(phrase, ' ') AS w FROM often WHERE words = 3)
  ) GROUP BY ALL
), left_ AS (SELECT s.* FROM scored s LEFT JOIN inner_ i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
