"""Queries over candidates from rings, over one global order and over what is written and read again, with the SQL that has to give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.functions import parse, row
from gradus.operators import builders, collate, compare, metrics, numbered, policy, relations, requests, rings, specs, splits, structured
from gradus.plans.annotated import SQL as ANNOTATED_SQL
from gradus.plans.annotated import order_tables
from gradus.plans.queries import SQL as QUERY_SQL
from gradus.plans.queries import LANG_QUESTION, LANGS, SQL_BUCKET, SQL_REGROUP, SQL_SPLIT, lang_samples
from gradus.sources import runs, scratch, tables
from gradus.sources.tables import table

BUDGET = 65536


def subjects(spark, sf_dir) -> DataFrame:
    """Documents as emails: the first words as subject, source and language as queue. Texts and subjects that stand once."""
    d = table(spark, sf_dir, "documents").where(F.trim("text") != "")
    d = d.withColumn("subject", F.array_join(F.slice(F.split("text", " "), 1, 4), " "))
    once = relations.standing_once(d, F.col("text"), F.col("subject"))
    b = row.bucket(F.concat(F.lit("split"), F.col("doc_id").cast("string")))
    split = splits.canonical(F.when(b < 10, "test").when(b < 20, "dev").otherwise("train"))
    gold = row.bucket(F.concat(F.lit("gold:"), F.col("subject")), 5) > 0
    told = once.select("doc_id", "subject", F.md5(F.col("text").cast("binary")).alias("body"), split.alias("split"), gold.alias("gold"), "lang", "source")
    return told.withColumns({"near": F.concat_ws("|", "split", "lang", "source"), "far": F.concat_ws("|", "split", "lang"), "want": F.when(F.col("gold"), 3).otherwise(4)})


def c_tiers(spark, sf_dir):
    """A subject's body among bodies of its queue, then of its language, in its split; one in five subjects comes without its body. Rows that both tiers leave
    short go. Bodies are told by hash."""
    own = scratch.written(subjects(spark, sf_dir), "subjects")
    tiers = [lambda short, key=key: rings.circled(short, own.select(key, "body"), "doc_id", key, "body", "body", 8) for key in ("near", "far")]
    filled = rings.tiered(own, "want", tiers, lambda e: e != F.col("body")).where(F.size("found") == F.col("want"))
    wrong = F.transform("found", lambda f: f["entry"])
    texts = row.shuffled(F.when(F.col("gold"), F.concat(F.array("body"), wrong)).otherwise(wrong), F.col("subject"))
    of = lambda tier: F.size(F.filter("found", lambda f: f["tier"] == tier)).cast("long")
    made = filled.withColumn("t", texts)
    return made.select("doc_id", "split", "gold", of(1).alias("n_near"), of(2).alias("n_far"), F.array_join("t", "|").alias("texts"), F.array_position("t", F.col("body")).cast("int").alias("place"))


def c_shapes(spark, sf_dir):
    """A part's name among names of parts of its type that are not of its brand, then of any type: brands as pages, types as header shapes."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand", F.lit(5).alias("want"), F.lit("all").alias("every"))
    tiers = [lambda short, key=key: rings.ringed(short, p, "p_partkey", key, "p_brand", "p_name", 10) for key in ("p_type", "every")]
    filled = rings.tiered(p, "want", tiers, lambda e: e != F.col("p_name"))
    of = lambda tier: F.array_join(F.transform(F.filter("found", lambda f: f["tier"] == tier), lambda f: f["entry"]), "|")
    return filled.select("p_partkey", of(1).alias("near"), of(2).alias("far"))


def p_sampled(spark, sf_dir):
    """50 rows of each split as a seeded generator draws them."""
    own = lang_samples(spark, sf_dir).withColumn("split", splits.canonical(F.col("split")))
    return numbered.sampled(own, 50).select(F.col("pos").alias("doc_id"), "split")


def p_prepared(spark, sf_dir):
    """Documents in the splits that they end in, then at most 50 of each."""
    own = lang_samples(spark, sf_dir)
    placed = splits.regroup(own).withColumn("split", F.col("target")).select(*own.columns)
    return splits.cap(placed, 50).select(F.col("pos").alias("doc_id"), "split")


def u_records(spark, sf_dir):
    """Parts as records, whose group is that of their brand and type."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    return builders.recorded(p, parse.content_group(F.col("p_brand"), F.col("p_type"))).select("payload.p_partkey", F.to_json("payload").alias("payload"), "group")


def sizes(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("size"))


def l_batches(spark, sf_dir):
    """Batches over one order by length."""
    return numbered.batches(sizes(spark, sf_dir), "size", BUDGET, F.asc_nulls_first("size"), "doc_id")


def l_passes(spark, sf_dir):
    """Batches over one seeded order of all rows."""
    order = row.sha1(F.concat(F.lit("pass:0:1:"), F.col("doc_id").cast("string")))
    return numbered.batches(sizes(spark, sf_dir), "size", BUDGET, order, "doc_id")


def s_built(spark, sf_dir):
    """Documents built as datasets by source; two of them are built anew from every third document, a third with a split less."""
    path = scratch.folder(spark, "built")
    own = lang_samples(spark, sf_dir).withColumn("split", splits.canonical(F.col("split")))
    own = own.drop("dataset").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.col("source").alias("dataset")), "pos")
    tables.save(own, path)
    tables.save(own.where("dataset in ('src0', 'src1') and pos % 3 = 0 or dataset = 'src2' and split <> 'test'"), path)
    read = tables.load_all(spark, path).groupBy(F.col("dataset").alias("d"), F.col("split").alias("s")).agg(F.count("*").alias("rows"), F.sum("pos").alias("ids"))
    joined = tables.manifest(spark, path).join(read, (F.col("dataset") == F.col("d")) & (F.col("split") == F.col("s")), "left")
    return joined.select("dataset", "split", "version", "n", F.coalesce("rows", F.lit(0)).alias("rows"), "ids")


def s_members(spark, sf_dir):
    """Turns written as zip archives, a file of JSON lines for each conversation, and read again."""
    path = scratch.folder(spark, "zip")
    turns = table(spark, sf_dir, "conversations").withColumn("archive", F.pmod("conv_id", F.lit(3)))
    lines = turns.groupBy("archive", "conv_id").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.to_json(x))).alias("body"))
    tables.zipped(lines, path, "archive", F.concat(F.lit("turns/"), F.col("conv_id").cast("string"), F.lit(".jsonl")), "body")
    read = tables.json_members(spark, f"{path}/*.zip", "turn bigint, role string, text string")
    return read.select(F.regexp_extract("member", r"(\d+)\.jsonl$", 1).cast("bigint").alias("conv_id"), "turn", "role", F.sha1(F.col("text").cast("binary")).alias("content"))


def s_json_lines(spark, sf_dir):
    """Turns written as JSON lines and read again by path."""
    path = scratch.folder(spark, "lines")
    table(spark, sf_dir, "conversations").write.json(path)
    return tables.json_lines(spark, path, "conv_id bigint, turn bigint, role string, text string").select("conv_id", "turn", F.length("text").cast("bigint").alias("n"))


def r_files(spark, sf_dir):
    """Three runs whose predictions are written as JSON lines, read, scored, written as metric files and ranked from these."""
    folder, d = scratch.folder(spark, "runs"), table(spark, sf_dir, "documents")
    runs_ = F.explode(F.array(*map(F.lit, "abc")))
    told = d.select(runs_.alias("run"), "doc_id", F.col("source").alias("dataset")).where("not (run = 'c' and dataset = 'src3')")
    p = F.when(row.bucket(F.concat("run", F.col("doc_id").cast("string"))) < 70, 0.75).otherwise(0.25)
    lines = told.select("run", F.lit("final").alias("stage"), F.lit("test").alias("part"), "dataset", F.array(F.lit("yes"), F.lit("no")).alias("options"), F.array(p, 1 - p).alias("probs"), F.array(F.lit(1.0), F.lit(0.0)).alias("label"))
    runs.save_predictions(lines, folder)
    scored = metrics.by_dataset(runs.predictions(spark, folder).where("part = 'test'"), ("run", "stage", "dataset"))
    runs.save_metrics(scored, folder, "test", ("n", "accuracy", "nll", "ece"))
    found = compare.entries(spark, folder).select("entry", "dataset", F.col("metrics")["accuracy"].cast("double").alias("accuracy"))
    board = compare.leaderboard(found.withColumn("benchmark", F.col("dataset").isin("src0", "src1", "src2", "src3")))
    return board.withColumns({c: F.round(c, 6) for c in ("macro", "mean_rank", "median")})


MARKS = collate.Marks(state=1, question=2, open=3, close=4, decide=5, cut=(6, 7), pad=9)


def sequences(spark, sf_dir) -> DataFrame:
    """Documents as tokens, a word's length and 10; two, three or four options; one in seven has a question that leaves no room."""
    d = table(spark, sf_dir, "documents")
    of = lambda text: F.transform(F.split(text, " "), lambda w: F.length(w) + 10)
    question = F.when(F.col("doc_id") % 7 == 0, F.array_repeat(F.lit(8), 120)).otherwise(of(F.lit(LANG_QUESTION)))
    options = F.slice(F.transform(F.array(*map(F.lit, LANGS)), of), F.lit(1), (2 + F.col("doc_id") % 3).cast("int"))
    label = F.transform(options, lambda o, i: F.when(i == F.col("doc_id") % 2, 1.0).otherwise(0.0))
    return d.select("doc_id", of(F.col("text")).alias("state"), question.alias("question"), options.alias("options"), label.alias("label"), F.floor(F.col("doc_id") / 8).alias("batch"))


def l_collated(spark, sf_dir):
    """Padded batches of sequences of at most 128 tokens."""
    made = collate.collated(collate.assembled(sequences(spark, sf_dir), 128, MARKS), "batch", "doc_id", MARKS.pad)
    flat = lambda c: F.array_join(F.transform(c, lambda x: F.array_join(x.cast("array<string>"), " ")), ",")
    return made.select("batch", flat("ids").alias("ids"), flat("there").alias("there"), flat("closes").alias("closes"), flat(F.transform("open", lambda x: x.cast("array<int>"))).alias("open"), flat(F.transform("label", lambda x: x.cast("array<int>"))).alias("label"))


def l_separate(spark, sf_dir):
    """The rows of padded batches again."""
    made = collate.collated(collate.assembled(sequences(spark, sf_dir), 128, MARKS), "batch", "doc_id", MARKS.pad)
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), " ")
    return collate.separate(made, "batch").select(F.col("row").alias("doc_id"), joined("ids").alias("ids"), joined("closes").alias("closes"), F.size("label").cast("long").alias("n_options"))


def l_skipped(spark, sf_dir):
    """How many sequences of each batch do not fit."""
    return collate.skipped(collate.assembled(sequences(spark, sf_dir), 128, MARKS), "batch")


def q_requests(spark, sf_dir):
    """Documents as the states of requests, of which three in four are wrong in one of six ways."""
    d = table(spark, sf_dir, "documents")
    text = F.regexp_extract(F.to_json(F.struct(F.col("text").alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)
    yes_no, choice = '{"a": {"type": "noul", "instructions": "Polite?"}}', '{"b": {"type": "choice", "instructions": "Which?", "criteria": {"de": "German", "en": null}}}'
    one, odd = '{"b": {"type": "choice", "instructions": "Which?", "criteria": {"de": "German"}}}', '{"c": {"type": "score", "instructions": "How?"}}'
    body = lambda state, asked, more="": F.concat(F.lit('{"state": '), state, F.lit(f', "questions": {asked}{more}}}'))
    other = F.to_json(F.struct(F.col("doc_id").alias("id"), "lang"), {"pretty": "true"})
    kinds = [body(text, yes_no), body(other, choice), body(text, "{}"), body(text, one), body(text, yes_no, ', "model": "x"'), body(text, odd), F.lit(f'{{"questions": {yes_no}}}'), F.concat(F.lit('{"state": '), text)]
    told = requests.checked(d.select("doc_id", F.element_at(F.array(*kinds), (F.col("doc_id") % 8 + 1).cast("int")).alias("body")))
    rows = requests.asked_rows(told, "doc_id").select(F.col("doc_id").alias("r_id"), "name", F.sha1(F.col("state").cast("binary")).alias("state"), F.array_join("texts", "|").alias("texts"))
    return told.select("doc_id", "error").join(rows, F.col("doc_id") == F.col("r_id"), "left").drop("r_id")


def x_policy(spark, sf_dir):
    """Losses of made-up logits of languages, disturbed four times."""
    z = F.array(*[row.bucket(F.concat(F.col("doc_id").cast("string"), F.lit(f":{x}")), 101) / 50.0 for x in LANGS])
    label = F.array(*[F.when(F.col("lang") == x, 1.0).otherwise(0.0) for x in LANGS])
    made = policy.policy(table(spark, sf_dir, "documents").select("doc_id", z.alias("logits"), label.alias("label")), F.concat(F.lit("7:"), F.col("doc_id").cast("string")), 4, 0.5, 0.25, 0.1)
    return made.select("doc_id", F.round(F.get("rewards", F.lit(0)), 6).alias("reward"), F.round(F.get("advantages", F.lit(3)), 4).alias("advantage"), F.round("loss", 4).alias("loss"))


@specs.step("order cells")
def order_cells(orders: DataFrame) -> DataFrame:
    return structured.table_cells(orders, "l_orderkey", F.col("table")).withColumn("others", F.array_distinct(F.filter("others", lambda x: F.lower(F.trim(x)) != F.lower(F.trim("answer")))))


#: A dataset for each way in which sources become samples.
SPECS = specs.from_settings({
    "constant": {"source": "documents", "kind": "constant", "state": "text", "answer": "lang", "options": {"de": "German", "en": "English", "es": "Spanish", "fr": "French"}, "pos": "doc_id", "questions": ["Which language?", "Which of these languages is it?"]},
    "classes": {"source": "orders", "kind": "classes", "state": "concat('Order of ', cast(o_totalprice as bigint))", "answer": "o_orderpriority", "pos": "o_orderkey", "questions": ["How urgent is it?"]},
    "own": {"source": "part", "kind": "own", "state": "p_name", "texts": "array(p_brand, p_type, p_name)", "place": "p_partkey % 5", "pos": "p_partkey", "questions": ["Which?"]},
    "yes_no": {"source": "documents", "joined": [("labels", ["doc_id"])], "kind": "yes_no", "state": "text", "answer": "toxic = 1", "options": {"yes": "да", "no": "нет"}, "pos": "doc_id", "questions": ["Is a text of {source} toxic?"]},
    "where": {"source": "events", "where": "event_type in ('click', 'view') and value > 10", "kind": "constant", "state": "concat(user_id, ': ', props)", "answer": "event_type", "options": {"click": "a click", "view": "a view"}, "pos": "event_id"},
    "each": {"source": "conversations", "kind": "negatives", "state": "text", "answer": "array(role)", "options": {"user": "a user", "assistant": "an assistant", "system": "a system"}, "negatives": 1, "pos": "conv_id * 1000 + turn", "group": "conv_id", "questions": ["Is it said by {candidate}?"]},
    "votes": {"source": "events", "kind": "votes", "state": "concat('user ', user_id)", "answer": "event_type", "options": {"click": "click", "purchase": "purchase", "view": "view"}, "pos": "event_id"},
    "siblings": {"source": "conversations", "where": "role = 'assistant'", "kind": "siblings", "state": "concat(conv_id, ':', turn)", "answer": "text", "key": ["conv_id"], "pos": "conv_id * 1000 + turn", "none": "None of these"},
    "pool": {"source": "part", "kind": "pool", "state": "concat(p_partkey, ' of ', p_brand)", "answer": "p_name", "key": ["p_brand"], "most": 5, "pos": "p_partkey", "split": "case when p_partkey % 10 = 0 then 'test' when p_partkey % 10 = 1 then 'dev' else 'train' end"},
    "cells": {"source": "order_tables", "prepared": "order cells", "where": "size(others) > 0", "kind": "own", "state": "concat(l_orderkey, ', ', row)", "texts": "concat(array(answer), others)", "place": "1", "pos": "l_orderkey", "group": "l_orderkey", "questions": ["Which {header} has {name}?"]},
    "several": {"source": ["customer", "supplier"], "kind": "yes_no", "state": "coalesce(c_name, s_name)", "answer": "s_suppkey is null", "pos": "coalesce(c_custkey, s_suppkey)", "questions": ["Is it a customer?"]},
})


def c_specs(spark, sf_dir):
    """Eleven datasets in one plan: rows, options, and the sum of the places of the right ones (not for those in seeded order)."""
    names = ("documents", "orders", "part", "labels", "events", "conversations", "customer", "supplier")
    own = {n: table(spark, sf_dir, n) for n in names} | {"order_tables": order_tables(spark, sf_dir)}
    right = F.array_position("label", F.array_max("label"))
    return specs.compiled(SPECS, own).groupBy("dataset").agg(F.count("*").alias("n"), F.sum(F.size("options")).alias("n_options"), F.sum(F.when(~F.col("dataset").isin("siblings", "pool"), right)).alias("places"), F.min("type").alias("type"))


QUERIES = {f.__name__: f for f in (c_specs, c_tiers, c_shapes, p_sampled, p_prepared, u_records, l_batches, l_passes, s_built, s_members, s_json_lines, r_files, l_collated, l_separate, l_skipped, q_requests, x_policy)}

_NUMBER = "cast('0x' || substr(sha1({0}), 1, 15) as bigint)".format


def _circles_sql(name: str, rows: str, key: str, reach: int) -> str:
    """name (doc_id, e, i): what follows each row's place in its circle of the bodies of its key."""
    return f"""p_{name} as (select distinct {key} k, body e from own), s_{name} as (select k, cast(ceil(count(*) / 1000) as bigint) sh from p_{name} group by 1),
q_{name} as (select k, e, {_NUMBER('e')} % sh share, row_number() over (partition by k, {_NUMBER('e')} % sh order by sha1(e), e) - 1 a, count(*) over (partition by k, {_NUMBER('e')} % sh) n from p_{name} join s_{name} using (k)),
{name} as (select doc_id, e, (a - {_NUMBER("doc_id || ':at'")} % n - 1 + n) % n i from {rows} r join s_{name} s on s.k = r.{key} join q_{name} q on q.k = r.{key} and q.share = {_NUMBER("cast(doc_id as varchar)")} % sh
where (a - {_NUMBER("doc_id || ':at'")} % n - 1 + n) % n < {reach})"""


def _rings_sql(name: str, rows: str, key: str, reach: int) -> str:
    """name (p_partkey, e, i): names at equal distances on the key's ring, which begins where the row's brand ends."""
    return f"""r_{name} as (select k, g, e, row_number() over (partition by k order by md5(g), g, md5(e), e) - 1 a, count(*) over (partition by k) n from (select distinct {key} k, p_brand g, p_name e from own)),
g_{name} as (select k, g, min(a) lo, count(*) c, any_value(n) n from r_{name} group by 1, 2),
a_{name} as (select p_partkey, k, n, lo + c as till, n - c as m, greatest((n - c) // {reach}, 1) step, {_NUMBER("p_partkey || ':at'")} u from {rows} r join g_{name} on k = r.{key} and g = r.p_brand where n > c),
{name} as (select p_partkey, e, i from (select *, unnest(range(least({reach}, m))) i from a_{name}) w join r_{name} x on x.k = w.k and x.a = (till + (u + i * step) % m) % w.n)"""


def _batches_sql(order: str) -> str:
    return f"""with recursive o as (select doc_id, length(text) size, row_number() over (order by {order}, doc_id) k from documents),
r as (select doc_id, size, k, 0::bigint batch, 1 n, size longest from o where k = 1 union all
select o.doc_id, o.size, o.k, r.batch + f.fresh::int, case when f.fresh then 1 else r.n + 1 end, case when f.fresh then o.size else greatest(r.longest, o.size) end
from r join o on o.k = r.k + 1, lateral (select greatest(r.longest, o.size) * (r.n + 1) > {BUDGET} fresh) f) select doc_id, cast(size as int) size, batch from r"""


_LENGTHS = "list_transform(string_split({0}, ' '), lambda w: length(w) + 10)".format
_SEQUENCES = f"""with s as (select doc_id, doc_id // 8 batch, {_LENGTHS('text')} s, case when doc_id % 7 = 0 then list_transform(range(120), lambda i: 8) else {_LENGTHS(f"'{LANG_QUESTION}'")} end q, 2 + doc_id % 3 k from documents),
r as (select *, 128 - 3 - len(q) - 3 * k room from s), f as (select *, case when len(s) <= room then s else s[1 : (room - 2) // 2] || [6, 7] || s[len(s) - (room - 2 - (room - 2) // 2) + 1 :] end c from r where room >= least(len(s), 18)),
a as (select doc_id, batch, k, [1] || c || [2] || q || flatten(list_transform(range(k), lambda i: [3, 12, 4])) || [5] ids, list_transform(range(k), lambda i: len(c) + len(q) + 4 + 3 * i) closes from f)"""
_JOINED = "array_to_string({0}, ' ')".format
_NOISE = "sqrt(-2 * ln((cast('0x' || substr(h, 1, 13) as bigint)::double + 0.5) / 4503599627370496)) * cos(2 * pi() * ((cast('0x' || substr(h, 14, 13) as bigint)::double + 0.5) / 4503599627370496)) * 0.5"
_BUILT = f"""select source dataset, {SQL_SPLIT} split, doc_id from documents"""

SQL = {
    "c_specs": f"""with cells as ({ANNOTATED_SQL['c_cells']}),
t as (select 1 + len(list_distinct(list_filter(string_split(others, '|'), lambda x: lower(trim(x)) <> lower(trim(answer))))) k from cells),
s as (select conv_id, turn, lower(trim(text)) x from conversations where role = 'assistant' and trim(text) <> ''),
h as (select a.conv_id, a.turn, count(distinct b.x) m from s a join s b on a.conv_id = b.conv_id and a.x <> b.x group by 1, 2),
q as (select a.p_partkey, least(5, count(distinct lower(trim(b.p_name)))) m from part a join part b on a.p_brand = b.p_brand and b.p_partkey % 10 > 1 and lower(trim(a.p_name)) <> lower(trim(b.p_name)) group by 1),
u as (select user_id, count(*) filter (event_type = 'click') c, count(*) filter (event_type = 'purchase') p, count(*) filter (event_type = 'view') v from events where event_type in ('click', 'purchase', 'view') group by 1),
r as (select 'constant' dataset, 4 k, list_position(['de', 'en', 'es', 'fr'], lang) p, 'choice' as type from documents
union all select 'classes', (select count(distinct o_orderpriority) from orders), (select count(distinct o_orderpriority) from orders b where b.o_orderpriority <= a.o_orderpriority), 'choice' from orders a
union all select 'own', 3, p_partkey % 5, 'choice' from part where p_partkey % 5 between 1 and 3
union all select 'yes_no', 2, 2 - toxic, 'noul' from documents join labels using (doc_id)
union all select 'where', 2, case event_type when 'click' then 1 else 2 end, 'choice' from events where event_type in ('click', 'view') and value > 10
union all select 'each', 2, unnest([1, 2]), 'noul' from conversations
union all select 'votes', 3, case when c >= p and c >= v then 1 when p >= v then 2 else 3 end, 'choice' from u
union all select 'siblings', 2 + least(m, 20), null, 'choice' from h union all select 'pool', 1 + m, null, 'choice' from q
union all select 'several', 2, 1, 'noul' from customer union all select 'several', 2, 2, 'noul' from supplier
union all select 'cells', k, 1, 'choice' from t where k > 1)
select dataset, count(*) n, cast(sum(k) as bigint) n_options, cast(sum(p) as bigint) places, min(type) as type from r group by 1""",
    "s_built": f"""with d as ({_BUILT}), v as (select *, case when dataset in ('src0', 'src1', 'src2') then 2 else 1 end as version from d),
k as (select * from v where version = 1 or dataset = 'src2' and split <> 'test' or dataset in ('src0', 'src1') and doc_id % 3 = 0),
e as (select distinct dataset, version from v), s as (select unnest(['train', 'validation', 'test']) split), c as (select dataset, split, count(*) n, cast(sum(doc_id) as bigint) ids from k group by 1, 2)
select dataset, split, cast(version as bigint) as version, coalesce(n, 0) n, coalesce(n, 0) as rows, ids from e cross join s left join c using (dataset, split)""",
    "l_collated": _SEQUENCES + f""", w as (select batch, max(len(ids)) w, max(k) m from a group by 1),
p as (select a.*, ids || list_transform(range(w - len(ids)), lambda i: 9) pi, list_transform(range(w), lambda i: (i < len(ids))::int) pt, closes || list_transform(range(m - k), lambda i: 0) pc, list_transform(range(m), lambda i: (i < k)::int) po,
list_transform(range(m), lambda i: (i = doc_id % 2)::int) pl from a join w using (batch)) select batch, string_agg({_JOINED('pi')}, ',' order by doc_id) ids, string_agg({_JOINED('pt')}, ',' order by doc_id) there,
string_agg({_JOINED('pc')}, ',' order by doc_id) closes, string_agg({_JOINED('po')}, ',' order by doc_id) as open, string_agg({_JOINED('pl')}, ',' order by doc_id) as label from p group by 1""",
    "l_separate": _SEQUENCES + f" select doc_id, {_JOINED('ids')} ids, {_JOINED('closes')} closes, k n_options from a",
    "p_prepared": f"""with r as ({SQL_REGROUP}), n as (select doc_id, target split, row_number() over (partition by target order by sha1(text || chr(31) || '{LANG_QUESTION}' || chr(31) || doc_id), doc_id) n from r join documents using (doc_id))
select doc_id, split from n where n <= 50""",
    "u_records": """select p_partkey, '{"p_partkey":' || p_partkey || ',"p_brand":"' || p_brand || '","p_type":"' || p_type || '"}' payload, sha256('{"c0":"' || p_brand || '","c1":"' || p_type || '"}') as "group" from part""",
    "l_skipped": _SEQUENCES + " select batch, count(*) n, count(*) filter (room < least(len(s), 18)) skipped from r group by 1",
    "q_requests": """select doc_id, [null, null, 'no questions', 'a choice needs at least 2 criteria: b', 'unknown field', 'unknown type: c', 'no state', 'not JSON'][doc_id % 8 + 1] error, case doc_id % 8 when 0 then 'a' when 1 then 'b' end as name,
case doc_id % 8 when 0 then sha1(text) when 1 then sha1('{"id":' || doc_id || ',"lang":"' || lang || '"}') end state, case doc_id % 8 when 0 then 'yes|no' when 1 then 'de: German|en' end texts from documents""",
    "x_policy": f"""with z as (select doc_id, list_position(['de', 'en', 'es', 'fr'], lang) gold, o, g, {SQL_BUCKET.format("doc_id || ':' || ['de', 'en', 'es', 'fr'][o]", 101)} / 50.0::double z, sha1('7:' || doc_id || ':' || g || ':' || o) h
from documents, (select unnest(range(1, 5)) o), (select unnest(range(1, 5)) g)), n as (select *, {_NOISE} e from z), c as (select *, e - avg(e) over (partition by doc_id, g) d from n),
q as (select *, exp(z + d - max_) / sum(exp(z + d - max_)) over v q from (select *, max(z + d) over (partition by doc_id, g) max_ from c) window v as (partition by doc_id, g)),
r as (select doc_id, g, max(ln(greatest(q, 0.0001))) filter (o = gold) + 0.25 * max(q) filter (o = gold) / greatest(sqrt(sum(q * q)), 1e-12) reward, -sum(d * d) / 0.5 p from q group by 1, 2),
a as (select *, (reward - avg(reward) over v) / (stddev_samp(reward) over v + 0.000001) adv from r window v as (partition by doc_id)),
t as (select doc_id, -ln(max(w) filter (o = gold) / sum(w)) ce from (select doc_id, o, gold, exp(z - max(z) over (partition by doc_id)) w from z where g = 1) group by 1)
select doc_id, round(max(reward) filter (g = 1), 6) reward, round(max(adv) filter (g = 4), 4) advantage, round(-avg(adv * p) + 0.1 * max(ce), 4) loss from a join t using (doc_id) group by 1""",
    "s_members": "select conv_id, turn, role, sha1(text) as content from conversations",
    "s_json_lines": "select conv_id, turn, cast(length(text) as bigint) n from conversations",
    "r_files": f"select benchmark, entry || ' / final' entry, macro, mean_rank, wins, median from ({QUERY_SQL['r_leaderboard']})",
    "c_tiers": f"""with once as (select *, array_to_string(string_split(text, ' ')[1:4], ' ') subject from (select *, count(*) over (partition by text) n from documents where trim(text) <> '') where n = 1),
own as (select doc_id, subject, md5(text) body, {SQL_SPLIT} split, {SQL_BUCKET.format("'gold:' || subject", 5)} > 0 gold, concat_ws('|', {SQL_SPLIT}, lang, source) near, concat_ws('|', {SQL_SPLIT}, lang) far
from (select *, count(*) over (partition by subject) m from once) where m = 1), {_circles_sql('near_', 'own', 'near', 8)},
one as (select doc_id, e, i from near_ join own using (doc_id) where e <> body qualify row_number() over (partition by doc_id order by i) <= case when gold then 3 else 4 end),
short as (select own.*, case when gold then 3 else 4 end - coalesce(had, 0) left_ from own left join (select doc_id, count(*) had from one group by 1) using (doc_id) where coalesce(had, 0) < case when gold then 3 else 4 end),
{_circles_sql('far_', 'short', 'far', 8)},
two as (select doc_id, e, i, left_ from far_ join short using (doc_id) where e <> body and not exists (select 1 from one where one.doc_id = far_.doc_id and one.e = far_.e) qualify row_number() over (partition by doc_id order by i) <= left_),
found as (select doc_id, e, 1 tier, i from one union all select doc_id, e, 2, i from two), listed as (select doc_id, list(e order by tier, i) es, count(*) filter (tier = 1) n_near, count(*) filter (tier = 2) n_far from found group by 1),
full_ as (select own.*, n_near, n_far, case when gold then [body] || es else es end es from own join listed using (doc_id) where n_near + n_far = case when gold then 3 else 4 end),
flat as (select *, unnest(es) e, unnest(range(len(es))) i from full_), mixed as (select doc_id, list(e order by sha1(subject || ':' || i), i) t from flat group by 1)
select doc_id, split, gold, n_near, n_far, array_to_string(t, '|') texts, coalesce(list_position(t, body), 0)::int place from full_ join mixed using (doc_id)""",
    "c_shapes": f"""with own as (select p_partkey, p_name, p_type, p_brand, 'all' every from part), {_rings_sql('near_', 'own', 'p_type', 10)},
one as (select p_partkey, e, min(i) i from near_ join own using (p_partkey) where e <> p_name group by 1, 2 qualify row_number() over (partition by p_partkey order by min(i)) <= 5),
short as (select own.*, coalesce(had, 0) had from own left join (select p_partkey, count(*) had from one group by 1) using (p_partkey) where coalesce(had, 0) < 5), {_rings_sql('far_', 'short', 'every', 10)},
two as (select f.p_partkey, e, min(i) i from far_ f join short using (p_partkey) where e <> p_name and not exists (select 1 from one where one.p_partkey = f.p_partkey and one.e = f.e) group by 1, 2, had qualify row_number() over (partition by f.p_partkey order by min(i)) <= 5 - had)
select p_partkey, coalesce((select string_agg(e, '|' order by i) from one where one.p_partkey = own.p_partkey), '') near, coalesce((select string_agg(e, '|' order by i) from two where two.p_partkey = own.p_partkey), '') far from own""",
    "l_batches": _batches_sql("length(text) nulls first"),
    "l_passes": _batches_sql("sha1('pass:0:1:' || doc_id)"),
}
