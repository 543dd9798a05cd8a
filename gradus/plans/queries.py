"""Queries over the tables here, and the SQL that has to give the same rows. Arrays come back as strings, doubles rounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradus.functions import row
from gradus.operators import builders, compare, load, metrics, relations, rings, splits
from gradus.sources.tables import table

LANGS = ("de", "en", "es", "fr")
LANG_QUESTION = "Which language is the text in?"


def _texts(options: Column) -> Column:
    return F.array_join(F.transform(options, lambda o: o["text"]), "|")


def _label(label: Column) -> Column:
    return F.array_join(F.transform(label, lambda x: F.format_number(x.cast("double"), 4)), "|")


def lang_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a choice among languages; their split is by the hash of the id, so that copies stand in several splits."""
    b = row.bucket(F.concat(F.lit("split"), F.col("doc_id").cast("string")))
    named = F.when(b < 10, "test").when(b < 20, "dev").otherwise("train")
    docs = table(spark, sf_dir, "documents")
    return builders.sample(docs, "doc_lang", F.col("text"), F.lit(LANG_QUESTION), row.options_of(list(LANGS)), F.col("lang"), F.col("doc_id"), split=named)


SQL_BUCKET = "cast(cast('0x' || substr(sha1({0}), 1, 16) as ubigint) % {1} as int)"
SQL_SPLIT = f"case when {SQL_BUCKET.format("'split' || doc_id", 100)} < 10 then 'test' when {SQL_BUCKET.format("'split' || doc_id", 100)} < 20 then 'validation' else 'train' end"
SQL_REGROUP = f"""
with p as (select doc_id, text, lang, {SQL_SPLIT} split, case {SQL_SPLIT} when 'test' then 0 when 'validation' then 1 else 2 end prio from documents),
h as (select *, min(prio) over (partition by case when text = '' then '{LANG_QUESTION}' else text end) home,
  row_number() over (partition by text, lang order by prio, doc_id) copy from p)
select doc_id, split, case home when 0 then 'test' when 1 then 'validation' else 'train' end target from h where copy = 1"""


def p_regroup(spark, sf_dir):
    return splits.regroup(lang_samples(spark, sf_dir)).select(F.col("pos").alias("doc_id"), "split", "target")


def p_counts(spark, sf_dir):
    return splits.counts(lang_samples(spark, sf_dir)).select("from_split", "to_split", "n")


def p_carve(spark, sf_dir):
    """All rows in train: test and validation are carved."""
    return splits.regroup(lang_samples(spark, sf_dir).withColumn("split", F.lit("train"))).select(F.col("pos").alias("doc_id"), "target")


def p_resplit(spark, sf_dir):
    """All rows in test: everything is split anew, by groups of sources."""
    only = lang_samples(spark, sf_dir).withColumn("split", F.lit("test"))
    return splits.regroup(only).select(F.col("pos").alias("doc_id"), "target")


def p_cap(spark, sf_dir):
    return splits.cap(lang_samples(spark, sf_dir).withColumn("split", splits.canonical(F.col("split"))), 50).select(F.col("pos").alias("doc_id"), "split")


def p_priority(spark, sf_dir):
    own = lang_samples(spark, sf_dir).withColumn("split", splits.canonical(F.col("split")))
    return splits.without_shared(own, "state").select(F.col("pos").alias("doc_id"), "split")


def u_slugify(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", row.slugify(F.concat("p_type", F.lit(" / "), "p_brand")).alias("slug"))


def u_bucket(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", row.bucket(F.col("text")).alias("bucket"))


def u_pick(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", row.pick(["What is it?", "Which one?", "Name it."], F.col("text")).alias("question"))


def u_shuffle(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(row.shuffled(F.array("p_brand", "p_type", "p_name"), F.col("p_partkey").cast("string")), "|").alias("shuffled"))


def u_context(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    about = F.when(F.col("turn") == 0, "").otherwise("A conversation.")
    return c.select("conv_id", "turn", row.with_context(about, F.col("text"), "Turn", {"yes": "it is", "no": "it is not"}).alias("state"))


def u_marks(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", row.escaped_marks(F.concat(F.lit("<|state|>"), "url")).alias("escaped"), row.split_camel(F.concat(F.lit("pageUrl"), F.col("page_id").cast("string"))).alias("camel"),
                    row.without_parenthesis(F.concat("url", F.lit(" (page)"))).alias("bare"), row.single_spaced(F.concat(F.lit("  a \n"), "url")).alias("spaced"))


def u_numbers(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.col("event_id").cast("string"), F.lit(") yes"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("The answer is "), F.col("user_id").cast("string"))).otherwise("none")
    return e.select("event_id", row.answer_number(said).alias("number"))


def u_middle(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(row.middle_cut(F.split("text", " "), F.lit(9)), " ").alias("cut"))


def u_mentions(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", row.mentions(F.col("text"), F.lit("the")).cast("long").alias("n_the"))


def u_spans(spark, sf_dir):
    """Tags of two kinds by the first letter of a word, a span opening at every third; the same where a broken chain leaves no span."""
    c = table(spark, sf_dir, "conversations")
    tokens = F.split("text", " ")
    kind = lambda t: F.when(t.rlike("^[a-f]"), "x").otherwise("y")
    tag = F.transform(tokens, lambda t, i: F.when(~t.rlike("^[a-m]"), F.lit("O")).otherwise(F.concat(F.when(i % 3 == 0, "B-").otherwise("I-"), kind(t))))
    written = lambda whole: F.array_join(F.transform(row.spans_of_tags(F.col("tokens"), F.col("tags"), whole), lambda s: F.concat(s["kind"], F.lit("="), s["text"])), "|")
    return c.select("conv_id", "turn", tokens.alias("tokens"), tag.alias("tags")).select("conv_id", "turn", written(False).alias("spans"), written(True).alias("whole_spans"))


def u_visible(spark, sf_dir):
    """Whether a turn says a word; every third word is spelled in another way."""
    c = table(spark, sf_dir, "conversations")
    word = F.when(F.col("turn") % 3 == 0, "THE").when(F.col("turn") % 3 == 1, "centre").otherwise("a")
    return c.select("conv_id", "turn", row.visible(word, F.concat(F.col("text"), F.when(F.col("conv_id") % 2 == 0, " Center.").otherwise(" centers"))).alias("visible"))


def u_generator(spark, sf_dir):
    """Orders of a seeded generator."""
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(row.generator_shuffled(F.array("p_brand", "p_type", "p_name"), F.col("p_partkey").cast("string")), "|").alias("shuffled"))


def c_shares(spark, sf_dir):
    """Soft labels of two options."""
    d = table(spark, sf_dir, "documents")
    share = (F.col("doc_id") % 5) / 4.0
    return d.select("doc_id", _label(row.distribution(row.options_of(["yes", "no"]), F.array(share, 1 - share))).alias("label"))


def p_tenths(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", splits.split_by(F.col("text"), {"test": 1, "validation": 1}).alias("split"))


def c_lang(spark, sf_dir):
    return lang_samples(spark, sf_dir).select(F.col("pos").alias("doc_id"), _texts(F.col("options")).alias("options"), _label(F.col("label")).alias("label"), "type")


def c_priority(spark, sf_dir):
    """Options from the distinct values of a column, as slugs."""
    o = table(spark, sf_dir, "orders")
    names = builders.class_names(o, "o_orderpriority")
    options = F.transform(F.array(*[F.lit(n) for n in names]), lambda n: F.struct(row.slugify(n).alias("id"), n.alias("text")))
    made = builders.sample(o, "priority", F.concat(F.lit("Order of "), F.col("o_totalprice").cast("bigint").cast("string")), F.lit("How urgent is it?"), options, row.slugify(F.col("o_orderpriority")), F.col("o_orderkey"))
    return made.select(F.col("pos").alias("o_orderkey"), F.array_join(F.transform("options", lambda o: o["id"]), "|").alias("ids"), _label(F.col("label")).alias("label"))


def c_toxic(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").where("quality = 1")
    made = builders.yes_no(d, "toxic", F.col("text"), F.lit("Is it toxic?"), F.col("toxic") == 1, F.col("doc_id"))
    return made.select(F.col("pos").alias("doc_id"), _label(F.col("label")).alias("label"), "type")


def c_lang_yes_no(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    made = builders.one_of_each(d, "lang_noul", F.col("text"), F.concat(F.lit("Is it in "), F.col("candidate"), F.lit("?")), LANGS, F.col("lang"), 2, F.col("doc_id").cast("string"), F.col("doc_id"))
    return made.select(F.col("pos").alias("doc_id"), "question", _label(F.col("label")).alias("label"))


def c_votes(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("user", F.col("user_id"))
    kinds = builders.class_names(e, "event_type")
    return builders.votes(e, "user", "event_type", kinds).select("user", _label(F.col("label")).alias("label"))


def c_next_role(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    own = Window.partitionBy("conv_id").orderBy("turn")
    n = c.withColumn("next", F.lead("role").over(own)).where("next is not null")
    made = builders.sample(n, "next_role", F.col("text"), F.lit("Who speaks next?"), row.options_of(["assistant", "system", "user"]), F.col("next"), F.col("conv_id") * 1000 + F.col("turn"), group=F.col("conv_id").cast("string"))
    return made.select("pos", _label(F.col("label")).alias("label"), F.col("group").alias("conv"))


def c_siblings(spark, sf_dir):
    """The first reply of a conversation among the other replies in it."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    first = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("reply"))
    made = builders.text_choice(first, c.select("conv_id", F.col("text").alias("other")), "conv_id", "reply", "other")
    return made.select("conv_id", F.size("texts").cast("long").alias("n_texts"), F.array_join("texts", "|").alias("texts"), "place")


def c_names(spark, sf_dir):
    """A part's name among names of parts of its brand, drawn from its brand's circles."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name")
    pool = p.select("p_brand", F.col("p_partkey").alias("other_key"), F.col("p_name").alias("other"))
    drawn = rings.circled(p, pool, "p_partkey", "p_brand", "other_key", "other", 24)
    others = F.transform(F.filter("drawn", lambda d: d["id"] != F.col("p_partkey")), lambda d: d["entry"])
    made = builders.drawn_choice(drawn, "p_partkey", "p_name", others, most=5)
    return made.select("p_partkey", F.size("texts").cast("long").alias("n_texts"), F.element_at("texts", F.col("place")).alias("answer"))


def j_decontaminate(spark, sf_dir):
    """Documents that hold no benchmark text."""
    return relations.without_contained(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "text").select("doc_id")


def j_lookup(spark, sf_dir):
    """Names from side tables that have a row for each nation and region."""
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    s = table(spark, sf_dir, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select("s_suppkey", "n_name", "r_name")


def w_changes(spark, sf_dir):
    """Events whose type differs from the user's one before."""
    e = table(spark, sf_dir, "events")
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.withColumn("last", F.lag("event_type").over(own)).where("last is null or last <> event_type").select("event_id", "user_id", F.coalesce("last", F.lit("-")).alias("last"), "event_type")


def w_history(spark, sf_dir):
    """Each turn with the length of all that was said up to it."""
    c = table(spark, sf_dir, "conversations")
    # the turns are listed once a conversation, a history is a slice of the list
    listed = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t")).select("conv_id", "t", F.posexplode("t").alias("at", "one"))
    said = F.array_join(F.transform(F.slice("t", F.lit(1), F.col("at") + 1), lambda x: x["text"]), "\n")
    return listed.select("conv_id", F.col("one.turn").alias("turn"), F.sha1(said.cast("binary")).alias("history"))


def w_first(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.sha1(F.col("text").cast("binary")).alias("content")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


def _bits(key: Column) -> Column:
    return (row.bucket(key, 1000) + 1).cast("double")


def predictions(spark, sf_dir) -> DataFrame:
    """Rows (dataset, doc_id, probs, label): a made-up scorer of languages, by source; one in 50 gives no answer."""
    d = table(spark, sf_dir, "documents")
    raw = F.array(*[_bits(F.concat(F.col("doc_id").cast("string"), F.lit(f":{x}"))) + F.when(F.col("lang") == x, 900.0).otherwise(0.0) for x in LANGS])
    total = F.aggregate("raw", F.lit(0.0), lambda a, x: a + x)
    label = F.array(*[F.when(F.col("lang") == x, 1.0).otherwise(0.0) for x in LANGS])
    scored = d.select(F.col("source").alias("dataset"), "doc_id", raw.alias("raw"), label.alias("label"))
    return scored.select("dataset", "doc_id", F.when(F.col("doc_id") % 50 != 7, F.transform("raw", lambda x: x / total)).alias("probs"), "label")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def x_metrics(spark, sf_dir):
    return _rounded(metrics.by_dataset(predictions(spark, sf_dir)), "accuracy", "nll", "ece", "answered")


def x_macro(spark, sf_dir):
    per = metrics.by_dataset(predictions(spark, sf_dir))
    return _rounded(metrics.macro(per, F.col("dataset").isin("src0", "src1", "src2", "src3")), "accuracy", "nll", "ece").withColumn("n", F.col("n").cast("long"))


def binary(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    p = (row.bucket(F.col("event_id").cast("string"), 101) / 100.0)
    return e.select("event_type", F.when(F.col("event_id") % 40 != 3, p).alias("p"), (F.col("value") > 50).alias("gold"))


def x_thresholds(spark, sf_dir):
    return _rounded(metrics.thresholds(binary(spark, sf_dir)), "precision", "recall", "f1", "positive_rate")


def x_best_f1(spark, sf_dir):
    return metrics.best_f1(_rounded(metrics.thresholds(binary(spark, sf_dir)), "f1"))


def x_average_precision(spark, sf_dir):
    own = binary(spark, sf_dir).where("p is not null")
    return _rounded(metrics.average_precision(own, ("event_type",)), "average_precision")


def x_positives(spark, sf_dir):
    """Two-way rows judged by their "no", of which every 50th has no answer; yes stands first in every second one."""
    d = table(spark, sf_dir, "documents")
    p, share = row.bucket(F.col("doc_id").cast("string"), 101) / 100.0, (F.col("doc_id") % 5) / 4.0
    even = F.col("doc_id") % 2 == 0
    told = d.select(F.col("source").alias("dataset"), F.when(even, row.options_of(["yes", "no"])).otherwise(row.options_of(["no", "yes"], ["Нет", "Да"])).alias("options"),
                    F.when(F.col("doc_id") % 50 != 7, F.when(even, F.array(p, 1 - p)).otherwise(F.array(1 - p, p))).alias("probs"), F.when(even, F.array(share, 1 - share)).otherwise(F.array(1 - share, share)).alias("label"))
    rows = metrics.positives(told, "no")
    best = metrics.thresholds(rows).where("threshold = 0.5").select("tp", "fp", "fn", "tn")
    return _rounded(metrics.binary_summary(rows), "base_rate").crossJoin(F.broadcast(best))


def x_temperature(spark, sf_dir):
    own = predictions(spark, sf_dir).where("probs is not null").select(F.transform("probs", F.ln).alias("logits"), "label")
    return spark.createDataFrame([(round(metrics.fit_temperature(own), 4),)], "temperature double")


def scores(spark, sf_dir) -> DataFrame:
    """Metrics of three runs that differ in which documents they get right."""
    parts = []
    d = table(spark, sf_dir, "documents")
    for run in ("a", "b", "c"):
        hit = (row.bucket(F.concat(F.lit(run), F.col("doc_id").cast("string"))) < 70).cast("double")
        parts.append(d.select(F.lit(run).alias("entry"), F.col("source").alias("dataset"), hit.alias("hit")))
    every = parts[0].union(parts[1]).union(parts[2]).where("not (entry = 'c' and dataset = 'src3')")
    return every.groupBy("entry", "dataset").agg(F.avg("hit").alias("accuracy")).withColumn("benchmark", F.col("dataset").isin("src0", "src1", "src2", "src3"))


def r_leaderboard(spark, sf_dir):
    return _rounded(compare.leaderboard(scores(spark, sf_dir)), "macro", "mean_rank", "median")


def r_wide(spark, sf_dir):
    return _rounded(compare.wide(scores(spark, sf_dir), ["a", "b", "c"]), "a", "b", "c")


def l_limit(spark, sf_dir):
    return load.limited(lang_samples(spark, sf_dir), 100).select(F.col("pos").alias("doc_id"))


def l_weights(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select(F.col("lang").alias("dataset"))
    return _rounded(load.weights(own), "weight")


def l_packed(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("size"))
    return load.packed(own, "size", 65536)


def s_json(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.from_json("props", "k int")["k"].cast("long").alias("k"))


def s_page_lang(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_extract("html", r"<html[^>]*lang=[\"']?([a-zA-Z-]+)", 1).alias("lang"), F.trim(F.regexp_extract("html", r"<title>([^<]*)</title>", 1)).alias("title"))


QUERIES = {f.__name__: f for f in (
    p_regroup, p_counts, p_carve, p_resplit, p_cap, p_priority, u_slugify, u_bucket, u_pick, u_shuffle, u_context, u_marks, u_numbers, u_middle, u_mentions, u_spans, u_visible, u_generator, p_tenths, c_shares,
    c_lang, c_priority, c_toxic, c_lang_yes_no, c_votes, c_next_role, c_siblings, c_names, j_decontaminate, j_lookup, w_changes, w_history, w_first,
    x_metrics, x_macro, x_thresholds, x_best_f1, x_average_precision, x_positives, x_temperature, r_leaderboard, r_wide, l_limit, l_weights, l_packed, s_json, s_page_lang)}

_B = SQL_BUCKET.format
_CONTENT = f"case when text = '' then '{LANG_QUESTION}' else text end"
_CARVE = f"""with h as (select doc_id, {_B(_CONTENT, 100)} b, row_number() over (partition by text, lang order by doc_id) copy from documents) select doc_id, """
_ONE_HOT = "|| '|' ||".join(f"case when lang = '{x}' then '1.0000' else '0.0000' end" for x in LANGS)
_PREDICTED = f"""with r as (select source dataset, doc_id, lang, [{', '.join(f"cast({_B(f"doc_id || ':{x}'", 1000)} + 1 as double) + case when lang = '{x}' then 900.0 else 0.0 end" for x in LANGS)}] raw from documents),
q as (select dataset, lang, doc_id % 50 <> 7 was, list_position(['de', 'en', 'es', 'fr'], lang) gold, case when doc_id % 50 <> 7 then list_transform(raw, lambda x: x / list_sum(raw)) else [0.25, 0.25, 0.25, 0.25] end p from r),
s as (select dataset, was, case when list_position(p, list_max(p)) = gold then 1.0 else 0.0 end hit, list_max(p) conf, -ln(p[gold]) nll from q),
b as (select dataset, ceil(conf * 15) bin, count(*) m, sum(hit) h, sum(conf) c, sum(nll) l, sum(case when was then 1.0 else 0.0 end) w from s group by 1, 2),
d as (select dataset, cast(sum(m) as bigint) n, sum(h) / sum(m) accuracy, sum(l) / sum(m) nll, sum(abs(c - h)) / sum(m) ece, sum(w) / sum(m) answered from b group by 1)"""


def scored_sql(select: str, name: str) -> str:
    """The tables of made-up predictions and their metrics, and ``select`` over them as ``name``."""
    return f"{_PREDICTED}, {name} as ({select})"


_BINARY = f"with e as (select event_type, case when event_id % 40 <> 3 then {_B('cast(event_id as varchar)', 101)} / 100.0::double end p, value > 50 gold from events)"
_SWEEP = _BINARY + """, t as (select unnest(range(1, 20)) step), c as (select step, count(*) filter (gold and round(p * 20, 9) >= step) tp, count(*) filter (not gold and round(p * 20, 9) >= step) fp,
count(*) filter (gold and round(p * 20, 9) < step) fn, count(*) filter (not gold and round(p * 20, 9) < step) tn from t, e where p is not null group by 1),
r as (select *, tp / nullif(tp + fp, 0) as precision, tp / nullif(tp + fn, 0) as recall from c)"""
_SCORES = """with e as (select unnest(['a', 'b', 'c']) entry), x as (select entry, source dataset, case when """ + _B("entry || doc_id", 100) + """ < 70 then 1.0::double else 0.0 end hit from documents, e where not (entry = 'c' and source = 'src3')),
s as (select entry, dataset, avg(hit) accuracy, dataset in ('src0', 'src1', 'src2', 'src3') benchmark from x group by all),
m as (select *, count(*) over (partition by dataset) k from s), k as (select * from m where k = 3)"""



def packed_sql(order: str, budget: int = 65536) -> str:
    """Batches of the documents: the fold over each shard, a row at a time."""
    return f"""with recursive s as (select doc_id, length(text) size, {_B("'shard:' || doc_id", "(select greatest(8, ceil(count(*) / 100000)::int) from documents)")} shard from documents),
o as (select *, row_number() over (partition by shard order by {order}, doc_id) k from s),
r as (select doc_id, size, shard, k, 0::bigint batch, 1 n, size longest from o where k = 1 union all
select o.doc_id, o.size, o.shard, o.k, r.batch + f.fresh::int, case when f.fresh then 1 else r.n + 1 end, case when f.fresh then o.size else greatest(r.longest, o.size) end
from r join o on o.shard = r.shard and o.k = r.k + 1, lateral (select greatest(r.longest, o.size) * (r.n + 1) > {budget} fresh) f)
select doc_id, cast(size as int) size, shard, batch from r"""


def _temperature_sql(points: int = 9, rounds: int = 6) -> str:
    """Grids of log T, each around the best of the one before; shares to the power of 1 / T are those of tempered logits."""
    out = [_PREDICTED + ", o as (select gold, p from q where was), r0 as (select -3.0::double low, 3.0::double high)"]
    for k in range(rounds):
        out.append(f"""g{k} as (select i, low + (high - low) * i / {points - 1} g from r{k}, (select unnest(range({points})) i)),
w{k} as (select i, gold, list_transform(p, lambda x: pow(x / list_max(p), 1 / pow(2.718281828459045, g))) w from g{k}, o), v{k} as (select i, gold, list_transform(w, lambda x: greatest(x / list_sum(w), 1e-9)) v from w{k}),
l{k} as (select i, avg(-ln(v[gold] / list_sum(v))) loss from v{k} group by i), b{k} as (select arg_min(i, loss) b from l{k}),
r{k + 1} as (select (select g from g{k}, b{k} where i = greatest(0, b - 1)) low, (select g from g{k}, b{k} where i = least({points - 1}, b + 1)) high)""")
    return ", ".join(out) + f" select round(pow(2.718281828459045, (low + high) / 2), 4) temperature from r{rounds}"


SQL = {
    "u_spans": """with c as (select conv_id, turn, unnest(string_split(text, ' ')) tok, unnest(range(len(string_split(text, ' ')))) i from conversations),
t as (select *, case when not regexp_matches(tok, '^[a-m]') then 'O' when i % 3 = 0 then 'B' else 'I' end tag, case when regexp_matches(tok, '^[a-f]') then 'x' else 'y' end kind from c),
l as (select *, max(case when tag = 'B' then i end) over (partition by conv_id, turn order by i) b from t), k as (select *, max(case when tag = 'B' then kind end) over (partition by conv_id, turn, b) opened from l),
m as (select *, b is null or sum(case when tag = 'O' or (tag = 'I' and kind <> opened) then 1 else 0 end) over (partition by conv_id, turn, b order by i) > 0 out from k),
s as (select conv_id, turn, b, any_value(opened) || '=' || string_agg(tok, ' ' order by i) s from m where not out group by 1, 2, 3), a as (select conv_id, turn, string_agg(s, '|' order by b) s from s group by 1, 2),
x as (select conv_id, turn, bool_or(out and tag = 'I') torn from m group by 1, 2)
select conv_id, turn, case when c.text is not null then coalesce(s, '') end spans, case when c.text is not null then case when torn then '' else coalesce(s, '') end end whole_spans from conversations c left join a using (conv_id, turn) left join x using (conv_id, turn)""",
    "u_visible": r"""select conv_id, turn, case turn % 3 when 0 then regexp_matches(text, '(?i)(^|[^\pL\pM\pN_])the($|[^\pL\pM\pN_])') when 1 then conv_id % 2 = 0 or regexp_matches(text, '(?i)(^|[^\pL\pM\pN_])cent(er|re)($|[^\pL\pM\pN_])')
else regexp_matches(text, '(?i)(^|[^\pL\pM\pN_])a($|[^\pL\pM\pN_])') end visible from conversations""",
    "c_shares": "select doc_id, printf('%.4f', (doc_id % 5) / 4.0::double) || '|' || printf('%.4f', 1 - (doc_id % 5) / 4.0::double) as label from documents",
    "p_tenths": f"select doc_id, case {_B("coalesce(text, '')", 10)} when 0 then 'test' when 1 then 'validation' else 'train' end split from documents",
    "x_positives": f"""with r as (select source dataset, case when doc_id % 50 <> 7 then 1 - {_B("cast(doc_id as varchar)", 101)} / 100.0::double end p, 1 - (doc_id % 5) / 4.0::double >= 0.5 gold from documents),
c as (select count(*) filter (gold and round(p * 20, 9) >= 10) tp, count(*) filter (not gold and round(p * 20, 9) >= 10) fp, count(*) filter (gold and round(p * 20, 9) < 10) fn, count(*) filter (not gold and round(p * 20, 9) < 10) tn from r)
select dataset, count(p) n, count(*) - count(p) skipped, round(avg(gold::int::double) filter (p is not null), 6) base_rate, any_value(tp) tp, any_value(fp) fp, any_value(fn) fn, any_value(tn) tn from r, c group by 1""",
    "x_temperature": _temperature_sql(),
    "l_packed": packed_sql("size nulls first"),
    "p_regroup": SQL_REGROUP,
    "p_counts": f"select split from_split, target to_split, count(*) n from ({SQL_REGROUP}) group by 1, 2",
    "p_carve": _CARVE + "case when b < 5 then 'test' when b < 10 then 'validation' else 'train' end target from h where copy = 1",
    "p_resplit": _CARVE + "case when b < 10 then 'test' when b < 20 then 'validation' else 'train' end target from h where copy = 1",
    "p_cap": f"""select doc_id, split from (select *, row_number() over (partition by split order by sha1(text || chr(31) || '{LANG_QUESTION}' || chr(31) || doc_id), doc_id) n from (select *, {SQL_SPLIT} split from documents)) where n <= 50""",
    "p_priority": f"""select doc_id, split from (select doc_id, split, pr, min(pr) over (partition by text) h from (select *, {SQL_SPLIT} split, case {SQL_SPLIT} when 'test' then 0 when 'validation' then 1 else 2 end pr from documents)) where pr = h""",
    "u_slugify": "select p_partkey, trim(regexp_replace(lower(p_type || ' / ' || p_brand), '[^a-z0-9]+', '_', 'g'), '_') slug from part",
    "u_bucket": f"select doc_id, {_B('text', 100)} bucket from documents",
    "u_pick": f"select doc_id, ['What is it?', 'Which one?', 'Name it.'][{_B("'question:' || text", 3)} + 1] question from documents",
    "u_shuffle": """select p_partkey, string_agg(v, '|' order by sha1(p_partkey || ':' || i), i) shuffled from (select p_partkey, unnest([0, 1, 2]) i, unnest([p_brand, p_type, p_name]) v from part) group by 1""",
    "u_context": """select conv_id, turn, case when turn = 0 then '' else 'A conversation.' || chr(10) || chr(10) end || 'Answers:' || chr(10) || '- yes: it is' || chr(10) || '- no: it is not' || case when text = '' then '' else chr(10) || chr(10) || 'Turn:' || chr(10) || text end state from conversations""",
    "u_marks": """select page_id, '<¦state¦>' || url escaped, 'page url' || page_id camel, url bare, 'a ' || url spaced from pages""",
    "u_numbers": "select event_id, cast(case event_id % 3 when 0 then event_id when 1 then user_id end as int) number from events",
    "u_middle": "select doc_id, case when len(w) <= 9 then array_to_string(w, ' ') else array_to_string(w[1:4] || ['…'] || w[len(w) - 4:], ' ') end cut from (select doc_id, string_split(text, ' ') w from documents)",
    "u_mentions": r"select doc_id, len(list_filter(regexp_split_to_array(lower(text), '[^\pL\pM\pN_]+'), lambda x: x = 'the')) n_the from documents",
    "c_lang": f"select doc_id, 'de|en|es|fr' options, {_ONE_HOT} as label, 'choice' as type from documents",
    "c_priority": """with n as (select list(distinct o_orderpriority order by o_orderpriority) names from orders) select o_orderkey, array_to_string(list_transform(names, lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', '_', 'g'), '_')), '|') ids, array_to_string(list_transform(names, lambda x: case when x = o_orderpriority then '1.0000' else '0.0000' end), '|') as label from orders, n""",
    "c_toxic": "select doc_id, case when toxic = 1 then '1.0000|0.0000' else '0.0000|1.0000' end as label, 'noul' as type from documents join labels using (doc_id) where quality = 1",
    "c_lang_yes_no": """with o as (select doc_id, lang, unnest(list_filter(['de', 'en', 'es', 'fr'], lambda x: x <> lang)) c, unnest([0, 1, 2]) i from documents), r as (select *, row_number() over (partition by doc_id order by sha1(doc_id || ':' || i), i) n from o)
select doc_id, 'Is it in ' || c || '?' question, '0.0000|1.0000' as label from r where n <= 2 union all select doc_id, 'Is it in ' || lang || '?', '1.0000|0.0000' from documents""",
    "c_votes": """with k as (select distinct event_type from events), u as (select distinct user_id from events), n as (select user_id, event_type, count(*) m from events group by 1, 2), s as (select u.user_id, k.event_type, coalesce(m, 0) / sum(coalesce(m, 0)) over (partition by u.user_id) share from u cross join k left join n on n.user_id = u.user_id and n.event_type = k.event_type)
select user_id as "user", string_agg(printf('%.4f', cast(cast(share as float) as double)), '|' order by event_type) as label from s group by 1""",
    "c_next_role": """select conv_id * 1000 + turn pos, case nx when 'assistant' then '1.0000|0.0000|0.0000' when 'system' then '0.0000|1.0000|0.0000' else '0.0000|0.0000|1.0000' end as label, cast(conv_id as varchar) conv from (select *, lead(role) over (partition by conv_id order by turn) nx from conversations) where nx is not null""",
    "c_siblings": """with f as (select conv_id, arg_min(text, turn) reply from conversations where role = 'assistant' group by 1),
p as (select conv_id, reply, text other, sha1('distractors:' || conv_id || ':' || text) h from f join conversations using (conv_id) where role = 'assistant' and trim(text) <> '' and lower(trim(text)) <> lower(trim(reply))),
u as (select * from p qualify row_number() over (partition by conv_id, lower(trim(other)) order by h, other) = 1), n as (select *, row_number() over (partition by conv_id order by h) i from u qualify i <= 20),
a as (select conv_id, reply, other v, i from n union all select distinct conv_id, reply, reply, 0 from n), s as (select *, row_number() over (partition by conv_id order by sha1('options:' || conv_id || ':' || i), i) k from a)
select conv_id, count(*) n_texts, string_agg(v, '|' order by k) texts, cast(min(k) filter (v = reply) as int) place from s group by 1""",
    "j_decontaminate": "select doc_id from documents d where not exists (select 1 from benchmark b where contains(d.text, b.text))",
    "j_lookup": "select s_suppkey, n_name, r_name from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey",
    "w_changes": "select event_id, user_id, coalesce(l, '-') as last, event_type from (select *, lag(event_type) over (partition by user_id order by ts, event_id) l from events) where l is null or l <> event_type",
    "w_history": "select conv_id, turn, sha1(string_agg(text, chr(10)) over (partition by conv_id order by turn rows unbounded preceding)) history from conversations",
    "w_first": "select sha1(text) as content, min(doc_id) doc_id, count(*) n from documents group by 1",
    "x_metrics": _PREDICTED + " select dataset, n, round(accuracy, 6) accuracy, round(nll, 6) nll, round(ece, 6) ece, round(answered, 6) answered from d",
    "x_macro": _PREDICTED + " select case when dataset in ('src0', 'src1', 'src2', 'src3') then 'benchmark_macro' else 'macro' end dataset, cast(sum(n) as bigint) n, round(avg(accuracy), 6) accuracy, round(avg(nll), 6) nll, round(avg(ece), 6) ece from d group by 1",
    "x_thresholds": _SWEEP + " select round(step / 20, 2) threshold, tp, fp, fn, tn, round(precision, 6) as precision, round(recall, 6) as recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) f1, round((tp + fp) / (tp + fp + fn + tn), 6) positive_rate from r",
    "x_best_f1": _SWEEP + " select round(step / 20, 2) best_f1_threshold from r order by round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) desc nulls last, step limit 1",
    "x_average_precision": _BINARY + """, g as (select event_type, p, count(*) m, count(*) filter (gold) pos from e where p is not null group by 1, 2), w as (select *, sum(m) over d up, sum(pos) over d tp from g window d as (partition by event_type order by p desc))
select event_type, cast(sum(m) as bigint) n, cast(sum(pos) as bigint) n_pos, round(sum(pos * tp / up) / nullif(sum(pos), 0), 6) average_precision from w group by 1""",
    "r_leaderboard": _SCORES + """, v as (select *, rank() over (partition by dataset order by accuracy desc) + (count(*) over (partition by dataset, accuracy) - 1) / 2 rk, accuracy = max(accuracy) over (partition by dataset) won from k)
select benchmark, entry, round(avg(accuracy), 6) macro, round(avg(rk), 6) mean_rank, count(*) filter (won) wins, round(quantile_cont(accuracy, 0.5), 6) median from v group by 1, 2""",
    "r_wide": _SCORES + " select dataset, round(max(accuracy) filter (entry = 'a'), 6) a, round(max(accuracy) filter (entry = 'b'), 6) b, round(max(accuracy) filter (entry = 'c'), 6) c from k group by 1",
    "l_limit": f"select doc_id from documents order by sha1({_CONTENT} || ':' || '{LANG_QUESTION}'), doc_id limit 100",
    "l_weights": "select lang dataset, count(*) n, round(pow(count(*), 0.5) / count(*), 6) weight from documents group by 1",
    "c_names": """with p as (select p_partkey k, p_brand b, p_name nm, row_number() over (partition by p_brand order by sha1(cast(p_partkey as varchar)), p_partkey) - 1 a, count(*) over (partition by p_brand) n,
cast('0x' || substr(sha1(p_partkey || ':at'), 1, 15) as bigint) h from part),
m as (select r.k, r.nm, c.nm other from p r join p c on r.b = c.b and r.k <> c.k and (c.a - r.h % r.n - 1 + r.n) % r.n < 24)
select k p_partkey, least(5, count(distinct lower(trim(other)))) + 1 n_texts, nm answer from m where trim(other) <> '' and lower(trim(other)) <> lower(trim(nm)) group by k, nm""",
    "s_json": "select event_id, cast(props->>'k' as bigint) k from events",
    "s_page_lang": """select page_id, regexp_extract(html, '<html[^>]*lang=["'']?([a-zA-Z-]+)', 1) lang, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) title from pages""",
}
