"""Queries over questions, prompts, judged passages, pools, comparisons and file formats, with the SQL that has to give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradus.functions import parse, row
from gradus.operators import builders, compare, load, metrics, questions, relations
from gradus.plans.queries import LANG_QUESTION, SQL_BUCKET, lang_samples, packed_sql, scores
from gradus.sources import scratch, tables
from gradus.sources.tables import table

PHRASES = ["Is the {role} polite?", "Does the {role} agree?", "Would {role} say so again?"]
CRITERIA = {"de": "German, ou and the", "en": "English, the ere", "es": "", "fr": "le la un reau"}


def u_question(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", questions.composed("Reply", F.col("text"), PHRASES, F.col("text"), role=F.col("role")).alias("question"))


def u_rendered(spark, sf_dir):
    """What indented JSON says when it is read again."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", questions.rendered(F.struct("n_name", F.array("n_regionkey").alias("keys"))).alias("j"))
    told = F.from_json("j", "n_name string, keys array<bigint>")
    return n.select("n_nationkey", told["n_name"].alias("name"), told["keys"][0].alias("key"), F.contains("j", F.lit("\n")).alias("indented"))


def u_prompt(spark, sf_dir):
    """Prompts of 40 words, of which the question takes six or, in every ninth document, 36 or 44."""
    d = table(spark, sf_dir, "documents")
    more = F.when(F.col("doc_id") % 9 == 0, F.array_repeat(F.lit("x"), 30)).when(F.col("doc_id") % 9 == 1, F.array_repeat(F.lit("x"), 38)).otherwise(F.array().cast("array<string>"))
    query = F.concat(F.split(F.lit("Which language is the text in?"), " "), more)
    return d.select("doc_id", F.array_join(questions.prompt(F.split("text", " "), query, 40), " ").alias("prompt"))


def u_query_text(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", questions.query_text(F.lit("Which?"), F.array("p_brand", "p_type")).alias("query"))


def u_keys(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    third = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).when(F.col("p_partkey") % 3 == 1, F.lit(" ")).otherwise(F.col("p_name"))
    return p.select("p_partkey", F.array_join(questions.keys_of(F.array("p_brand", "p_type", third)), "|").alias("keys"))


DATED = ("""case o_orderkey % 7 when 0 then 'On ' || {d} || ' this takes effect' when 1 then 'It commences on ' || {d} when 2 then 'Signed. Then ' || {d} || ', the effective date'
when 3 then 'It commenced. Signed on ' || {d} when 4 then 'effective as of ' || {d} when 5 then 'By the laws of Ur, ' || {d} else 'governed. ' || {d} || ' ("effective Date")' end""")
SPARK_DATE, DUCK_DATE = "date_format(o_orderdate, 'MMMM d, yyyy')", "strftime(o_orderdate, '%B %-d, %Y')"


def u_dates(spark, sf_dir):
    """Whether a made-up clause's date is one with a year, takes effect, and whether the clause speaks of governing law; some dates lack a year."""
    said = F.when(F.col("o_orderkey") % 5 == 0, F.regexp_replace("date", r", \d+$", "")).otherwise(F.col("date"))
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{SPARK_DATE} date", f"{DATED.format(d=SPARK_DATE)} clause")
    start = F.instr(F.col("clause"), F.col("date")) - 1
    return o.select("o_orderkey", parse.whole_date(said).alias("whole"), parse.takes_effect(F.col("clause"), start, F.length("date")).alias("effective"), parse.governed(F.col("clause")).alias("governed"))


def c_own_options(spark, sf_dir):
    """A part's type among its brand, type and name; places beyond the three are dropped."""
    p = table(spark, sf_dir, "part")
    made = builders.own_options(p, "own", F.col("p_name"), F.lit("Which?"), F.array("p_brand", "p_type", "p_name"), F.col("p_partkey") % 5, F.col("p_partkey"))
    return made.select(F.col("pos").alias("p_partkey"), F.array_join(F.transform("options", lambda o: F.concat(o["id"], F.lit("="), o["text"])), "|").alias("options"),
                       F.array_join(F.transform("label", lambda x: F.format_number(x.cast("double"), 1)), "|").alias("label"))


def _split(key):
    b = row.bucket(F.concat(F.lit("split"), key.cast("string")))
    return F.when(b < 10, "test").when(b < 20, "validation").otherwise("train")


SQL_SPLIT = "case when {0} < 10 then 'test' when {0} < 20 then 'validation' else 'train' end"


def c_pool(spark, sf_dir):
    """A part's name among names that train parts of its brand have."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", _split(F.col("p_partkey")).alias("split"))
    made = builders.pool_choice(p, "p_partkey", "p_brand", "p_name", most=5)
    return made.select("p_partkey", "split", F.size("texts").cast("long").alias("n_texts"), F.element_at("texts", F.col("place")).alias("answer"))


def judged_orders(spark, sf_dir) -> DataFrame:
    """Orders as topics, their parts as passages, relevant where a line was returned; every 30th topic is blank, every 50th passage too."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    topics = o.select(F.col("o_orderkey").alias("topic"), F.when(F.col("o_orderkey") % 30 == 0, " ").otherwise(F.concat_ws(" ", "o_orderstatus", (F.col("o_totalprice") / 10).cast("long").cast("string"))).alias("query"))
    judgments = li.select(F.col("l_orderkey").alias("topic"), F.col("l_partkey").alias("passage"), (F.col("l_returnflag") == "R").cast("int").alias("relevance"))
    corpus = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("passage"), F.when(F.col("p_partkey") % 50 == 3, "").otherwise(F.concat_ws(" ", "p_name", "p_brand")).alias("text"))
    return relations.judged(topics, judgments, corpus)


def j_judged(spark, sf_dir):
    return judged_orders(spark, sf_dir).select("topic", F.size("passages").cast("long").alias("n"), F.array_join(F.transform("passages", lambda p: F.concat_ws(":", p["passage"], p["relevance"])), "|").alias("passages"), "relevant")


def c_judged_choice(spark, sf_dir):
    made = relations.judged_choice(judged_orders(spark, sf_dir), "None of these", 3)
    answer = F.element_at("texts", F.col("place"))
    return made.select("topic", F.size("texts").cast("long").alias("n_texts"), (answer == "None of these").alias("none"),
                       F.exists("passages", lambda p: (p["text"] == answer) & (p["relevance"] == 1)).alias("right"))


def j_unseen(spark, sf_dir):
    """Topics of the other splits whose query and passages no test topic of a rare kind has."""
    rows = judged_orders(spark, sf_dir)
    return relations.without_seen(rows.where("topic % 100 <> 7"), rows.where("topic % 100 = 7")).select("topic")


def j_either(spark, sf_dir):
    """Pairs of turns in a row; those of which a held-out pair has a text go."""
    c = table(spark, sf_dir, "conversations")
    own = Window.partitionBy("conv_id").orderBy("turn")
    pairs = c.select("conv_id", "turn", F.col("text").alias("one"), F.lead("text").over(own).alias("two")).where("two is not null").withColumn("split", _split(F.col("conv_id")))
    return relations.without_either(pairs.where("split <> 'test'"), ("one", "two"), pairs.where("split = 'test'")).select("conv_id", "turn", "split")


def j_once(spark, sf_dir):
    """Documents of three words or more of which neither the text nor the first word in lower case with the language stands twice."""
    d = table(spark, sf_dir, "documents")
    fine = relations.standing_once(d, F.col("text"), F.concat_ws(":", "lang", F.lower(F.substring("text", 1, 6))))
    return fine.where(F.size(F.split("text", " ")) >= 3).select("doc_id")


def j_halves(spark, sf_dir):
    """Parts of the second half with the name at the same place of the first."""
    return relations.first_halves(table(spark, sf_dir, "part"), "p_partkey", "p_name").select("p_partkey", "first_value")


def q_answers(spark, sf_dir):
    """Documents asked by the baseline scorer: a choice with a text for most of its keys, every fourth a yes/no question."""
    d = table(spark, sf_dir, "documents")
    listed = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("text")) for k, v in CRITERIA.items()])
    asked = d.select("doc_id", "text", F.when(F.col("doc_id") % 4 != 0, listed).alias("criteria")).withColumn("texts", questions.criteria_texts(F.col("criteria")))
    a = asked.withColumn("probs", questions.overlap_probs(F.col("text"), F.col("texts"))).select("doc_id", questions.shaped(F.col("criteria"), F.col("probs")).alias("a"))
    return a.select("doc_id", F.round("a.noul", 6).alias("noul"), "a.choice", F.round("a.confidence", 6).alias("confidence"), F.round(F.col("a.probabilities")["fr"], 6).alias("fr"))


def x_logits(spark, sf_dir):
    """Each vector as a query to itself and its reverse, one of them masked in every third row."""
    e = table(spark, sf_dir, "embeddings")
    keys = F.array(F.col("embedding"), F.reverse("embedding"))
    own = questions.logits(F.col("embedding"), keys, 0.125, F.array(F.lit(True), F.col("vec_id") % 3 != 0))
    p = metrics.tempered(own)
    return e.select("vec_id", F.round(own[0], 4).alias("own"), F.round(p[0], 4).alias("p"))


def l_items(spark, sf_dir):
    """Every third sample has one option, so that the cap takes some of those away with it."""
    own = lang_samples(spark, sf_dir).withColumn("options", F.when(F.col("pos") % 3 == 0, F.slice("options", 1, 1)).otherwise(F.col("options")))
    return load.capped_items(own, 100).select(F.col("pos").alias("doc_id"))


def l_epoch(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("size"))
    return load.epoch(own, "doc_id", "size", 65536, 1)


def partial_scores(spark, sf_dir) -> DataFrame:
    """Scores in which one run has no value for one benchmark, and which save a flag for some datasets only."""
    s = scores(spark, sf_dir)
    return s.withColumn("accuracy", F.when(~((F.col("entry") == "a") & (F.col("dataset") == "src0")), F.col("accuracy"))).withColumn("benchmark", F.when(~F.col("dataset").isin("src2", "src4"), F.col("benchmark")))


def r_described(spark, sf_dir):
    info = spark.createDataFrame([("src0", "nlu", "noul", False), ("src2", "logic", "choice", True), ("src9", "x", "y", True)], "dataset string, topic string, type string, benchmark boolean")
    return compare.described(partial_scores(spark, sf_dir), info).select("entry", "dataset", "topic", "type", "group")


def r_partial(spark, sf_dir):
    """A board with a missing value; the macro that lacks one is null here."""
    own = partial_scores(spark, sf_dir).withColumn("benchmark", F.coalesce("benchmark", F.lit(False)))
    board = compare.ordered(compare.leaderboard(own))
    return board.select("benchmark", "entry", F.round(F.nanvl("macro", F.lit(None).cast("double")), 6).alias("macro"), F.round("mean_rank", 6).alias("mean_rank"), "wins", F.round("median", 6).alias("median"))


def r_lines(spark, sf_dir):
    columns = {"dataset": F.col("dataset"), "run": F.col("entry"), "accuracy": F.format_number("accuracy", 3)}
    return compare.text_rows(partial_scores(spark, sf_dir), columns).select("line")


def s_csv(spark, sf_dir):
    """Suppliers written as text with separators and read again."""
    path = scratch.folder(spark, "csv")
    table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit('"a", '), "s_name").alias("name"), "s_acctbal").write.option("header", True).option("escape", '"').csv(path)
    return tables.separated(spark, path, "s_suppkey bigint, name string, s_acctbal double")


def s_tsv(spark, sf_dir):
    """Names with quotes in them, separated by tabs, without quoting or a header."""
    path = scratch.folder(spark, "tsv")
    table(spark, sf_dir, "nation").select(F.concat_ws("\t", "n_nationkey", F.concat(F.lit('"'), "n_name")).alias("line")).write.text(path)
    return tables.separated(spark, path, "n_nationkey bigint, name string", sep="\t", header=False, quote="")


def s_json_files(spark, sf_dir):
    """Turns as JSON lines, with the definitions of two of the roles beside them."""
    path = scratch.folder(spark, "json")
    table(spark, sf_dir, "conversations").write.json(f"{path}/lines")
    side = [("user", "asks"), ("assistant", "answers")]
    spark.createDataFrame(side, "role string, does string").agg(F.to_json(F.collect_list(F.struct("role", "does")), {"pretty": "true"}).alias("value")).write.text(f"{path}/side")
    read = tables.json_lines(spark, f"{path}/lines", "conv_id bigint, turn bigint, role string, text string")
    return tables.with_definitions(read, tables.json_files(spark, f"{path}/side", "role string, does string").drop("file"), ["role"]).select("conv_id", "turn", "does", F.sha1(F.col("text").cast("binary")).alias("content"))


QUERIES = {f.__name__: f for f in (
    u_question, u_rendered, u_prompt, u_query_text, u_keys, u_dates, c_own_options, c_pool, j_judged, c_judged_choice, j_unseen, j_either, j_once, j_halves, q_answers, x_logits,
    l_items, l_epoch, r_described, r_partial, r_lines, s_csv, s_tsv, s_json_files)}

_B = SQL_BUCKET.format
_JUDGED = """with t as (select o_orderkey topic, case when o_orderkey % 30 = 0 then ' ' else o_orderstatus || ' ' || cast(trunc(o_totalprice / 10) as bigint) end query from orders),
j as (select l_orderkey topic, l_partkey passage, max(case when l_returnflag = 'R' then 1 else 0 end) rel, any_value(case when p_partkey % 50 = 3 then '' else p_name || ' ' || p_brand end) as text from lineitem join part on l_partkey = p_partkey group by 1, 2),
g as (select topic, query, count(*) n, string_agg(passage || ':' || rel, '|' order by passage) passages, bool_or(rel = 1) relevant from t join j using (topic) where trim(query) <> '' group by all having count(*) filter (trim(text) = '') = 0)"""
_SCORES = """with e as (select unnest(['a', 'b', 'c']) entry), x as (select entry, source dataset, case when """ + _B("entry || doc_id", 100) + """ < 70 then 1.0::double else 0.0 end hit from documents, e where not (entry = 'c' and source = 'src3')),
s as (select entry, dataset, case when not (entry = 'a' and dataset = 'src0') then avg(hit) end accuracy, case when dataset not in ('src2', 'src4') then dataset in ('src0', 'src1', 'src2', 'src3') end benchmark from x group by entry, dataset)"""
_TEXTS = ", ".join(f"'{k}: {v}'" if v else f"'{k}'" for k, v in CRITERIA.items())
_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^\pL\pN]+'), lambda w: w <> ''))"
_SPACED = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_MONTHS = r"(?i)\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\b"

SQL = {
    "u_question": f"""select conv_id, turn, 'Reply: ' || text || chr(10) || replace(['Is the {{role}} polite?', 'Does the {{role}} agree?', 'Would {{role}} say so again?'][{_B("'question:' || text", 3)} + 1], '{{role}}', role) question from conversations""",
    "u_rendered": "select n_nationkey, n_name as name, n_regionkey as key, true as indented from nation",
    "u_prompt": """with d as (select doc_id, string_split(text, ' ') c, string_split('Which language is the text in?', ' ') || list_transform(range(case doc_id % 9 when 0 then 30 when 1 then 38 else 0 end), lambda i: 'x') q from documents),
k as (select *, 40 - len(q) room, 39 - len(q) keep, (39 - len(q)) // 2 head from d)
select doc_id, array_to_string(case when len(c) <= room then c || q when keep >= 16 then c[1:head] || [chr(10) || '...' || chr(10)] || c[len(c) - (keep - head) + 1:] || q end, ' ') prompt from k""",
    "u_query_text": "select p_partkey, 'Question: Which?' || chr(10) || 'Options:' || chr(10) || '1) ' || p_brand || chr(10) || '2) ' || p_type || chr(10) || 'Answer:' query from part",
    "u_keys": "select p_partkey, case when p_partkey % 3 < 2 or len(list_distinct([p_brand, p_type, p_name])) < 3 then '1|2|3' else p_brand || '|' || p_type || '|' || p_name end keys from part",
    "u_dates": rf"""with o as (select o_orderkey, {DUCK_DATE} d, {DATED.format(d=DUCK_DATE)} c from orders), s as (select *, instr(c, d) - 1 st, case when o_orderkey % 5 = 0 then regexp_replace(d, ', \d+$', '') else d end said from o)
select o_orderkey, regexp_matches(said, '{_MONTHS}') and regexp_matches(said, '\b\d{{4}}\b') whole, regexp_matches({_SPACED.format('left(c, st)')}, '(?i)(?:effective|takes? effect|commenc\w*)[^.!?]{{0,100}}$')
or regexp_matches({_SPACED.format('substr(c, st + len(d) + 1)')}, '(?i)^\s*[,(]?\s*(?:the\s+)?["“]?effective date\b') effective, regexp_matches(c, '(?i)govern|construed|laws? of') governed from s""",
    "c_own_options": "select p_partkey, 'A=' || p_brand || '|B=' || p_type || '|C=' || p_name as options, ['1.0|0.0|0.0', '0.0|1.0|0.0', '0.0|0.0|1.0'][p_partkey % 5] as label from part where p_partkey % 5 between 1 and 3",
    "c_pool": f"""with p as (select p_partkey k, p_brand b, p_name nm, {SQL_SPLIT.format(_B("'split' || p_partkey", 100))} split, cast('0x' || substr(sha1(p_partkey || ':at'), 1, 15) as bigint) h from part),
d as (select distinct b, nm from p where split = 'train'), c as (select b, nm, row_number() over (partition by b order by sha1(nm), nm) - 1 a, count(*) over (partition by b) n from d),
m as (select k, split, p.nm, c.nm other from p join c on p.b = c.b and (c.a - p.h % c.n - 1 + c.n) % c.n < 24)
select k p_partkey, split, least(5, count(distinct lower(trim(other)))) + 1 n_texts, nm answer from m where trim(other) <> '' and lower(trim(other)) <> lower(trim(nm)) group by k, split, nm""",
    "j_judged": _JUDGED + " select topic, n, passages, relevant from g",
    "c_judged_choice": _JUDGED + """, x as (select topic, text, min(rel) lo, max(rel) hi from j semi join g using (topic) group by 1, 2), y as (select topic, count(*) filter (hi = 1) good, count(*) filter (hi = 0) bad from x group by 1 having bool_and(lo = hi))
select topic, least(good, 1) + least(bad, 3) + 1 n_texts, good = 0 as "none", good > 0 "right" from y where least(good, 1) + least(bad, 3) >= 2""",
    "j_unseen": _JUDGED + """, s as (select topic, query from g where topic % 100 = 7), p as (select distinct passage from j semi join s using (topic))
select topic from g where topic % 100 <> 7 and query not in (select query from s) and topic not in (select topic from j semi join p using (passage))""",
    "j_either": f"""with p as (select *, {SQL_SPLIT.format(_B("'split' || conv_id", 100))} split from (select conv_id, turn, text one, lead(text) over (partition by conv_id order by turn) two from conversations) where two is not null),
h as (select one v from p where split = 'test' union select two from p where split = 'test') select conv_id, turn, split from p where split <> 'test' and one not in (select v from h) and two not in (select v from h)""",
    "j_once": """with a as (select *, count(*) over (partition by text) n from documents), b as (select *, count(*) over (partition by lang || ':' || lower(substr(text, 1, 6))) m from a where n = 1)
select doc_id from b where m = 1 and len(string_split(text, ' ')) >= 3""",
    "j_halves": "with h as (select count(*) // 2 h from part) select a.p_partkey, b.p_name first_value from part a, h join part b on b.p_partkey < h.h and a.p_partkey % h.h = b.p_partkey",
    "q_answers": rf"""with w as (select doc_id, doc_id % 4 = 0 yn, {_WORDS.format('text')} ws, case when doc_id % 4 = 0 then ['yes', 'no'] else [{_TEXTS}] end ts from documents),
r as (select doc_id, yn, list_transform(ts, lambda t: 1.0::double + len(list_intersect({_WORDS.format('t')}, ws))) raw from w), p as (select doc_id, yn, list_transform(raw, lambda x: x / list_sum(raw)) p from r)
select doc_id, case when yn then round(p[1], 6) end noul, case when not yn then ['de', 'en', 'es', 'fr'][list_position(p, list_max(p))] end choice, case when not yn then round(list_max(p), 6) end confidence, case when not yn then round(p[4], 6) end fr from p""",
    "x_logits": """with v as (select vec_id, list_inner_product(cast(embedding as double[]), cast(embedding as double[])) * 0.125 a, list_inner_product(cast(embedding as double[]), list_reverse(cast(embedding as double[]))) * 0.125 b from embeddings)
select vec_id, round(a, 4) own, round(case when vec_id % 3 = 0 then 1.0 else exp(a - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))) end, 4) p from v""",
    "l_items": f"select doc_id from (select doc_id from documents order by sha1(case when text = '' then '{LANG_QUESTION}' else text end || ':' || '{LANG_QUESTION}'), doc_id limit 100) where doc_id % 3 <> 0",
    "l_epoch": packed_sql("sha1('epoch:0:1:' || doc_id)"),
    "r_described": _SCORES + """, f as (select dataset, bool_or(benchmark) flag from s group by 1) select entry, dataset, case dataset when 'src0' then 'nlu' when 'src2' then 'logic' when 'src9' then 'x' else '?' end topic, case dataset when 'src0' then 'noul' when 'src2' then 'choice' when 'src9' then 'y' else '?' end as type,
case when coalesce(flag, dataset in ('src2', 'src9')) then 'benchmark' else 'test' end as "group" from s join f using (dataset)""",
    "r_partial": _SCORES + """, k as (select entry, dataset, accuracy, coalesce(benchmark, false) benchmark from s where dataset <> 'src3'), v as (select *, case when accuracy is not null then rank() over (partition by dataset order by accuracy desc nulls last) + (count(*) over (partition by dataset, accuracy) - 1) / 2 end rk,
accuracy = max(accuracy) over (partition by dataset) won from k) select benchmark, entry, case when count(*) = count(accuracy) then round(avg(accuracy), 6) end macro, round(avg(rk), 6) mean_rank, count(*) filter (won) wins, round(quantile_cont(accuracy, 0.5), 6) median from v group by 1, 2""",
    "r_lines": _SCORES + " select '| ' || dataset || ' | ' || entry || ' | ' || coalesce(printf('%.3f', accuracy), '-') || ' |' line from s",
    "s_csv": """select s_suppkey, '"a", ' || s_name as name, s_acctbal from supplier""",
    "s_tsv": """select n_nationkey, '"' || n_name as name from nation""",
    "s_json_files": "select conv_id, turn, case role when 'user' then 'asks' else 'answers' end does, sha1(text) as content from conversations where role in ('user', 'assistant')",
}
