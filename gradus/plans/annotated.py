"""Queries over annotated texts, tables, dialogues, losses and variants of samples, with the SQL that has to give the same rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradus.functions import parse, row
from gradus.operators import augment, metrics, structured
from gradus.plans.queries import SQL_BUCKET, _label, _rounded, _texts, lang_samples, predictions, scored_sql
from gradus.sources.tables import table


def _joined(pairs: Column, name: str, value: str) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(p[name], F.lit("="), p[value])), "|")


def u_sentences(spark, sf_dir):
    parts = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", parse.fragments(F.col("text")).alias("f"))
    return parts.select("doc_id", F.size("f").cast("long").alias("n"), F.element_at("f", -1)["end"].cast("long").alias("last_end"), F.sha1(F.array_join(F.transform("f", lambda f: f["text"]), "|").cast("binary")).alias("texts"))


def u_marked(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    marked = F.concat(F.lit("a [brand : "), "p_brand", F.lit("] of [kind : "), "p_type", F.lit("]"))
    plain = F.when(F.col("p_partkey") % 5 == 0, F.lit("damaged")).otherwise(F.concat(F.lit("a "), "p_brand", F.lit(" of "), "p_type"))
    return p.select("p_partkey", _joined(parse.marked_spans(marked, plain), "slot", "value").alias("spans"))


def u_lettered(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", _joined(parse.lettered_options(F.concat(F.lit("A) "), "p_brand", F.lit(" B) "), "p_type", F.lit("\nC) "), "p_name")), "id", "text").alias("options"))


def u_normalized(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    h, m = (F.col("event_id") % 12 + 1).cast("string"), F.lpad((F.col("event_id") % 60).cast("string"), 2, "0")
    said = F.when(F.col("event_id") % 4 == 0, F.concat(h, F.lit(":"), m, F.lit(" p.m."))).when(F.col("event_id") % 4 == 1, F.concat(h, F.lit("am"))).when(F.col("event_id") % 4 == 2, F.concat(h, F.lit(":"), m)).otherwise(F.concat(F.lit("City Centre, gate two "), m))
    return e.select("event_id", parse.normalized(said).alias("value"), parse.usable(F.when(F.col("event_id") % 3 == 0, "None").otherwise(said)).alias("usable"))


def u_readable(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", parse.readable(F.concat(F.lit(' "'), F.translate("p_type", " ", "_"), F.lit('" '))).alias("name"))


def u_window(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", parse.window_around(F.col("text"), (F.col("doc_id") % 700).cast("int"), F.lit(9)).alias("passage"))


def u_tagged(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.array_join(parse.tagged(F.col("text"), {"digit": "[0-9]", "question": r"\?", "mail": "@"}), "|").alias("tags"))


def order_tables(spark, sf_dir):
    """Each order's lines as a table of text cells under one row of headers."""
    cell = lambda v, head: F.struct(v.cast("string").alias("value"), F.lit(head).alias("is_header"), F.lit(1).alias("column_span"), F.lit(1).alias("row_span"))
    # lines are collected as plain values and become cells in the groups: less is moved, and in the same order
    line = F.struct("l_linenumber", F.col("l_partkey").cast("string").alias("part"), F.concat(F.lit("f"), "l_returnflag").alias("flag"))
    cells = lambda x: F.array(cell(x["l_linenumber"], False), cell(x["part"], False), cell(x["flag"], False))
    heads = F.array(*[cell(F.lit(h), True) for h in ("line", " part ", "flag")])
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"))
    return lines.select("l_orderkey", F.concat(F.array(heads), F.transform(F.sort_array("lines"), cells)).alias("table"))


def u_table(spark, sf_dir):
    plain = order_tables(spark, sf_dir).select("l_orderkey", parse.plain_table(F.col("table")).alias("t"))
    # exploded, as a filter on t would go below the projection and build each table again for every use in it
    t = plain.select("l_orderkey", F.explode(F.array("t")).alias("t")).where("t is not null")
    return t.select("l_orderkey", parse.key_column(F.col("t")).cast("long").alias("key"), parse.table_text(F.lit("order"), F.col("t")).alias("text"))


def c_cells(spark, sf_dir):
    made = structured.table_cells(order_tables(spark, sf_dir), "l_orderkey", F.col("table"))
    return made.select("l_orderkey", F.col("row").cast("long").alias("row"), F.col("column").cast("long").alias("column"), "header", "key_header", "name", "answer", F.array_join("others", "|").alias("others"))


def c_evidence(spark, sf_dir):
    """Documents asked for the sentence with their tenth word."""
    d = table(spark, sf_dir, "documents").withColumn("w", F.split("text", " ")).where(F.size("w") >= 10)
    span = F.array(F.struct((F.length(F.array_join(F.slice("w", 1, 9), " ")) + 1).alias("start"), F.element_at("w", 10).alias("text")))
    made = structured.evidence(d, F.col("text"), F.lit("Where is it said?"), span)
    return made.select("doc_id", F.size("texts").cast("long").alias("n"), "place", F.element_at("texts", F.col("place")).alias("answer"))


def c_relations(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    text = F.concat("s_name", F.lit(" sells in "), "n_name", F.lit(" but not in all of "), "r_name", F.lit("."))
    start = lambda c: F.instr("text", c) - 1
    docs = s.withColumn("text", text).withColumns({"a": F.lit(0), "b": F.length("s_name") + 10})
    docs = docs.withColumn("c", F.col("b") + F.length("n_name") + 19)
    line = lambda i, kind, at, name: F.concat_ws("\t", F.lit(f"T{i}"), F.concat_ws(" ", F.lit(kind), F.col(at).cast("string"), (F.col(at) + F.length(name)).cast("string")), F.col(name))
    notes = F.concat_ws("\n", line(1, "ORG", "a", "s_name"), line(2, "PLACE", "b", "n_name"), line(3, "PLACE", "c", "r_name"), F.lit("T4\tPLACE 0 1;2 3\tdamaged"), F.lit("R1\tSELLS_IN Arg1:T1 Arg2:T2"))
    made = structured.unique_objects(docs.withColumn("notes", notes), "s_suppkey", "text", "notes", ["SELLS_IN"], ["ALSO"])
    return made.select("s_suppkey", "kind", "subject", "object", F.array_join("others", "|").alias("others"))


def w_values(spark, sf_dir):
    """Events at which the value of a user and type changes; a value of 0 counts as none."""
    k = F.get_json_object("props", "$.k").cast("int") % 3
    e = table(spark, sf_dir, "events").withColumn("values", F.array(F.when(k == 0, "none").otherwise(F.concat(F.lit("v"), k.cast("string")))))
    return structured.current_values(e, ("user_id", "event_type"), ("ts", "event_id"), "values").select("event_id", F.col("values")[0].alias("value"))


def w_slots(spark, sf_dir):
    """Turns at which a user's text goes from even to odd length or back, with what was said."""
    parity = F.when(F.length("text") % 2 == 0, "even").otherwise("odd")
    frames = F.array(F.struct(F.lit("chat").alias("service"), F.create_map(F.lit("parity"), F.array(parity)).alias("slot_values")))
    c = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.col("role").alias("speaker"), F.col("text").alias("utterance"), frames.alias("frames"))
    made = structured.dialogue_slots(c, "conv_id", "user")
    return made.select("conv_id", "turn", F.col("values")[0].alias("value"), F.sha1(F.col("history").cast("binary")).alias("history"))


def a_conflicts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.to_date("ts").cast("string").alias("day"), (F.col("value") > 90).alias("high"))
    return structured.without_conflicts(e.withColumn("q", F.concat_ws(":", "user_id", "day")), "q", "day", "high").select("event_id")


def a_votes(spark, sf_dir):
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    o = table(spark, sf_dir, "orders").select("o_custkey", F.array("o_orderpriority").alias("answers"))
    made = structured.pooled_votes(o, "o_custkey", "answers", names)
    return made.select("o_custkey", "n", "top", *[F.round(F.col("shares")[i], 6).alias(f"share_{i}") for i in range(len(names))])


def x_kinds(spark, sf_dir):
    own = predictions(spark, sf_dir).withColumns({"topic": F.right("dataset", F.lit(1)), "benchmark": F.col("dataset").isin("src0", "src1", "src2", "src3")})
    return _rounded(metrics.by_kind(own, "topic", "benchmark"), "accuracy", "nll", "ece")


def x_losses(spark, sf_dir):
    p = metrics.answered(F.col("probs"), F.size("label"))
    own = predictions(spark, sf_dir).withColumn("p", p)
    made = own.groupBy("dataset").agg(F.avg(metrics.focal(F.col("p"), F.col("label"))).alias("focal"), F.avg(metrics.proper_score(F.col("p"), F.col("label"), 0.5)).alias("proper"))
    return _rounded(made, "focal", "proper")


def x_advantage(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("value").alias("reward"))
    return _rounded(metrics.advantage(e, "event_type").select("event_id", "advantage"), "advantage")


def x_chosen(spark, sf_dir):
    """Generated answers as one-hot shares of five options."""
    e = table(spark, sf_dir, "events")
    said = F.concat(F.lit("The answer is "), (F.col("event_id") % 7).cast("string"))
    return e.select("event_id", _label(metrics.chosen(row.answer_number(said), F.lit(5))).alias("probs"))


def x_yes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    options = F.when(F.col("event_id") % 2 == 0, row.options_of(["yes", "no"])).otherwise(row.options_of(["no", "yes"], ["Нет", "Да"]))
    probs = metrics.renormalised(F.array(F.when(F.col("event_id") % 5 == 0, 0.0).otherwise(1.0), F.when(F.col("event_id") % 5 == 0, 0.0).otherwise((F.col("event_id") % 4).cast("double"))))
    return _rounded(e.select("event_id", metrics.yes_probability(options, probs).alias("p")), "p")


def x_best_step(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.round("value", 0).alias("nll"))
    return metrics.best_step(e)


def l_rate(spark, sf_dir):
    return _rounded(table(spark, sf_dir, "part").select("p_partkey", augment.learning_rate(F.col("p_partkey"), 20, 150).alias("rate")), "rate")


def l_reordered(spark, sf_dir):
    made = augment.reordered(lang_samples(spark, sf_dir), F.col("pos").cast("string"))
    return made.select(F.col("pos").alias("doc_id"), _texts(F.col("options")).alias("options"), _label(F.col("label")).alias("label"))


def l_none(spark, sf_dir):
    made = augment.without_answer(lang_samples(spark, sf_dir), F.col("pos").cast("string"), 0.25)
    return made.select(F.col("pos").alias("doc_id"), _texts(F.col("options")).alias("options"))


def l_fewer(spark, sf_dir):
    made = augment.fewer_options(lang_samples(spark, sf_dir), F.col("pos").cast("string"), 0.5)
    return made.select(F.col("pos").alias("doc_id"), _texts(F.col("options")).alias("options"), _label(F.col("label")).alias("label"))


def l_drawn(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select(F.col("lang").alias("dataset"), "doc_id")
    return augment.drawn(own, "doc_id", 2048)


QUERIES = {f.__name__: f for f in (
    u_sentences, u_marked, u_lettered, u_normalized, u_readable, u_window, u_tagged, u_table, c_cells, c_evidence, c_relations, w_values, w_slots, a_conflicts, a_votes,
    x_kinds, x_losses, x_advantage, x_chosen, x_yes, x_best_step, l_rate, l_reordered, l_none, l_fewer, l_drawn)}

_B = SQL_BUCKET.format
_ORDER = """with l as (select l_orderkey, cast(l_linenumber as varchar) a, cast(l_partkey as varchar) b, 'f' || l_returnflag c, l_linenumber ln from lineitem),
t as (select l_orderkey, count(*) m, case when count(distinct c) = count(*) then 2 when count(distinct a) = count(*) then 0 when count(distinct b) = count(*) then 1 end as key, string_agg(a || ' | ' || b || ' | ' || c, chr(10) order by ln, b, c) body from l group by 1 having count(*) between 2 and 39)"""

SQL = {
    "c_evidence": r"""with e as (select doc_id, sha1(text || 'Where is it said?') seed, w[10] a, length(array_to_string(w[1:9], ' ')) + 1 s, string_split(regexp_replace(text, '([.!?])(\s+)([А-ЯЁA-Z0-9])|(\n+)', '\1\2\4' || chr(1) || '\3', 'g'), chr(1)) f
from (select doc_id, text, string_split(text, ' ') w from documents) where len(w) >= 10 and trim(w[10]) <> ''),
p as (select doc_id, s, a, unnest(f) part, unnest(range(len(f))) i from e), q as (select *, regexp_replace(part, '^\s+|\s+$', '', 'g') t, sum(length(part)) over (partition by doc_id order by i) till from p),
r as (select doc_id, arg_min(t, i) t from q where s >= till - length(part) and s + length(a) <= till group by 1), o as (select doc_id, t, min(i) i from q where t <> '' and not contains(lower(t), lower(trim(a))) group by 1, 2),
n as (select doc_id, t, row_number() over (partition by doc_id order by i) - 1 k from o), x as (select doc_id, t, row_number() over (partition by doc_id order by sha1(seed || ':' || k), k) j from n join e using (doc_id)),
c as (select doc_id, t, j from x where j <= 20 union all select doc_id, t, 0 from r), b as (select doc_id, t, j, row_number() over (partition by doc_id order by sha1('options:' || seed || ':' || j), j) place, count(*) over (partition by doc_id) n from c join e using (doc_id))
select doc_id, n, cast(place as int) place, t answer from b where j = 0 and n > 1""",
    "l_fewer": f"""with o as (select doc_id, lang, unnest([0, 1, 2, 3]) i, unnest(['de', 'en', 'es', 'fr']) v from documents), w as (select *, row_number() over (partition by doc_id order by i) - 1 j from o where v <> lang),
n as (select *, row_number() over (partition by doc_id order by sha1('count:' || doc_id || ':' || j), j) n from w), gone as (select doc_id, i from n where {_B("'drop:' || doc_id", 1000000)} < 500000 and n <= {_B("'gone:' || doc_id", 1000003)} % 2 + 1)
select doc_id, string_agg(v, '|' order by i) as options, string_agg(case when v = lang then '1.0000' else '0.0000' end, '|' order by i) as label from o anti join gone using (doc_id, i) group by 1""",
    "l_drawn": f"""with s as (select lang dataset, doc_id, {_B("'share:' || doc_id", 256)} share from documents), p as (select *, row_number() over (partition by dataset, share order by doc_id) place from s), z as (select dataset, share, count(*) n from s group by 1, 2),
w as (select *, sum(n / total * pow(total, 0.5)) over (order by dataset, share) upto from (select *, sum(n) over (partition by dataset) total from z)), h as (select *, upto / max(upto) over () high from w),
e as (select *, coalesce(lag(high) over (order by dataset, share), 0) low from h), d as (select {_B("'draw:0:' || id", 1 << 30)} / {1 << 30}::double u, {_B("'place:0:' || id", 1 << 30)} spot from (select unnest(range(2048)) id))
select dataset, doc_id, draws from p join (select dataset, share, spot % n + 1 place, count(*) draws from d join e on u >= low and u < high group by all) using (dataset, share, place)""",
    "u_sentences": r"""with f as (select doc_id, text, string_split(regexp_replace(text, '([.!?])(\s+)([А-ЯЁA-Z0-9])|(\n+)', '\1\2\4' || chr(1) || '\3', 'g'), chr(1)) f from documents where text is not null)
select doc_id, len(f) n, length(text) last_end, sha1(array_to_string(list_transform(f, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), '|')) texts from f""",
    "u_marked": "select p_partkey, case when p_partkey % 5 = 0 then '' else 'brand=' || p_brand || '|kind=' || p_type end spans from part",
    "u_lettered": "select p_partkey, 'A=' || p_brand || '|B=' || p_type || '|C=' || p_name as options from part",
    "u_normalized": """with e as (select event_id, event_id % 12 + 1 h, event_id % 60 m from events) select event_id, case event_id % 4 when 0 then printf('time:%02d:%02d', h % 12 + 12, m) when 1 then printf('time:%02d:00', h % 12)
when 2 then printf('time:%02d:%02d', h, m) else printf('citycentergate2%02d', m) end as value, event_id % 3 <> 0 usable from e""",
    "u_readable": "select p_partkey, p_type as name from part",
    "u_window": "select doc_id, substring(text, greatest(doc_id % 700 - 300, 0) + 1, doc_id % 700 + 309 - greatest(doc_id % 700 - 300, 0)) passage from documents where text is not null",
    "u_tagged": r"""select doc_id, concat_ws('|', case when regexp_matches(text, '[0-9]') then 'digit' end, case when contains(text, '?') then 'question' end, case when contains(text, '@') then 'mail' end) tags from documents where text is not null""",
    "u_table": _ORDER + " select l_orderkey, key, 'Table: order' || chr(10) || 'line | part | flag' || chr(10) || body as text from t",
    "c_cells": _ORDER + """, p as (select l.l_orderkey, key, ln, row_number() over (partition by l.l_orderkey order by ln, b, c) - 1 i, [a, b, c] v from l join t using (l_orderkey)),
q as (select *, unnest([0, 1, 2]) j from p), r as (select *, row_number() over (partition by l_orderkey order by i, j) - 1 place from q where j <> key),
s as (select *, row_number() over (partition by l_orderkey order by sha1(l_orderkey || ':' || place), place) n from r)
select s.l_orderkey, s.i as row, j as column, ['line', 'part', 'flag'][j + 1] header, ['line', 'part', 'flag'][s.key + 1] key_header, s.v[s.key + 1] as name, s.v[j + 1] answer,
(select string_agg(p.v[s.j + 1], '|' order by p.i) from p where p.l_orderkey = s.l_orderkey and p.i <> s.i) others from s where n <= 3""",
    "c_relations": "select s_suppkey, 'SELLS_IN' kind, s_name subject, n_name as object, r_name others from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey",
    "w_values": """with e as (select *, cast(props->>'k' as int) % 3 k from events), c as (select event_id, k, lag(k) over (partition by user_id, event_type order by ts, event_id) l from e where k <> 0)
select event_id, 'v' || k as value from c where l is null or l <> k""",
    "w_slots": """with c as (select *, string_agg(role || ': ' || text, chr(10)) over (partition by conv_id order by turn rows unbounded preceding) h, case when length(text) % 2 = 0 then 'even' else 'odd' end v from conversations where text is not null),
u as (select *, lag(v) over (partition by conv_id order by turn) l from c where role = 'user') select conv_id, turn, v as value, sha1(h) history from u where l is null or l <> v""",
    "a_conflicts": """with e as (select event_id, user_id || ':' || cast(ts as date) q, value > 90 high from events) select event_id from e where q not in (select q from e group by q having count(distinct high) > 1)""",
    "a_votes": """with v as (select o_custkey, o_orderpriority p, count(*) m from orders group by 1, 2) select o_custkey, cast(sum(m) as bigint) n, arg_max(p, m * 10 - cast(p[1] as int)) top, """ + ", ".join(f"round(coalesce(sum(m) filter (p[1] = '{i + 1}'), 0) / sum(m), 6) share_{i}" for i in range(5)) + " from v group by 1",
    "x_kinds": scored_sql("""select unnest([{'kind': 'all', 'value': 'all'}, {'kind': 'topic', 'value': right(dataset, 1)}, {'kind': 'benchmark', 'value': case when dataset in ('src0', 'src1', 'src2', 'src3') then 'true' else 'false' end}]) k, * from d""", "k")
    + " select k.kind as kind, k.value as value, count(*) datasets, cast(sum(n) as bigint) n, round(avg(accuracy), 6) accuracy, round(avg(nll), 6) nll, round(avg(ece), 6) ece from k group by 1, 2",
    "x_losses": scored_sql("select dataset, p[gold] g, sqrt(list_sum(list_transform(p, lambda x: x * x))) norm from q", "k") + " select dataset, round(avg(-pow(1 - g, 2) * ln(g)), 6) focal, round(avg(ln(greatest(g, 0.0001)) + 0.5 * g / norm), 6) proper from k group by 1",
    "x_advantage": "select event_id, round((value - avg(value) over w) / (stddev_samp(value) over w + 0.000001), 6) advantage from events window w as (partition by event_type)",
    "x_chosen": "select event_id, case when event_id % 7 between 1 and 5 then array_to_string(list_transform([1, 2, 3, 4, 5], lambda i: case when i = event_id % 7 then '1.0000' else '0.0000' end), '|') end probs from events",
    "x_yes": "select event_id, round(case when event_id % 5 = 0 then 0.5 when event_id % 2 = 0 then 1.0 / (1 + event_id % 4) else (event_id % 4) / (1.0 + event_id % 4) end, 6) p from events",
    "x_best_step": "select user_id run, min(step) step, min(m) nll from (select user_id, event_id step, round(value, 0) v, min(round(value, 0)) over (partition by user_id) m from events) where v = m group by 1",
    "l_rate": "select p_partkey, round(case when p_partkey < 20 then (p_partkey + 1) / 20.0::double else 0.5 * (1 + cos(least(1.0::double, (p_partkey - 20) / 130.0::double) * pi())) end, 6) rate from part",
    "l_reordered": """select doc_id, string_agg(v, '|' order by sha1(doc_id || ':' || i), i) as options, string_agg(case when v = lang then '1.0000' else '0.0000' end, '|' order by sha1(doc_id || ':' || i), i) as label
from (select doc_id, lang, unnest([0, 1, 2, 3]) i, unnest(['de', 'en', 'es', 'fr']) v from documents) group by 1""",
    "l_none": f"select doc_id, array_to_string(list_transform(['de', 'en', 'es', 'fr'], lambda x: case when x = lang and {_B(chr(39) + 'none:' + chr(39) + ' || doc_id', 1000000)} < 250000 then 'None of the above' else x end), '|') as options from documents",
}
