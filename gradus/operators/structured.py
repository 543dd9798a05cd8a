"""Samples from annotated texts, tables and dialogues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.functions import parse, row


def evidence(df: DataFrame, context: Column, question: Column, spans: Column, most: int = row.MAX_DISTRACTORS) -> DataFrame:
    """``df`` with texts and place: the first sentence that holds one of the answer spans ARRAY<STRUCT<start, text>> among sentences of the
    same text that hold no answer, in seeded order. Spans that the text does not have at their place are left out; rows without a good span,
    a question, a sentence around an answer, or any other sentence are dropped."""
    good = F.filter(spans, lambda s: (F.trim(s["text"]) != "") & (s["start"] >= 0) & (F.substring(context, s["start"] + 1, F.length(s["text"])) == s["text"]))
    seed = row.sha1(F.concat(context, question))  # short, as it is hashed again for every sentence

    def picked(r: Column) -> Column:
        told = F.filter(r["parts"], lambda f: F.exists(r["spans"], lambda s: parse.holds_span(f, s["start"], s["text"])))
        answers = F.transform(r["spans"], lambda s: F.lower(F.trim(s["text"])))
        others = row.bound(answers, lambda own: F.filter(r["parts"], lambda f: (f["text"] != "") & ~row.bound(F.lower(f["text"]), lambda t: F.exists(own, lambda a: F.contains(t, a)))))
        wrong = row.shuffled(F.array_distinct(F.transform(others, lambda f: f["text"])), r["seed"])
        return F.struct(F.get(F.transform(told, lambda f: f["text"]), F.lit(0)).alias("right"), F.slice(wrong, 1, most).alias("wrong"), r["seed"].alias("seed"))

    # one array of at most one struct, exploded: what is kept is told without computing it twice
    made = F.transform(F.array(F.struct(good.alias("spans"), parse.fragments(context).alias("parts"), seed.alias("seed"))), picked)
    found = df.where(F.trim(question) != "").select("*", F.explode(F.filter(made, lambda x: x["right"].isNotNull() & (F.size(x["wrong"]) > 0))).alias("e_found"))
    texts = row.shuffled(F.concat(F.array("e_found.right"), F.col("e_found.wrong")), F.concat(F.lit("options:"), F.col("e_found.seed")))
    return found.withColumn("texts", texts).withColumn("place", F.array_position("texts", F.col("e_found.right")).cast("int")).drop("e_found")


def table_cells(df: DataFrame, table_id: str, table: Column, most: int = 3, longest: int = 200) -> DataFrame:
    """Rows (table_id, row, column, header, key_header, name, answer, others): up to ``most`` cells of each plain table, in seeded order, that
    its key column names; others are the column's cells in other rows."""
    cell = lambda line, j: F.element_at(line, j + 1)

    def asked(x: Column) -> Column:
        rows, headers, key = x["plain"]["rows"], x["plain"]["headers"], x["key"]
        places = F.flatten(F.transform(rows, lambda line, i: F.transform(line, lambda v, j: F.struct(i.alias("row"), j.alias("column"), v.alias("answer")))))
        fine = F.filter(places, lambda c: (c["column"] != key) & (c["answer"] != "") & (F.length(c["answer"]) <= longest))

        def told(c: Column) -> Column:
            r, j = c["row"], c["column"]
            others = F.filter(F.transform(F.filter(rows, lambda line, i: i != r), lambda line: cell(line, j)), lambda v: F.length(v) <= longest)
            return F.struct(r.alias("row"), j.alias("column"), cell(headers, j).alias("header"), cell(headers, key).alias("key_header"), cell(F.element_at(rows, r + 1), key).alias("name"), c["answer"].alias("answer"), others.alias("others"))

        return F.transform(F.slice(row.shuffled(fine, F.col(table_id).cast("string")), 1, most), told)

    # one array of at most one table, exploded when only its cells are left: nothing is computed twice, and no row holds the table again
    keyed = F.transform(F.filter(F.array(parse.plain_table(table)), lambda t: t.isNotNull()), lambda t: F.struct(t.alias("plain"), parse.key_column(t).alias("key")))
    made = F.flatten(F.transform(F.filter(keyed, lambda x: x["key"].isNotNull()), asked))
    return df.select(table_id, F.explode(made).alias("c")).select(table_id, "c.*")


def current_values(rows: DataFrame, keys: Sequence[str], order: Sequence[str], values: str) -> DataFrame:
    """The rows at which the usable values of a key differ from those before; ``values`` is ARRAY<STRING>, unusable ones are taken out first
    and rows without any skipped, so that they do not count as a change."""
    own = Window.partitionBy(*keys).orderBy(*order)
    kept = rows.withColumn(values, F.filter(values, parse.usable)).where(F.size(values) > 0)
    return kept.withColumn("v_last", F.lag(values).over(own)).where(~F.col(values).eqNullSafe(F.col("v_last"))).drop("v_last")


def dialogue_slots(turns: DataFrame, dialogue: str = "dialogue", user: str = "USER") -> DataFrame:
    """From (dialogue, turn, speaker, utterance, frames ARRAY<STRUCT<service, slot_values MAP<STRING, ARRAY<STRING>>>>): rows (dialogue, turn,
    service, slot, values, history), one where a user's value changes; history is what was said up to and with that turn."""
    lines = turns.groupBy(dialogue).agg(F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "speaker", "utterance").alias("line")))).alias("s_lines"))
    slots = turns.where(F.col("speaker") == user).select(dialogue, "turn", F.explode("frames").alias("f")).select(dialogue, "turn", F.col("f.service").alias("service"), F.explode("f.slot_values").alias("slot", "values"))
    changed = current_values(slots, (dialogue, "service", "slot"), ("turn",), "values")
    # a dialogue's lines are listed once; a history is cut from them only where something changes
    past = F.transform(F.filter("s_lines", lambda x: x["turn"] <= F.col("turn")), lambda x: x["line"])
    return changed.join(lines, dialogue).withColumn("history", F.array_join(past, "\n")).drop("s_lines")


def unique_objects(docs: DataFrame, doc_id: str, text: str, annotations: str, kinds: Sequence[str], alias_kinds: Sequence[str] = ()) -> DataFrame:
    """Rows (doc_id, kind, subject, object, others): relations whose subject has one object in the document, up to case, both in one
    sentence and not overlapping; others are texts of entities of the object's kind that neither name it, nor an alias of it, nor the
    subject. Of several mentions the first in the file stands."""
    parsed = docs.withColumns({"r_ents": parse.entities(F.col(text), F.col(annotations)), "r_rels": parse.relations(F.col(annotations), [*kinds, *alias_kinds])})
    parsed = parsed.withColumns({
        "r_by": F.map_from_entries(F.transform("r_ents", lambda e: F.struct(e["id"], e))),
        "r_same": parse.alias_groups(F.transform("r_ents", lambda e: e["id"]), F.filter("r_rels", lambda r: r["kind"].isin(*alias_kinds) if alias_kinds else F.lit(False)))})
    flat = parsed.select(doc_id, text, "r_ents", "r_by", "r_same", F.posexplode("r_rels").alias("r_at", "r")).where(F.col("r.kind").isin(*kinds))
    flat = flat.withColumns({"s": F.try_element_at("r_by", F.col("r.subject")), "o": F.try_element_at("r_by", F.col("r.object"))}).where("s is not null and o is not null")
    own = Window.partitionBy(doc_id, "r.kind", F.lower("s.text"))
    apart = (F.col("s.start") >= F.col("o.end")) | (F.col("o.start") >= F.col("s.end"))
    low, high = F.least("s.start", "o.start"), F.greatest("s.end", "o.end")
    fine = apart & ~F.substring(F.col(text), low + 1, high - low).rlike(r"[.!?]\s|\n")
    one = flat.withColumn("r_n", F.size(F.collect_set(F.lower("o.text")).over(own))).withColumn("r_fine", fine).where("r_n = 1 and r_fine")
    one = one.withColumn("r_copy", F.row_number().over(own.orderBy("r_at"))).where("r_copy = 1")
    group = F.get(F.filter("r_same", lambda g: F.array_contains(g, F.col("o.id"))), F.lit(0))
    names = F.transform(F.filter("r_ents", lambda e: F.array_contains("r_group", e["id"])), lambda e: F.lower(e["text"]))
    one = one.withColumn("r_group", group).withColumn("r_names", F.array_union(names, F.array(F.lower("o.text"))))
    other = F.filter("r_ents", lambda e: (e["kind"] == F.col("o.kind")) & (F.lower(e["text"]) != F.lower("s.text")) & ((e["start"] >= F.col("o.end")) | (F.col("o.start") >= e["end"]))
                     & ~F.exists("r_names", lambda v: F.contains(v, F.lower(e["text"])) | F.contains(F.lower(e["text"]), v)))
    return one.select(doc_id, F.col("r.kind").alias("kind"), F.col("s.text").alias("subject"), F.col("o.text").alias("object"), F.array_distinct(F.transform(other, lambda e: e["text"])).alias("others"))


def without_conflicts(rows: DataFrame, query: str, text: str, label: str) -> DataFrame:
    """Drops every query that has one text under two labels."""
    torn = rows.groupBy(query, text).agg(F.min(label).alias("lo"), F.max(label).alias("hi")).where("lo <> hi").select(query).distinct()
    return rows.join(torn, query, "left_anti")


def pooled_votes(rows: DataFrame, item: str, answers: str, names: Sequence[str]) -> DataFrame:
    """Rows (item, n, top, shares): answers ARRAY<STRING> of all copies of an item counted together; of equal counts the first name is top."""
    per = rows.select(item, F.explode(answers).alias("a")).where(F.col("a").isin(*names)).groupBy(item, "a").agg(F.count("*").alias("n"))
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("a"))
    by = per.groupBy(item).agg(F.sum("n").alias("n"), F.max_by("a", F.struct("n", -place)).alias("top"), F.map_from_entries(F.collect_list(F.struct("a", "n"))).alias("by"))
    return by.select(item, "n", "top", F.array(*[F.coalesce(F.try_element_at("by", F.lit(x)), F.lit(0)) / F.col("n") for x in names]).alias("shares"))
