"""Questions, prompts and answers: composed from templates, cut to a budget of tokens, scored by a baseline, shaped as answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradus.functions import row
from gradus.operators.metrics import first_max

#: The query of a prompt, what stands for a cut, and the least number of tokens that a cut leaves.
QUERY, CUT, LEAST = "Question: {question}\nOptions:\n{options}\nAnswer:", "\n...\n", 16

#: What stands between words.
APART = r"[^\p{L}\p{N}]+"


def filled(template: Column, **values: Column) -> Column:
    """The template with each {name} replaced by the value of that name."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def composed(label: str, text: Column, phrasings: Sequence[str], seed: Column, **values: Column) -> Column:
    """A labelled text and, on the next line, one of the phrasings, picked by ``seed`` and filled with ``values``."""
    return F.concat(F.lit(f"{label}: "), text, F.lit("\n"), filled(row.pick(phrasings, seed), **values))


def rendered(value: Column) -> Column:
    """A struct, map or array as indented JSON."""
    return F.to_json(value, {"pretty": "true"})


def numbered(texts: Column, mark: str = ")") -> Column:
    return F.array_join(F.transform(texts, lambda t, i: F.concat((i + 1).cast("string"), F.lit(f"{mark} "), t)), "\n")


def query_text(question: Column, texts: Column) -> Column:
    return filled(F.lit(QUERY), options=numbered(texts), question=question)


def prompt(context: Column, query: Column, budget: int, cut: Sequence[str] = (CUT,), least: int = LEAST) -> Column:
    """Tokens of a context and a query within ``budget``: the query stays whole, a longer context loses its middle to ``cut``. Null if the query
    alone is too long or fewer than ``least`` tokens of a cut context would stay."""
    room = F.lit(budget) - F.size(query)
    keep = room - len(cut)
    head = F.floor(keep / 2).cast("int")
    shorter = F.concat(F.slice(context, F.lit(1), head), F.array(*[F.lit(c) for c in cut]), F.slice(context, F.size(context) - (keep - head) + 1, keep - head))
    return F.when(F.size(context) <= room, F.concat(context, query)).when(keep >= least, F.concat(shorter, query))


def keys_of(texts: Column) -> Column:
    """The texts as keys if none is blank and all differ, else their numbers from 1."""
    plain = (F.size(F.array_distinct(texts)) == F.size(texts)) & F.forall(texts, lambda t: F.trim(t) != "")
    return F.when(plain, texts).otherwise(F.transform(texts, lambda t, i: (i + 1).cast("string")))


def criteria_texts(criteria: Column) -> Column:
    """Option texts of ARRAY<STRUCT<key, text>>: "key: text", or the key where there is no text. A null is a yes/no question; one criterion or
    none raises an error."""
    texts = F.transform(criteria, lambda c: F.when(F.coalesce(c["text"], F.lit("")) != "", F.concat(c["key"], F.lit(": "), c["text"])).otherwise(c["key"]))
    few = F.raise_error(F.lit("a choice needs at least 2 criteria")).cast("array<string>")
    return F.when(criteria.isNull(), F.array(F.lit("yes"), F.lit("no"))).when(F.size(criteria) < 2, few).otherwise(texts)


def shaped(criteria: Column, probs: Column) -> Column:
    """STRUCT<noul, choice, confidence, probabilities>: P(yes) of a yes/no question; of a choice the key of the first highest probability, that
    probability, and all by key."""
    keys = F.transform(criteria, lambda c: c["key"])
    noul = criteria.isNull()
    return F.struct(
        F.when(noul, F.get(probs, F.lit(0))).alias("noul"), F.when(~noul, F.element_at(keys, first_max(probs).cast("int"))).alias("choice"),
        F.when(~noul, F.array_max(probs)).alias("confidence"), F.when(~noul, F.map_from_arrays(keys, probs)).alias("probabilities"))


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), APART), lambda w: w != ""))


def overlap_probs(state: Column, texts: Column) -> Column:
    """The baseline scorer: an option's share is 1 and the number of its different words that the state has."""
    asked = F.transform(texts, words)
    # a state's words are looked through once, for all options
    common = lambda ts: row.bound(F.array_intersect(F.flatten(F.filter(ts, lambda t: t.isNotNull())), F.split(F.lower(state), APART)), lambda own: F.transform(ts, lambda t: F.size(F.array_intersect(t, own)) + F.lit(1.0)))
    raw = row.bound(asked, common)
    # what a lambda needs is bound: inside it, it would be computed again for every option
    shares = lambda r: row.bound(F.aggregate(r, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(r, lambda x: x / total))
    return row.bound(raw, shares)


def logits(query: Column, keys: Column, scale: float, there: Column) -> Column:
    """Scaled inner products of a query vector and each key vector; minus infinity where ``there`` is false."""
    dot = lambda k: F.aggregate(F.zip_with(query, k, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(keys, there, lambda k, t: F.when(t, dot(k) * scale).otherwise(float("-inf")))
