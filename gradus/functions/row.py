"""Scalar and row-level operators as Column functions: deterministic from content, without Python workers but for one.

Where the original draws with a seeded generator, the draw here is an order by the SHA-1 of seed and item: as deterministic, salted alike so
that streams are independent, and the same in any SQL engine, but another permutation. :func:`generator_shuffled` alone gives the generator's own.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPTION = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType())])
#: The sample row that every builder gives.
SAMPLE = ("dataset", "split", "pos", "state", "question", "options", "label", "group", "type")
#: Most wrong options beside the right one.
MAX_DISTRACTORS = 20
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def sha1(text: Column) -> Column:
    return F.sha1(text.cast("binary"))


def bucket(key: Column, n: int = 100) -> Column:
    """First 64 bits of the key's SHA-1, big endian, modulo ``n``."""
    return (F.conv(F.substring(sha1(key), 1, 16), 16, 10).cast("decimal(20,0)") % n).cast("int")


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a variable that holds ``value``: inside it the value is read, not computed again for every item of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shuffled(items: Column, seed: Column) -> Column:
    """The items in the order of SHA-1(seed:place)."""
    def by(s: Column) -> Column:
        keyed = F.transform(items, lambda v, i: F.struct(sha1(F.concat(s, F.lit(":"), i.cast("string"))).alias("k"), i.alias("i"), v.alias("v")))
        return F.transform(F.sort_array(keyed), lambda t: t["v"])  # sort_array compares without a lambda, which array_sort calls for each pair

    return bound(seed, by)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _drawn_places(seeds: pd.Series, sizes: pd.Series) -> pd.Series:
    def places(seed: str, n: int) -> list[int]:
        out = list(range(n))
        random.Random(seed).shuffle(out)
        return out

    return pd.Series([None if s is None or pd.isna(n) else places(s, int(n)) for s, n in zip(seeds, sizes)], dtype=object)


def generator_shuffled(items: Column, seed: Column) -> Column:
    """The items in the order that Python's generator of this string seed gives them, for runs that have to repeat earlier ones exactly. Only
    seeds and sizes go to Python, Arrow batches at a time. A null seed or array gives null."""
    return F.transform(_drawn_places(seed, F.when(items.isNotNull(), F.size(items))), lambda i: F.get(items, i))


def pick(versions: str | Sequence[str], seed: Column, salt: str = "question") -> Column:
    """One of the phrasings, by salted seed; a single one that is given as a text."""
    if isinstance(versions, str):
        return F.lit(versions)
    return F.element_at(F.array(*[F.lit(v) for v in versions]), bucket(F.concat(F.lit(f"{salt}:"), seed), len(versions)) + 1)


def options_of(ids: Sequence[str], texts: Sequence[str] | None = None) -> Column:
    texts = ids if texts is None else texts
    if len(ids) != len(texts):
        raise ValueError("as many ids as texts")
    return F.array(*[F.struct(F.lit(i).alias("id"), F.lit(t).alias("text")) for i, t in zip(ids, texts)])


def lettered(texts: Column) -> Column:
    """Options with the ids A, B, ... by place."""
    return F.transform(texts, lambda t, i: F.struct(F.substring(F.lit(LETTERS), i + 1, F.lit(1)).alias("id"), t.alias("text")))


def one_hot(options: Column, answer: Column) -> Column:
    """1.0 for each option of the id ``answer``; an id that no option has raises an error."""
    label = F.transform(options, lambda o: F.when(o["id"] == answer, 1.0).otherwise(0.0).cast("float"))
    return F.when(F.exists(options, lambda o: o["id"] == answer), label).otherwise(F.raise_error(F.concat(F.lit("no such option: "), answer)).cast("array<float>"))


def distribution(options: Column, label: Column) -> Column:
    """A soft label as it is given; an array of another length than the options raises an error."""
    told = F.concat(F.lit("as many shares as options: "), F.size(label).cast("string"), F.lit(" for "), F.size(options).cast("string"))
    return F.when(F.size(options) == F.size(label), F.transform(label, lambda p: p.cast("float"))).otherwise(F.raise_error(told).cast("array<float>"))


def group_key(group: Column, state: Column, question: Column) -> Column:
    """The group, or what stands for it: an empty string counts as missing."""
    return F.coalesce(F.nullif(group, F.lit("")), sha1(F.coalesce(F.nullif(state, F.lit("")), question)))


def held_out_key(group: Column, state: Column, question: Column) -> Column:
    return F.coalesce(F.nullif(group, F.lit("")), F.nullif(state, F.lit("")), question)


def with_context(about: Column, text: Column, name: str = "", answers: dict[str, str] | None = None) -> Column:
    """The parts that are not empty, with a blank line between: what it is about, the answers and their meanings, the named text."""
    listed = "Answers:\n" + "\n".join(f"- {a}: {m}" for a, m in answers.items()) if answers else None
    named = F.when(text != "", F.concat(F.lit(f"{name}:\n"), text)) if name else F.nullif(text, F.lit(""))
    return F.concat_ws("\n\n", F.nullif(about, F.lit("")), F.lit(listed), named)


def kind(options: Column) -> Column:
    """noul for the two options yes and no (English or Russian), else choice."""
    texts = F.array_join(F.sort_array(F.transform(options, lambda o: F.lower(F.trim(o["text"])))), "|")
    return F.when((F.size(options) <= 2) & texts.isin("no|yes", "да|нет"), "noul").otherwise("choice")


def without_parenthesis(title: Column) -> Column:
    return F.regexp_replace(title, r"\s*\([^)]*\)$", "")


def single_spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def split_camel(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, "(?<=[a-z])(?=[A-Z])", " "))


def escaped_marks(text: Column) -> Column:
    """<|name|> becomes <¦name¦>, so that no text holds a delimiter."""
    return F.regexp_replace(text, r"<\|(\w+)\|>", "<¦$1¦>")


def mentions(text: Column, value: Column) -> Column:
    """How often ``value`` stands in ``text`` as a whole word, in either case."""
    return F.regexp_count(text, F.concat(F.lit(r"(?iU)(?<!\w)\Q"), value, F.lit(r"\E(?!\w)")))


def visible(value: Column, history: Column) -> Column:
    """Whether ``value`` was said in ``history`` as whole words, in either case; centre and center are one spelling."""
    alike = lambda x: F.replace(F.lower(x), F.lit("centre"), F.lit("center"))
    return mentions(alike(history), alike(value)) > 0


def answer_number(text: Column) -> Column:
    """The number that an answer starts with, or that follows "answer is"; null without one."""
    first, said = F.regexp_extract(text, r"^\s*\(?(\d+)", 1), F.regexp_extract(F.lower(text), r"answer is\s*\(?(\d+)", 1)
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(said, F.lit(""))).try_cast("int")


def middle_cut(tokens: Column, keep: Column, mark: str = "…") -> Column:
    """Tokens beyond ``keep`` are cut from the middle, a mark in their place."""
    head = (keep / 2).cast("int")
    cut = F.concat(F.slice(tokens, F.lit(1), head), F.array(F.lit(mark)), F.slice(tokens, F.size(tokens) - (keep - head) + 1, keep - head))
    return F.when(F.size(tokens) <= keep, tokens).otherwise(cut)


def spans_of_tags(tokens: Column, tags: Column, whole: bool = False) -> Column:
    """BIO tags to ARRAY<STRUCT<kind, text>>: B- opens a span, I- of its kind goes on, any other I- is dropped. With ``whole`` such an I-, or
    another number of tags than of tokens, leaves no span at all."""
    none = F.array().cast("array<struct<kind:string,text:string>>")
    start = F.struct(none.alias("done"), F.lit("").alias("kind"), F.lit("").alias("text"), F.lit(False).alias("torn"))

    def closed(acc: Column) -> Column:
        return F.when(acc["text"] != "", F.concat(acc["done"], F.array(F.struct(acc["kind"].alias("kind"), acc["text"].alias("text"))))).otherwise(acc["done"])

    def step(acc: Column, x: Column) -> Column:
        name = F.substring(x["tag"], 3, 1000)
        inner = F.left(x["tag"], F.lit(2)) == "I-"
        goes_on = inner & (name == acc["kind"]) & (acc["text"] != "")
        opened = F.struct(closed(acc).alias("done"), name.alias("kind"), x["token"].alias("text"), acc["torn"].alias("torn"))
        longer = F.struct(acc["done"].alias("done"), acc["kind"].alias("kind"), F.concat(acc["text"], F.lit(" "), x["token"]).alias("text"), acc["torn"].alias("torn"))
        ended = F.struct(closed(acc).alias("done"), F.lit("").alias("kind"), F.lit("").alias("text"), (acc["torn"] | inner).alias("torn"))
        return F.when(F.left(x["tag"], F.lit(2)) == "B-", opened).when(goes_on, longer).otherwise(ended)

    def finished(acc: Column) -> Column:
        return F.when(acc["torn"] | (F.size(tokens) != F.size(tags)), none).otherwise(closed(acc)) if whole else closed(acc)

    return F.aggregate(F.arrays_zip(tokens.alias("token"), tags.alias("tag")), start, step, finished)
