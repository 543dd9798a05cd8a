"""Datasets as specifications: what a source's rows become, in SQL expressions, compiled to one plan for any number of datasets.

A specification is plain values, so that it can stand in a JSON file. It names its sources, the rows that count and what is made first of them, the state, the questions,
and one of the ways in which options and labels come about (``KINDS``). All datasets of a build are sample rows of one frame, which is
regrouped, capped and saved at once.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.functions import row
from gradus.operators import builders, rings, splits
from gradus.operators.questions import filled

#: Steps by name that make other rows of a source's rows, for what no expression says.
PREPARED: dict[str, Callable[[DataFrame], DataFrame]] = {}


def step(name: str) -> Callable:
    """Puts a step in ``PREPARED``."""
    def put(made: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        PREPARED[name] = made
        return made

    return put


@dataclass(frozen=True)
class Spec:
    """``name`` of the dataset and, as SQL expressions over its rows:

    source: tables that are put together, columns that one lacks are null. joined: (table, columns) that each row has one row of. prepared: the name of a
    step in ``PREPARED``. where: the rows that count. once: columns of which the first row by ``pos`` counts. each: an array; a row becomes one for each item, ``each``.
    state, about, label_of_text: the text, what it is about, and what it is called. questions: phrasings; one is picked by the state, and {column} is filled in.
    kind: a key of ``KINDS``. options: texts by id, where they are given. answer: by kind, an id, a truth, an array of shares, or the right text.
    texts, place: the row's own options and the right one's place, from 1. key: columns by which rows find distractors in others; several
    are tried in turn. most, negatives, none: wrong options at most, no rows for each yes row, and the text of an option that stands for none of the others.
    split, group, pos: where the row was, what it must stay together with, and its place in the source."""

    name: str
    source: Sequence[str]
    kind: str
    state: str
    answer: str = ""
    questions: Sequence[str] = ()
    pos: str = "pos"
    split: str = "'train'"
    group: str | None = None
    about: str = ""
    label_of_text: str = ""
    joined: Sequence[tuple[str, Sequence[str]]] = ()
    prepared: str | None = None
    where: str | None = None
    once: Sequence[str] = ()
    each: str | None = None
    options: Mapping[str, str] = field(default_factory=dict)
    texts: str | None = None
    place: str | None = None
    key: Sequence[str] = ()
    most: int = row.MAX_DISTRACTORS
    negatives: int = 2
    none: str | None = None


def rows_of(spec: Spec, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The source's rows that count, with s_state, s_question, s_split, s_group and s_pos."""
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [tables[s] for s in spec.source])
    for name, columns in spec.joined:
        df = df.join(tables[name], list(columns))
    if spec.prepared:
        df = PREPARED[spec.prepared](df)
    if spec.where:
        df = df.where(spec.where)
    if spec.once:
        first = F.row_number().over(Window.partitionBy(*[F.expr(c) for c in spec.once]).orderBy(F.expr(spec.pos)))
        df = df.withColumn("s_copy", first).where("s_copy = 1").drop("s_copy")
    if spec.each:
        df = df.withColumn("each", F.explode(F.expr(spec.each)))
    state = row.with_context(F.lit(spec.about), F.coalesce(F.expr(spec.state).cast("string"), F.lit("")), spec.label_of_text)
    told = df.withColumns({"s_state": state, "s_split": F.expr(spec.split), "s_group": F.expr(spec.group).cast("string") if spec.group else F.lit(None).cast("string"), "s_pos": F.expr(spec.pos).cast("long")})
    if not spec.questions:
        return told.withColumn("s_question", F.lit(""))
    asked = row.pick(spec.questions, F.col("s_state"))
    named = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns if any("{" + c + "}" in q for q in spec.questions)}
    return told.withColumn("s_question", filled(asked, **named))


def _sample(df: DataFrame, spec: Spec, options: Column, label: Column) -> DataFrame:
    return builders.sample(df, spec.name, F.col("s_state"), F.col("s_question"), options, label, F.col("s_pos"), F.col("s_split"), F.col("s_group"))


def _given(spec: Spec) -> Column:
    return row.options_of(list(spec.options), list(spec.options.values()))


def _constant(df: DataFrame, spec: Spec) -> DataFrame:
    """An id of the given options; rows of another id are left out."""
    own = df.withColumn("s_answer", F.expr(spec.answer).cast("string")).where(F.col("s_answer").isin(*spec.options))
    return _sample(own, spec, _given(spec), F.col("s_answer"))


def _classes(df: DataFrame, spec: Spec) -> DataFrame:
    """A value of a column whose different values are the options, with slugs as ids; at most 1,000. ``options`` renames values."""
    own = df.withColumn("s_answer", F.expr(spec.answer).cast("string")).where("s_answer is not null")
    names = builders.class_names(own, "s_answer")
    texts = [spec.options.get(n, n) for n in names]
    # slugs of the names are told once, not for every row
    slugs = df.sparkSession.range(1).select(F.array(*[row.slugify(F.lit(n)) for n in names]).cast("array<string>")).first()[0]
    options = F.array(*[F.struct(F.lit(s).alias("id"), F.lit(t).alias("text")) for s, t in zip(slugs, texts)])
    return _sample(own, spec, options, row.slugify(F.col("s_answer")))


def _shares(df: DataFrame, spec: Spec) -> DataFrame:
    """An array of a share for each of the given options."""
    return _sample(df, spec, _given(spec), row.distribution(_given(spec), F.expr(spec.answer)))


def _yes_no(df: DataFrame, spec: Spec) -> DataFrame:
    """A truth; ``options`` says yes and no in other words. Rows without one are left out."""
    own = df.withColumn("s_truth", F.expr(spec.answer).cast("boolean")).where("s_truth is not null")
    options = row.options_of(["yes", "no"], [spec.options.get("yes", "yes"), spec.options.get("no", "no")])
    return _sample(own, spec, options, F.when(F.col("s_truth"), "yes").otherwise("no"))


def _own(df: DataFrame, spec: Spec) -> DataFrame:
    """The row's own texts, of which the one at ``place`` is right."""
    return builders.own_options(df, spec.name, F.col("s_state"), F.col("s_question"), F.expr(spec.texts), F.expr(spec.place), F.col("s_pos"), split=F.col("s_split"), group=F.col("s_group"))


def _votes(df: DataFrame, spec: Spec) -> DataFrame:
    """Rows are votes for one of the given options, counted by state; the state's first row stands for them."""
    voted = df.withColumn("s_answer", F.expr(spec.answer).cast("string"))
    shares = builders.votes(voted, "s_state", "s_answer", list(spec.options)).withColumnRenamed("label", "s_label")
    first = voted.groupBy("s_state").agg(F.min_by(F.struct("s_question", "s_split", "s_group", "s_pos"), "s_pos").alias("s_first")).select("s_state", "s_first.*")
    return _sample(first.join(shares, "s_state"), spec, _given(spec), F.col("s_label"))


def _drawn(df: DataFrame, spec: Spec, same_split: bool) -> DataFrame:
    """The right text among others with the same keys, the first key's first. Rows that get none are left out."""
    split = splits.canonical(F.col("s_split"))
    told = row.sha1(F.concat_ws("\x1f", "s_state", "s_question"))
    own = df.withColumns({"s_answer": F.expr(spec.answer).cast("string"), "s_id": F.concat_ws(":", "s_split", "s_pos", told), "s_want": F.lit(spec.most)}).where(F.trim("s_answer") != "")
    keys = {f"s_key{i}": F.to_json(F.array(split if same_split else F.lit(""), F.expr(k).cast("string"))) for i, k in enumerate(spec.key)}
    own = own.withColumns(keys)
    pool = own if same_split else own.where(split == "train")
    tier = lambda key: lambda short: rings.circled(short, pool.select(key, "s_answer").distinct(), "s_id", key, "s_answer", "s_answer", 2 * spec.most + 2)
    met = rings.tiered(own, "s_want", [tier(k) for k in keys], lambda e: F.lower(F.trim(e)) != F.lower(F.trim("s_answer")))
    made = builders.drawn_choice(met, "s_id", "s_answer", F.transform("found", lambda f: f["entry"]), spec.most)
    texts = F.concat("texts", F.array(F.lit(spec.none))) if spec.none else F.col("texts")
    return builders.own_options(made, spec.name, F.col("s_state"), F.col("s_question"), texts, F.col("place"), F.col("s_pos"), split=F.col("s_split"), group=F.col("s_group"))


def _siblings(df: DataFrame, spec: Spec) -> DataFrame:
    """Distractors from rows of the same split."""
    return _drawn(df, spec, True)


def _pool(df: DataFrame, spec: Spec) -> DataFrame:
    """Distractors from train rows alone."""
    return _drawn(df, spec, False)


def _negatives(df: DataFrame, spec: Spec) -> DataFrame:
    """Yes for each of the row's true options (an array of ids) and no for ``negatives`` others; {candidate} in a question is the option's text."""
    truths = df.withColumn("s_true", F.array_intersect(F.expr(spec.answer), F.array(*map(F.lit, spec.options)))).where(F.size("s_true") > 0)
    false = F.slice(row.shuffled(F.array_except(F.array(*map(F.lit, spec.options)), "s_true"), F.col("s_state")), 1, spec.negatives)
    each = truths.withColumn("s_one", F.explode(F.concat("s_true", false)))
    texts = F.create_map(*[F.lit(x) for pair in spec.options.items() for x in pair])
    asked = each.withColumn("s_question", filled(F.col("s_question"), candidate=texts[F.col("s_one")]))
    return _sample(asked, spec, row.options_of(["yes", "no"]), F.when(F.array_contains("s_true", F.col("s_one")), "yes").otherwise("no"))


KINDS: dict[str, Callable[[DataFrame, Spec], DataFrame]] = {
    "constant": _constant, "classes": _classes, "shares": _shares, "yes_no": _yes_no, "own": _own, "votes": _votes, "siblings": _siblings, "pool": _pool, "negatives": _negatives}


def compiled(specs: Sequence[Spec], tables: Mapping[str, DataFrame]) -> DataFrame:
    """The sample rows of all datasets. Two of one name, and a kind that there is not, are errors."""
    names = [s.name for s in specs]
    if len(set(names)) < len(names):
        raise ValueError(f"named twice: {', '.join(sorted({n for n in names if names.count(n) > 1}))}")
    if unknown := sorted({s.kind for s in specs} - set(KINDS)):
        raise ValueError(f"no such kind: {', '.join(unknown)}")
    return reduce(DataFrame.unionByName, [KINDS[s.kind](rows_of(s, tables), s) for s in specs])


def prepared(specs: Sequence[Spec], tables: Mapping[str, DataFrame], most: int) -> DataFrame:
    """The samples in the splits that they end in, regrouped once for all datasets, and capped."""
    made = compiled(specs, tables)
    placed = splits.regroup(made).withColumn("split", F.col("target")).select(*made.columns)
    return splits.cap(placed, most)


def from_settings(settings: Mapping[str, Mapping]) -> list[Spec]:
    """Specifications from {name: fields}, as a JSON file has them."""
    known = Spec.__dataclass_fields__
    for name, fields in settings.items():
        if unknown := sorted(set(fields) - set(known)):
            raise ValueError(f"{name}: no such field: {', '.join(unknown)}")
    return [Spec(name=name, **{k: [v] if k == "source" and isinstance(v, str) else v for k, v in fields.items()}) for name, fields in settings.items()]
