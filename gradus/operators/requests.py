"""Requests to a scorer as rows: bodies in JSON are checked, and each question becomes a row with its option texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.operators import questions

#: The fields of a body and of a question, and the kinds of questions.
FIELDS, QUESTION_FIELDS, KINDS = ("questions", "state"), ("criteria", "instructions", "type"), ("choice", "noul")
_SHAPE = "map<string, struct<type: string, instructions: string, criteria: map<string, string>>>"


def compact(value: Column) -> Column:
    """The text of a variant: a string as it stands, anything else as JSON without white space. Null: null."""
    return F.when(F.schema_of_variant(value) == "STRING", F.variant_get(value, "$", "string")).otherwise(F.to_json(value))


def _names(value: Column) -> Column:
    """The field names of a variant that is an object, as JSON gives them."""
    return F.json_object_keys(F.to_json(value))


def _wrong(name: Column, asked: Column, fields: Column) -> Column:
    """What is wrong with a question, null if nothing is."""
    told = lambda text: F.concat(F.lit(f"{text}: "), name)
    return (
        F.when(F.size(F.array_except(fields, F.array(*map(F.lit, QUESTION_FIELDS)))) > 0, told("unknown field"))
        .when(asked["type"].isNull() | ~asked["type"].isin(*KINDS), told("unknown type"))
        .when(asked["instructions"].isNull(), told("no instructions"))
        .when((asked["type"] == "noul") & F.array_contains(fields, "criteria"), told("criteria of a yes/no question"))
        .when((asked["type"] == "choice") & (F.coalesce(F.cardinality(asked["criteria"]), F.lit(0)) < 2), told("a choice needs at least 2 criteria")))


def checked(bodies: DataFrame, body: str = "body") -> DataFrame:
    """``bodies`` with state, asked MAP<STRING, STRUCT<type, instructions, criteria>> and error: null where a request is good, else the first thing that is wrong.
    A state that is no text counts as compact JSON. Nothing of a bad request is left out: the caller says what becomes of it."""
    v = F.try_parse_json(body)
    made = bodies.withColumns({"r_body": v, "r_state": F.try_variant_get(v, "$.state", "variant"), "r_asked": F.try_variant_get(v, "$.questions", "variant")})
    of = lambda c: F.coalesce(F.substring(F.schema_of_variant(c), 1, 6) == "OBJECT", F.lit(False))
    made = made.withColumn("asked", F.when(of("r_asked"), F.from_json(F.to_json("r_asked"), _SHAPE)))
    made = made.withColumn("r_fields", F.when(of("r_asked"), F.from_json(F.to_json("r_asked"), "map<string, map<string, string>>")))
    each = F.transform(F.map_entries("asked"), lambda e: _wrong(e["key"], e["value"], F.map_keys(F.try_element_at("r_fields", e["key"]))))
    error = (
        F.when(F.col("r_body").isNull(), "not JSON")
        .when(~of("r_body"), "not an object")
        .when(F.size(F.array_except(_names(F.col("r_body")), F.array(*map(F.lit, FIELDS)))) > 0, "unknown field")
        .when(F.col("r_state").isNull() | (F.schema_of_variant("r_state") == "VOID"), "no state")
        .when(F.coalesce(F.cardinality("asked"), F.lit(0)) == 0, "no questions")
        .otherwise(F.get(F.array_compact(each), F.lit(0))))
    return made.withColumns({"state": compact(F.col("r_state")), "error": error}).drop("r_body", "r_state", "r_asked", "r_fields")


def asked_rows(requests: DataFrame, request: str) -> DataFrame:
    """Rows (request, name, state, question, criteria ARRAY<STRUCT<key, text>>, texts) of the good requests: a row for each question; criteria is null for a
    yes/no question."""
    each = requests.where("error is null").select(request, "state", F.explode("asked").alias("name", "q"))
    listed = F.transform(F.map_entries("q.criteria"), lambda c: F.struct(c["key"].alias("key"), c["value"].alias("text")))
    criteria = each.select(request, "name", "state", F.col("q.instructions").alias("question"), F.when(F.col("q.type") == "choice", listed).alias("criteria"))
    return criteria.withColumn("texts", questions.criteria_texts(F.col("criteria")))
