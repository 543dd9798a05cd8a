"""Bodies of requests, settings from files, spelled values."""

import json
import re

import pytest
from pyspark.sql import functions as F

from gradus import config
from gradus.functions import parse, row
from gradus.operators import requests

GOOD = {"state": "s", "questions": {"a": {"type": "noul", "instructions": "Is it?"}, "b": {"type": "choice", "instructions": "Which?", "criteria": {"x": "one", "y": None}}}}


def question(**fields):
    return {"state": "s", "questions": {"q": {"type": "choice", "instructions": "Which?", "criteria": {"x": "1", "y": "2"}} | fields}}


BODIES = [
    (json.dumps(GOOD), None), (json.dumps(GOOD | {"state": ""}), None), (json.dumps(GOOD | {"state": [1, {"é": None}]}), None), (None, "not JSON"), ("", "not JSON"), ("{", "not JSON"), ("[1]", "not an object"), ('"x"', "not an object"),
    (json.dumps({"state": "s"}), "no questions"), (json.dumps({"state": "s", "questions": {}}), "no questions"), (json.dumps({"state": "s", "questions": [1]}), "no questions"), (json.dumps({"questions": GOOD["questions"]}), "no state"),
    (json.dumps(GOOD | {"state": None}), "no state"), (json.dumps(GOOD | {"more": 1}), "unknown field"), (json.dumps(question(type="score")), "unknown type: q"), (json.dumps(question(criteria={"x": "1"})), "a choice needs at least 2 criteria: q"),
    (json.dumps(question(criteria=None)), "a choice needs at least 2 criteria: q"), (json.dumps(question(type="noul")), "criteria of a yes/no question: q"), (json.dumps(question(instructions=None)), "no instructions: q"), (json.dumps(question(colour="red")), "unknown field: q"),
]


def test_bodies(spark):
    df = spark.createDataFrame([(i, b, "kept") for i, (b, _) in enumerate(BODIES)], "id int, body string, name string")
    made = requests.checked(df)
    got = {r.id: r.error for r in made.collect()}
    assert got == {i: e for i, (_, e) in enumerate(BODIES)}
    rows = sorted((r.id, r.name, r.state, r.question, r.texts, r.criteria and len(r.criteria)) for r in requests.asked_rows(made.drop("name"), "id").collect())
    want = [(i, name, state, q, texts, n) for i, state in ((0, "s"), (1, ""), (2, '[1,{"é":null}]')) for name, q, texts, n in (("a", "Is it?", ["yes", "no"], None), ("b", "Which?", ["x: one", "y"], 2))]
    assert rows == want


def test_settings_of_files(tmp_path):
    (tmp_path / "own.toml").write_text('names = ["a", "b"]\n[train]\nrate = 1\n')
    (tmp_path / "own.json").write_text('{"train": {"steps": 5}}')
    defaults = {"names": [], "cuts": [0.5], "train": {"rate": 0.1, "steps": 2}}
    assert config.layered(defaults, config.read(str(tmp_path / "own.toml"))) == {"names": ["a", "b"], "cuts": [0.5], "train": {"rate": 1.0, "steps": 2}}
    made = config.layered(defaults, config.read(str(tmp_path / "own.json")), ["names=sst2,anli,", "cuts=1,0.25", "train.rate=2"])
    assert made == {"names": ["sst2", "anli"], "cuts": [1.0, 0.25], "train": {"rate": 2.0, "steps": 5}} and isinstance(made["train"]["rate"], float) and isinstance(made["cuts"][0], float)
    assert config.layered(defaults, None, ['names=["x,y"]'])["names"] == ["x,y"]
    with pytest.raises(ValueError, match="no such setting: train.rat"):
        config.layered(defaults, {"train": {"rat": 1}})


def plain(value):
    """What two spellings share, step by step in plain Python."""
    text = value.lower().replace("centre", "center").strip(" ")
    for n, word in enumerate(parse.NUMBERS):
        text = re.sub(rf"\b{word}\b", str(n), text)
    for half in "ap":
        if m := re.fullmatch(rf"(\d\d?)(?::(\d\d))?\s*{half}(?:m|\.m\.)", text):
            hour, minute = int(m[1]), int(m[2] or 0)
            if 1 <= hour <= 12 and minute < 60:
                return f"time:{hour % 12 + 12 * (half == 'p'):02d}:{minute:02d}"
    if (m := re.fullmatch(r"(\d\d?):(\d\d)", text)) and int(m[1]) < 24 and int(m[2]) < 60:
        return f"time:{int(m[1]):02d}:{int(m[2]):02d}"
    return re.sub(r"\W+", "", text)


def test_spelled_values(spark):
    values = ["5pm", "5 p.m.", "12 am", "12:30 PM", "0 am", "13 pm", "17:05", "24:00", "7:60", "5", "five", "Five pm", "twelve a.m.", "one two", "someone", "Centre of the City Centres", "éa-B c", "", " ", "  Ten:30 ", "9:5", "5pm\n", "a.m.", "10:15pm.", "time", "don't", "3 \t am"]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(parse.normalized(F.col("v"))).collect()]
    assert got == [plain(v) for v in values]
    assert spark.range(1).select(parse.normalized(F.lit(None).cast("string"))).first()[0] is None


def test_one_phrasing_stands(spark):
    assert spark.range(1).select(row.pick("As it is.", F.lit("s"), "about")).first()[0] == "As it is."
