"""Specifications of named sources on rows of their shape."""

import json

import pytest

from gradus.operators import specs

NLI = {"entailment": "follows", "neutral": "is open", "contradiction": "is ruled out"}
NAMED = {
    "sst2": {"source": "sst2", "kind": "classes", "where": "label >= 0", "state": "sentence", "answer": "element_at(array('negative', 'positive'), label + 1)", "questions": ["What is the mood?", "How does it sound?"], "pos": "idx", "split": "part"},
    "boolq": {"source": "boolq", "kind": "yes_no", "state": "passage", "about": "A passage.", "label_of_text": "Passage", "questions": ["{question}?"], "answer": "answer", "pos": "idx"},
    "chaos_nli": {"source": "chaos_nli", "kind": "shares", "state": "premise", "questions": ["What of this: {hypothesis}"], "options": NLI, "answer": "label_dist", "pos": "idx"},
    "logiqa": {"source": "logiqa", "kind": "own", "state": "context", "questions": ["{query}"], "texts": "options", "place": "correct_option + 1", "pos": "idx"},
    "qasc": {"source": "qasc", "kind": "own", "where": "answerKey <> ''", "state": "concat_ws(' ', fact1, fact2)", "questions": ["{question}"], "texts": "choices.text", "place": "array_position(choices.label, answerKey)", "pos": "idx"},
    "go_emotions_noul": {"source": "go_emotions", "kind": "negatives", "state": "text", "answer": "transform(labels, i -> element_at(array('joy', 'fear', 'anger', 'love'), i + 1))", "options": {k: k for k in ("joy", "fear", "anger", "love")}, "questions": ["Is there {candidate}?"], "pos": "idx"},
    "halueval_qa": {"source": "halueval", "kind": "yes_no", "state": "concat(knowledge, ' ', question, ' ', each.said)", "each": "array(struct(right_answer as said, false as made_up), struct(hallucinated_answer as said, true as made_up))", "answer": "each.made_up", "questions": ["Is the answer made up?"], "pos": "idx", "group": "question"},
    "aegis_category": {"source": "aegis", "kind": "votes", "where": "prompt <> 'REDACTED' and prompt_label = 'unsafe'", "state": "prompt", "each": "split(violated_categories, ', ?')", "answer": "each", "options": {"Violence": "violence", "Fraud": "fraud"}, "questions": ["Which kind?"], "pos": "idx"},
    "ropes": {"source": "ropes", "kind": "siblings", "state": "concat(background, ' ', situation)", "questions": ["{question}"], "answer": "answers.text[0]", "key": ["struct(background, situation)"], "pos": "idx", "split": "part"},
    "massive_slots": {"source": "massive", "kind": "pool", "state": "utt", "questions": ["What is the {slot}?"], "answer": "value", "key": ["slot"], "pos": "idx", "split": "partition", "most": 2},
    "babi_nli": {"source": ["babi_one", "babi_two"], "kind": "yes_no", "state": "premise", "answer": "label = 'entailed'", "pos": "idx"},
    "vitaminc": {"source": "vitaminc", "kind": "constant", "where": "revision_type = 'real'", "state": "evidence", "questions": ["Of the claim {claim}: what holds?"], "answer": "label", "options": {"SUPPORTS": "supported", "REFUTES": "refuted"}, "pos": "idx"},
    "multi_nli_genre": {"source": "multi_nli", "kind": "classes", "once": ["promptID"], "state": "premise", "answer": "genre", "options": {"slate": "a magazine"}, "pos": "idx"},
    "ticket_subject": {"source": "tickets", "kind": "siblings", "state": "subject", "answer": "body", "key": ["struct(language, queue)", "language"], "most": 2, "none": "None of these emails", "pos": "idx"},
    "hwu64": {"source": "hwu64", "joined": [["hwu64_names", ["label"]]], "kind": "classes", "state": "text", "answer": "name", "pos": "idx"},
}
SHAPES = {
    "sst2": ("idx int, sentence string, label int, part string", [(0, "good", 1, "train"), (1, "bad", 0, "train"), (2, "?", -1, "test"), (3, "fine", 1, "dev")]),
    "boolq": ("idx int, passage string, question string, answer boolean", [(0, "Snow is white.", "is snow white", True), (1, "", "is it", False), (2, "x", "q", None)]),
    "chaos_nli": ("idx int, premise string, hypothesis string, label_dist array<double>", [(0, "p", "h", [0.5, 0.25, 0.25])]),
    "logiqa": ("idx int, context string, query string, options array<string>, correct_option int", [(0, "c", "q", ["a", "b", "c", "d"], 2), (1, "c", "q", ["a"], 3)]),
    "qasc": ("idx int, fact1 string, fact2 string, question string, choices struct<label:array<string>,text:array<string>>, answerKey string", [(0, "f", "g", "q", (["A", "B"], ["x", "y"]), "B"), (1, "f", None, "q", (["A"], ["x"]), "")]),
    "go_emotions": ("idx int, text string, labels array<int>", [(0, "t", [0, 3]), (1, "u", [])]),
    "halueval": ("idx int, knowledge string, question string, right_answer string, hallucinated_answer string", [(0, "k", "q", "r", "h")]),
    "aegis": ("idx int, prompt string, prompt_label string, violated_categories string", [(0, "p", "unsafe", "Violence, Fraud"), (1, "p", "unsafe", "Violence"), (2, "REDACTED", "unsafe", "Fraud"), (3, "q", "safe", "Fraud"), (4, "r", "unsafe", "Other")]),
    "ropes": ("idx int, background string, situation string, question string, answers struct<text:array<string>>, part string", [(0, "b", "s", "q0", (["one"],), "train"), (1, "b", "s", "q1", (["two", "x"],), "train"), (2, "b", "s", "q2", (["ONE "],), "train"), (3, "b", "z", "q3", (["three"],), "train"), (4, "b", "s", "q4", (["four"],), "dev")]),
    "massive": ("idx int, utt string, slot string, value string, partition string", [(i, f"u{i}", "time", f"v{i}", "train") for i in range(5)] + [(5, "u5", "time", "v5", "test"), (6, "u6", "place", "v6", "test")]),
    "babi_one": ("idx int, premise string, label string", [(0, "p", "entailed")]), "babi_two": ("idx int, premise string, label string, more int", [(1, "q", "not", 1)]),
    "vitaminc": ("idx int, claim string, evidence string, label string, revision_type string", [(0, "c", "e", "REFUTES", "real"), (1, "c", "e", "SUPPORTS", "synthetic"), (2, "c", "e", "NOT ENOUGH INFO", "real")]),
    "multi_nli": ("idx int, promptID string, premise string, genre string", [(0, "1", "p", "slate"), (1, "1", "p", "slate"), (2, "2", "q", "fiction")]),
    "tickets": ("idx int, subject string, body string, queue string, language string", [(0, "s0", "b0", "it", "en"), (1, "s1", "b1", "it", "en"), (2, "s2", "b2", "hr", "en"), (3, "s3", "b3", "it", "de")]),
    "hwu64": ("idx int, text string, label int", [(0, "t", 1), (1, "u", 0)]), "hwu64_names": ("label int, name string", [(0, "alarm set"), (1, "play music")]),
}


@pytest.fixture(scope="module")
def made(spark):
    tables = {n: spark.createDataFrame(rows, shape) for n, (shape, rows) in SHAPES.items()}
    told = specs.from_settings(json.loads(json.dumps(NAMED)))
    out = {}
    for r in specs.compiled(told, tables).collect():
        out.setdefault(r.dataset, []).append(r)
    return {k: sorted(v, key=lambda r: (r.pos, r.question)) for k, v in out.items()}


def pairs(r):
    return [(o.text, round(p, 3)) for o, p in zip(r.options, r.label)]


def right(r):
    return next(o.text for o, p in zip(r.options, r.label) if p == 1)


def test_every_source_has_rows(made):
    assert set(made) == set(NAMED)


def test_given_options(made):
    assert [(r.split, pairs(r)) for r in made["sst2"]] == [("train", [("negative", 0), ("positive", 1)]), ("train", [("negative", 1), ("positive", 0)]), ("dev", [("negative", 0), ("positive", 1)])]
    assert pairs(made["chaos_nli"][0]) == [("follows", 0.5), ("is open", 0.25), ("is ruled out", 0.25)] and made["chaos_nli"][0].question == "What of this: h"
    assert [(r.pos, right(r)) for r in made["vitaminc"]] == [(0, "refuted")] and made["vitaminc"][0].question == "Of the claim c: what holds?"
    assert [(r.pos, pairs(r)) for r in made["multi_nli_genre"]] == [(0, [("fiction", 0), ("a magazine", 1)]), (2, [("fiction", 1), ("a magazine", 0)])]
    assert [[(o.id, o.text) for o in r.options] for r in made["hwu64"]] == [[("alarm_set", "alarm set"), ("play_music", "play music")]] * 2 and [right(r) for r in made["hwu64"]] == ["play music", "alarm set"]


def test_yes_and_no(made):
    assert [(r.state, r.question, right(r), r.type) for r in made["boolq"]] == [("A passage.\n\nPassage:\nSnow is white.", "is snow white?", "yes", "noul"), ("A passage.", "is it?", "no", "noul")]
    assert sorted((r.state, right(r), r.group) for r in made["halueval_qa"]) == [("k q h", "yes", "q"), ("k q r", "no", "q")]
    assert [right(r) for r in made["babi_nli"]] == ["yes", "no"]
    got = {r.question: right(r) for r in made["go_emotions_noul"]}
    assert got == {"Is there joy?": "yes", "Is there love?": "yes", "Is there fear?": "no", "Is there anger?": "no"}


def test_own_options_and_votes(made):
    assert [(r.pos, [o.id for o in r.options], right(r)) for r in made["logiqa"]] == [(0, ["A", "B", "C", "D"], "c")]
    assert [(r.state, right(r)) for r in made["qasc"]] == [("f g", "y")]
    assert [(r.state, r.pos, pairs(r)) for r in made["aegis_category"]] == [("p", 0, [("violence", 0.667), ("fraud", 0.333)])]


def test_drawn_options(made):
    got = {r.pos: (right(r), {o.text for o in r.options}) for r in made["ropes"]}
    assert got[0] == ("one", {"one", "two"}) and got[1][1] in ({"two", "one"}, {"two", "ONE "}) and got[2] == ("ONE ", {"ONE ", "two"}) and set(got) == {0, 1, 2}
    got = {r.pos: (right(r), {o.text for o in r.options}) for r in made["massive_slots"]}
    assert set(got) == set(range(6)) and all(len(o) == 3 and o - {a} <= {f"v{i}" for i in range(5)} for a, o in got.values()) and got[5][0] == "v5"
    got = {r.pos: (right(r), [o.text for o in r.options]) for r in made["ticket_subject"]}
    assert set(got[0][1]) == {"b0", "b1", "b2", "None of these emails"} and got[0][0] == "b0" and got[0][1][-1] == "None of these emails" and set(got) == {0, 1, 2}


def test_one_build(spark):
    tables = {n: spark.createDataFrame(rows, shape) for n, (shape, rows) in SHAPES.items()}
    told = specs.from_settings({k: NAMED[k] for k in ("sst2", "massive_slots", "halueval_qa")})
    got = [(r.dataset, r.split) for r in specs.prepared(told, tables, 3).collect()]
    assert len(got) == 3 + 4 + 2 and ("massive_slots", "test") in got and ("sst2", "validation") in got


def test_errors():
    with pytest.raises(ValueError, match="x: no such field: colour"):
        specs.from_settings({"x": {"source": "a", "kind": "own", "state": "b", "colour": "red"}})
    with pytest.raises(ValueError, match="no such kind: odd"):
        specs.compiled([specs.Spec("x", ["a"], "odd", "b")], {})
    with pytest.raises(ValueError, match="named twice: x"):
        specs.compiled([specs.Spec("x", ["a"], "own", "b")] * 2, {})
