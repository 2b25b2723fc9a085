"""Answer extraction and scoring: reference literals and a Python ``re``
second oracle over Unicode text."""

import re

import pytest
from pyspark.sql import functions as F

from runlens.functions import extract as X

from .conftest import SF_CHECK


def py_extract(text: str):
    """The answer cascade written directly with Python's re (test oracle)."""
    extracted, conf = "", 0.3
    for p in X.ANSWER_PATTERNS:
        m = re.findall(p, text, re.IGNORECASE | re.MULTILINE)
        if m:
            extracted, conf = m[-1].strip(), 0.5
            break
    if not extracted:
        lines = [ln.strip() for ln in text.split("\n") if ln.strip()]
        if lines:
            extracted, conf = lines[-1], 0.2
    if not extracted:
        extracted, conf = text.strip()[:100] + "...", 0.1
    return extracted, conf


def py_clean(v: str):
    if not v:
        return None
    v = v.strip()
    for p in X.ANSWER_PREFIXES:
        if v.lower().startswith(p):
            v = v[len(p):].strip()
    if len(v.split()) == 1 and v.endswith("."):
        v = v[:-1]
    return v.strip()


LITERALS = [
    ("Answer: The solution is 42", "The solution is 42", 0.5),
    ("Final Answer: Yes", "Yes", 0.5),
    ("The answer is (C)", "C", 0.5),
    ("Multiple choice: [B]", "B", 0.5),
    ("The answer is: 42", "The answer is: 42", 0.2),  # no pattern matches: last line
    ("", "...", 0.1),
    ("   \n  ", "...", 0.1),
    ("***", "***", 0.2),
]


def test_reference_literals(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(LITERALS)], "id int, raw_output string")
    got = {r.id: (r.final_answer, r.confidence) for r in X.extract_answer(df).collect()}
    for i, (_, ans, conf) in enumerate(LITERALS):
        assert got[i] == (ans, conf), (LITERALS[i], got[i])


def test_cascade_matches_python_re_on_documents(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", F.col("text").alias("raw_output"))
    rows = X.extract_answer(docs).select("doc_id", "raw_output", "final_answer", "confidence").collect()
    bad = [(r.doc_id, r.final_answer, py_extract(r.raw_output)) for r in rows
           if (r.final_answer, r.confidence) != py_extract(r.raw_output)]
    assert len(rows) > 100
    assert not bad, bad[:3]


@pytest.mark.parametrize("value", [
    "The answer is 42.", "answer: Paris.", "Therefore, so, yes.", "  hence, 7 ", "the final answer to the question 3",
    "Final answer: the answer is x.", "the answer is ", "Yes.", "two words.", "", "   ",
])
def test_clean_answer_matches_python(spark, value):
    df = spark.createDataFrame([(value,)], "v string")
    got = df.select(X.clean_answer("v").alias("c")).collect()[0].c
    assert got == py_clean(value)


def test_correctness_rules(spark):
    rows = [(" 42 ", "42"), ("", "42"), ("42", ""), (None, "4"), ("Paris", "paris ")]
    df = spark.createDataFrame(rows, "a string, e string")
    got = [r.ok for r in df.select(X.is_correct_strict("a", "e").alias("ok")).collect()]
    assert got == [True, False, False, False, True]


def test_estimate_cost_rates(spark):
    df = spark.createDataFrame([(1000, "Anthropic"), (500, "cohere"), (1234, "openrouter"), (100, "other")],
                               "t long, p string")
    got = [r.c for r in df.select(X.estimate_cost("t", "p").alias("c")).collect()]
    assert got == [0.008, 0.001, 0.000247, 0.0001]


def test_detect_multi_call(spark):
    df = spark.createDataFrame([("step 1: a then, b",), ("function_call x function_call",), ("plain",),
                                ("```a``` and ```b```",)], "t string")
    got = [r.m for r in df.select(X.detect_multi_call("t").alias("m")).collect()]
    assert got == [True, True, False, True]


def test_render_prompt_uses_template_and_suffix(spark):
    from runlens.functions.prompts import SUFFIXES, TEMPLATES

    df = spark.createDataFrame([("What is 2+2?", "ChainOfThought"), ("Q", "AsPlanning"), ("Q", "Nope")],
                               "text string, approach string")
    got = [r.prompt for r in X.render_prompts(df).collect()]
    assert got[0] == TEMPLATES["ChainOfThought"].format(question="What is 2+2?") + SUFFIXES["chainofthought"]
    assert got[1] == TEMPLATES["AsPlanning"].format(question="Q") + SUFFIXES["none"]
    assert got[2] is None


def _answer_two(prompt: str) -> str:
    if "boom" in prompt:
        raise ValueError("boom")
    return "Some reasoning.\nFinal Answer: 4"


def test_evaluate_grid_end_to_end(spark):
    from runlens.operators.score import evaluate_grid

    samples = spark.createDataFrame([(1, "What is 2+2?", "4"), (2, "boom?", "x")], "id long, INPUT string, OUTPUT string")
    out = {(r.id, r.approach): r for r in evaluate_grid(samples, ["None", "ChainOfThought"], _answer_two).collect()}
    assert len(out) == 4
    ok = out[(1, "ChainOfThought")]
    assert ok.parsed_answer == "4" and ok.is_correct is True and ok.parsing_confidence == 0.5 and ok.error is None
    bad = out[(2, "None")]
    assert bad.error.startswith("ValueError") and bad.is_correct is None


def test_typed_answer_yes_no_letters_and_blank_lists(spark):
    rows = [("multiple_choice", " é ", None, None), ("multiple_choice", "Option A", None, None), ("yes_no", None, True, None),
            ("yes_no", None, None, None), ("list", None, None, [" ", ""]), ("list", None, None, ["x ", " "])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, kind string, option string, yes_no boolean, items array<string>")
    df = df.selectExpr("*", "'a' as final_answer", "0.5 as confidence", "'1' as number", "'t' as answer_type", "items as steps")
    got = {r.id: r for r in X.typed_answer(df).collect()}
    assert [got[i].option_clean for i in (0, 1)] == ["É", "Option A"]
    assert (got[2].yes_no_value, got[2].invalid_reason) == (True, None)
    assert (got[3].yes_no_value, got[3].invalid_reason) == (None, "missing yes_no_answer")
    assert (got[4].items_clean, got[4].item_count, got[5].items_clean, got[5].item_count) == ([], None, ["x"], 1)
