"""Standardization with the reference's literal frames."""

from pyspark.sql import functions as F

from runlens.operators import profile as P
from runlens.operators import standardize as S


def test_format_options_literals(spark):
    cases = [
        (["the small yellow circle", "the medium yellow circle", "both of them", "none of them"],
         "A) the small yellow circle\nB) the medium yellow circle\nC) both of them\nD) none of them"),
        (["  option with leading space", "option with trailing space  "],
         "A) option with leading space\nB) option with trailing space"),
        ([], ""),
        (["only option"], "A) only option"),
        (["Option with\nnewline"], "A) Option with\nnewline"),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "id int, c array<string>")
    got = {r.id: r.o for r in df.select("id", S.format_options("c").alias("o")).collect()}
    for i, (_, want) in enumerate(cases):
        assert got[i] == want
    thirty = spark.createDataFrame([([f"option {i}" for i in range(30)],)], "c array<string>")
    text = thirty.select(S.format_options("c").alias("o")).first().o
    assert "Z) option 25" in text and "[) option 26" in text


def test_resolve_answer_index_edges(spark):
    rows = [([" a ", "b", "c"], 1), (["a", "b", "c"], 5), (["a", "b", "c"], -1), (None, 0)]
    df = spark.createDataFrame(rows, "candidate_answers array<string>, answer long")
    got = [r.o for r in df.select(S.resolve_answer_index(df, "answer").alias("o")).collect()]
    assert got == ["b", "5", "-1", "0"]
    named = spark.createDataFrame([(["x", "y"], ["p", "q"], 1)], "zz array<string>, options array<string>, answer long")
    assert named.select(S.resolve_answer_index(named, "answer").alias("o")).first().o == "q"
    anylist = spark.createDataFrame([(["one"], ["p", "q"], 0)], "l1 array<string>, l2 array<string>, answer long")
    assert anylist.select(S.resolve_answer_index(anylist, "answer").alias("o")).first().o == "p"


def test_qa_frame_rules_and_transform(spark):
    rows = [("What is 2+2?", "4", "Math context", 1), ("Capital of France?", "Paris", "Geo", 2),
            ("Color of sky?", "Blue", "Nature", 3)]
    df = spark.createDataFrame(rows, "question string, answer string, context string, metadata_id long")
    prof = P.profile_columns(df, "qa", "metadata_id")
    reco = P.recommend_mapping(prof).first()
    assert reco.type == "multi_field" and reco.pattern_name == "context_question"
    assert reco.input_fields == ["context"] and reco.output_field == "question"
    single = S.apply_rules(df, {"input_format": "single_field", "input_fields": ["question"], "output_field": "answer"})
    assert single.collect()[1].asDict() == {"INPUT": "Capital of France?", "OUTPUT": "Paris"}
    v = S.validate_io(df, single).first()
    assert v.validation_passed and v.empty_inputs == 0


def test_story_frame(spark):
    rows = [("A story", "Which?", 1, ["x", "y", "z"]), ("B story", "What?", 0, ["p", "q"])]
    df = spark.createDataFrame(rows, "story string, question string, answer long, candidate_answers array<string>")
    prof = P.profile_columns(df, "mc", None)
    rules = S.make_rules(P.recommend_mapping(prof), prof).first().asDict(recursive=True)
    assert rules["transformation_type"] == "multi_field"
    assert rules["preprocessing_steps"] == ["resolve_answer_index"]
    assert rules["field_labels"]["candidate_answers"] == "OPTIONS:"
    # the field-set rule makes the last field (the options) the output
    assert rules["output_field"] == "candidate_answers"
    assert rules["input_fields"] == ["story", "question"]
    # corrected as the manual override does: options become input, answer the output
    fixed = S.apply_rules(df, {**rules, "input_fields": ["story", "question", "candidate_answers"],
                               "output_field": "answer"}).collect()
    assert fixed[0].OUTPUT == "y" and fixed[1].OUTPUT == "p"
    assert fixed[0].INPUT == "STORY:\n\nA story\n\n\n\nQUESTION:\n\nWhich?\n\n\n\nOPTIONS:\n\nA) x\nB) y\nC) z"


def test_extract_code(spark):
    df = spark.createDataFrame([("Intro\n```python\nx = 1\n```\nEnd",), ("no fence",)], "t string")
    got = [r.c for r in df.select(S.extract_code("t", "python").alias("c")).collect()]
    assert got == ["x = 1", "no fence"]
    cpp = spark.createDataFrame([("```cpp\nint x;\n```",)], "t string")
    assert cpp.select(S.extract_code("t", "c++").alias("c")).first().c == "int x;"


def test_profile_types(spark):
    rows = [(i, str(i % 2), "text value number %d" % i, "yes" if i % 2 else "no", float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "k long, b string, t string, yn string, x double")
    prof = {r.column: r for r in P.profile_columns(df, "d", "k").collect()}
    assert prof["t"].type == "text"
    assert prof["b"].type == "categorical"
    assert prof["x"].type == "numeric"
    assert prof["k"].n_values == 20 and prof["k"].sample_values == ["0", "1", "2"]
    first = {r.column: r for r in P.profile_columns(df, "d", "k", n_rows=4).collect()}
    assert first["k"].n_values == 4


def test_profile_keeps_null_keys_and_empty_columns(spark):
    df = spark.createDataFrame([(None, "b", None), (None, "B", None), (1, "a", None)], "k long, t string, e string")
    prof = {r.column: r for r in P.profile_columns(df, "d", "k").collect()}
    assert (prof["t"].n_values, prof["t"].unique_values, prof["k"].n_values) == (3, 2, 1)
    assert prof["e"].type == "empty" and prof["e"].sample_values == [] and prof["e"].n_values == 0
    assert P.profile_columns(df, "d", "k", n_rows=2).where("column = 't'").first().n_values == 2
    none = {r.column: r.type for r in P.profile_columns(df.limit(0), "d", "k").collect()}
    assert none == {"k": "empty", "t": "empty", "e": "empty"}
