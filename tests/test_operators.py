"""Unit checks of operator edge cases the oracle views do not reach."""

import pytest
from pyspark.sql import functions as F

from runlens.operators import datasets as D
from runlens.operators import maintain as M
from runlens.operators import profile as P
from runlens.operators import runs as R
from runlens.operators import standardize as S


def test_sample_seeded_rejects_non_positive(spark):
    df = spark.range(5)
    with pytest.raises(ValueError):
        D.sample_seeded(df, 0, "id")
    assert D.sample_seeded(df, 50, "id").count() == 5  # whole table when n >= size
    a = [r.id for r in D.sample_seeded(df, 3, "id").collect()]
    b = [r.id for r in D.sample_seeded(df, 3, "id").collect()]
    assert a == b


def test_cycle_ids_do_not_truncate(spark):
    base = spark.createDataFrame([(i, f"q{i}") for i in range(3)], "k long, INPUT string")
    out = D.cycle_to_n(base, 1002, "k", "LOCAL_TEST_LARGE").orderBy("_i").collect()
    assert out[0].id == "LOCAL_TEST_LARGE_001" and out[-1].id == "LOCAL_TEST_LARGE_1002"
    assert out[-1].k == 1001 % 3


def test_apply_rules_difficulty_filter(spark):
    df = spark.createDataFrame([("a", "x", "Hard"), ("b", "y", "easy"), ("c", "z", "HARD")],
                               "question string, answer string, difficulty string")
    rules = {"input_format": "single_field", "input_fields": ["question"], "output_field": "answer",
             "preprocessing_steps": ["filter_by_difficulty"], "difficulty_filter": "hard"}
    assert [r.INPUT for r in S.apply_rules(df, rules).collect()] == ["a", "c"]
    missing = S.apply_rules(df, {"input_format": "single_field", "input_fields": ["nope"], "output_field": "gone"})
    assert missing.first().asDict() == {"INPUT": "", "OUTPUT": ""}


def test_override_rules_rejects_unknown_fields(spark):
    df = spark.createDataFrame([("q", "a", "c")], "question string, answer string, context string")
    prof = P.profile_columns(df, "d", None)
    rules = S.make_rules(P.recommend_mapping(prof), prof)
    ov = spark.createDataFrame([("d", ["question", "nope"], "answer", [])],
                               "dataset_name string, input_fields array<string>, output_field string, "
                               "preprocessing_steps array<string>")
    out, rejected = S.override_rules(rules, ov, prof)
    assert rejected.count() == 1
    assert out.first().manually_corrected is False
    good = spark.createDataFrame([("d", ["context", "question"], "answer", [])], ov.schema)
    out, rejected = S.override_rules(rules, good, prof)
    r = out.first().asDict(recursive=True)
    assert rejected.count() == 0 and r["confidence"] == 1.0
    assert r["field_labels"] == {"context": "CONTEXT:", "question": "QUESTION:"}


def test_validate_format_errors(spark):
    ok = spark.createDataFrame([("i", "o")], "INPUT string, OUTPUT string")
    assert S.validate_format(ok).first().is_valid
    blank_first = spark.createDataFrame([(0, "", "o"), (1, "i", "o")], "k int, INPUT string, OUTPUT string")
    errs = S.validate_format(blank_first, key="k").first().errors
    assert "INPUT column contains empty values" in errs
    empty = spark.createDataFrame([], "INPUT string, OUTPUT string")
    assert "File is empty" in S.validate_format(empty).first().errors


def test_list_experiments_limit_and_order(spark, fx_small):
    out = R.list_experiments(fx_small.experiments_v, limit=3).collect()
    assert len(out) == 3
    assert out[0].created_at >= out[1].created_at >= out[2].created_at


def test_upsert_keeps_last_incoming(spark):
    old = spark.createDataFrame([("a", 1, 0), ("b", 2, 0)], "id string, v long, t long")
    new = spark.createDataFrame([("a", 10, 1), ("a", 11, 2), ("c", 3, 1)], "id string, v long, t long")
    got = {r.id: r.v for r in M.upsert(old, new, ["id"], ["t"]).collect()}
    assert got == {"a": 11, "b": 2, "c": 3}


def test_check_constraints_null_passes(spark):
    e = spark.createDataFrame([("e1", None, "{}"), ("e2", "bogus", "{}")], "id string, status string, config_json string")
    r = spark.createDataFrame([("r1", "e1", None, None)], "id string, experiment_id string, parsing_method string, "
                                                         "parsing_confidence double")
    m = spark.createDataFrame([(1, 1.5)], "id long, confidence_score double")
    p = spark.createDataFrame([("p1", "pending", 0.5)], "id string, status string, confidence_score double")
    rows = {(x.table_name, x.row_id, x.rule) for x in M.check_constraints(e, r, m, p).collect()}
    assert rows == {("experiments", "e2", "status"), ("parsing_metrics", "1", "confidence_score range")}


@pytest.mark.parametrize("small", [None, 0])
def test_cost_guard_flags(spark, small):
    import datetime as dt

    from runlens.operators import windows as W

    if small is not None:
        spark.conf.set("spark.runlens.smallBytes", str(small))
    try:
        t = dt.datetime(2024, 1, 1)
        rows = [("r1", "e", t, 0.6, 1), ("r2", "e", t + dt.timedelta(seconds=1), 0.6, 3),
                ("r3", "e", t + dt.timedelta(seconds=2), 5.0, 1), ("r4", "f", t, 9.0, 1)]
        runs = spark.createDataFrame(rows, "id string, experiment_id string, created_at timestamp, "
                                           "cost_estimate double, calls int")
        out = {r.id: r for r in W.cost_guard(runs, calls=F.col("calls"), max_calls=4).collect()}
        assert [round(out[k].cost_before, 9) for k in ("r1", "r2", "r3", "r4")] == [0.0, 0.6, 1.2, 0.0]
        assert [out[k].calls_before for k in ("r1", "r2", "r3")] == [0, 1, 4]
        assert not out["r2"].cost_warning and out["r3"].cost_warning and not out["r3"].cost_high
        assert out["r3"].calls_limit_reached and not out["r2"].calls_limit_reached
    finally:
        spark.conf.unset("spark.runlens.smallBytes")


def test_scored_rows_call_the_function_once(spark, tmp_path):
    from runlens.operators.score import evaluate_grid, score_table, split_results

    log = str(tmp_path / "calls")

    def fn(prompt):
        with open(log, "a") as f:
            f.write("x\n")
        if "bad" in prompt:
            raise ValueError("bad")
        return "Answer: 4"

    grid = spark.createDataFrame([(i, "bad" if i % 5 == 0 else "good") for i in range(20)], "id long, prompt string")
    ok, bad = split_results(score_table(grid, fn))
    assert (ok.count(), bad.count(), ok.count()) == (16, 4, 16)
    assert len(open(log).readlines()) == 20
    samples = spark.createDataFrame([(1, "2+2?", "4"), (2, "bad", "5")], "id long, INPUT string, OUTPUT string")
    out = evaluate_grid(samples, ["None", "ChainOfThought"], fn)
    assert out.count() == 4 and out.where("error is not null").count() == 2
    assert len(open(log).readlines()) == 24


def test_head_n_two_phase_with_ties(spark):
    df = spark.createDataFrame([(i % 5, i) for i in range(50)], "a long, b long")
    got = [tuple(r) for r in D.head_n(df, 7, ["a", "b"]).collect()]
    assert got == sorted((i % 5, i) for i in range(50))[:7]
    assert D.head_n(df.limit(0), 3, ["a"]).count() == 0


def test_registry_first_present_column_wins(spark):
    reg = spark.createDataFrame([("a", "x", "u", "qa", "c")],
                                "dataset_name string, name string, url string, task_type string, category string")
    r = R.normalize_registry(reg).first()
    assert (r.name, r.url, r.description, r.task_type) == ("a", "u", "", "qa")
    bare = spark.createDataFrame([("z",)], "other string")
    r = R.normalize_registry(bare).first()
    assert (r.name, r.url, r.task_type) == ("unknown", "", "unknown")


def test_head_n_keeps_null_keys(spark):
    from runlens.operators.datasets import head_n

    df = spark.createDataFrame([(None,), (None,), (1,), (2,), (3,)], "k int")
    for order in (["k"], [df.k]):
        assert [r.k for r in head_n(df, 3, order).collect()] == [None, None, 1]


def test_filter_name_like_ignores_ascii_case(spark):
    from runlens.operators.runs import filter_name_like

    runs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, experiment_id string")
    names = spark.createDataFrame([("a", "my bBeH run"), ("b", "BBEH"), ("c", "BB-EH")], "id string, name string")
    assert sorted(r.id for r in filter_name_like(runs, names, "Bbeh").collect()) == [1, 2]


def test_upsert_preprocessing_is_unique_by_name_and_config(spark):
    from runlens.operators.maintain import upsert_preprocessing

    old = spark.createDataFrame([("a", "d", "main", "processed", 1), ("b", "d", None, "processed", 1), ("c", "e", "x", "processed", 1)],
                                "id string, dataset_name string, dataset_config string, status string, processed_at long")
    new = spark.createDataFrame([("n1", "d", "main", True, 2), ("n2", "d", None, False, 2), ("n3", "f", "y", True, 3), ("n4", "f", "y", True, 4),
                                 ("n4", "g", "z", True, 5), ("c", "h", "x", True, 6)],
                                "id string, dataset_name string, dataset_config string, validation_passed boolean, processed_at long")
    got = {(r.id, r.dataset_name, r.dataset_config, r.status) for r in upsert_preprocessing(old, new).collect()}
    # n4's first record takes n3's place before its second one takes n4's
    assert got == {("n1", "d", "main", "processed"), ("b", "d", None, "processed"), ("n2", "d", None, "failed"),
                   ("n4", "g", "z", "processed"), ("c", "h", "x", "processed")}
