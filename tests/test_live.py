"""Summaries from stored partials equal the full recompute after any upsert sequence."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from runlens.operators import live as L
from runlens.operators import runs as R
from runlens.session import cut_lineage

RUNS = ("id string, experiment_id string, approach_name string, provider string, model string, sample_index long, input_text string, "
        "expected_answer string, raw_output string, parsed_answer string, parsing_method string, parsing_confidence double, "
        "is_correct boolean, execution_time_ms long, cost_estimate double, created_at timestamp")
RESULTS = ("run_id string, experiment_id string, approach string, provider string, model string, sample_index long, input_text string, "
           "expected_answer string, text string, extracted_answer string, parsing_method string, parsing_confidence double, latency double, "
           "cost double, created_at timestamp")
DAY = dt.datetime(2024, 1, 1)


def _results(spark, r, n, ids, day):
    rows = [(f"r{r.randrange(ids)}", f"e{r.randrange(3)}", r.choice(["None", "CoT"]), "p", r.choice(["m1", "m2", None]), i, "q", r.choice(["1", "2"]), "t",
             r.choice(["1", "", None]), "regex", r.choice([0.1, 0.7, 1.0, None]), r.choice([0.1, 2.0 / 3, None]), r.choice([0.1, 1e-7, 0.3, None]),
             DAY + dt.timedelta(days=day + r.randrange(-5, 5), microseconds=i)) for i in range(n)]
    return spark.createDataFrame(rows, RESULTS)


def _rows(df):
    fixed = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    return sorted(map(tuple, df.select(*fixed).collect()), key=str)


def test_any_upsert_sequence_equals_the_recompute(spark):
    r = random.Random(5)
    experiments = spark.createDataFrame([(f"e{i}", f"n{i}", "running", DAY) for i in range(4)], "id string, name string, status string, created_at timestamp")
    runs = spark.createDataFrame([], RUNS)
    metrics = spark.createDataFrame([("r1", 0.9), ("r1", 0.1), ("r5", None)], "run_id string, confidence_score double")
    stored = L.summary_partials(runs, metrics)
    for step, (n, ids) in enumerate([(60, 40), (30, 40), (5, 10), (40, 25)]):
        more = spark.createDataFrame([(f"r{r.randrange(40)}", r.random()) for _ in range(6)], metrics.schema) if step % 2 else None
        runs, metrics, stored = L.upsert_with_partials(runs, metrics, stored, _results(spark, r, n, ids, day=-step), more)
        runs, metrics, stored = cut_lineage(runs), cut_lineage(metrics), cut_lineage(stored)
        whole = L.summary_partials(runs, metrics)
        assert sorted(map(tuple, stored.collect()), key=str) == sorted(map(tuple, whole.select(stored.columns).collect()), key=str)  # exact
        assert _rows(L.live_experiment_summary(stored, experiments)) == _rows(R.experiment_summary(runs, metrics, experiments))
        assert _rows(L.live_comparison(stored)) == _rows(R.compare_approaches(runs, metrics))
    assert L.upsert_with_partials(runs, metrics, stored)[2] is stored


def test_the_newest_time_is_taken_again_only_where_it_was_lost(spark):
    row = lambda i, day: (f"r{i}", "e", "a", "p", "m", i, "", "", "", "", "none", 0.0, True, 1, 0.5, DAY + dt.timedelta(days=day))
    runs = spark.createDataFrame([row(1, 1), row(2, 9), row(3, 3)], RUNS)
    none = spark.createDataFrame([], "run_id string, confidence_score double")
    stored = cut_lineage(L.summary_partials(runs, none))
    old = spark.createDataFrame([("r2", "e", "a", "p", "m", 2, "", "", "", "", "none", 0.0, 0.001, 0.25, DAY)], RESULTS)
    _, _, after = L.upsert_with_partials(runs, none, stored, old)
    assert after.first().newest == DAY + dt.timedelta(days=3) and float(after.first().cost_sum) == 1.25
    # a row that goes to another group leaves an empty one, which is dropped
    moved = spark.createDataFrame([(f"r{i}", "e2", "a", "p", "m", i, "", "", "", "", "none", 0.0, 0.001, 0.25, DAY) for i in (1, 2, 3)], RESULTS)
    _, _, after = L.upsert_with_partials(runs, none, stored, moved)
    assert [x.experiment_id for x in after.collect()] == ["e2"]


def test_rollup_joins_a_long_run_in_slices(spark, monkeypatch):
    monkeypatch.setattr(R, "STEP_SLICE", 7)
    rows = [("long", i, None if i % 50 == 3 else "" if i % 50 == 4 else f"t{i}", 1, 2, 3, 0.5) for i in range(500)]
    rows += [("long", 7, "again", 0, 0, 0, 0.0), ("one", 1, "x", 1, 1, 2, 0.1), ("none", 1, None, 1, 1, 2, 0.1), (None, 2, "b", 1, 1, 2, 0.1), (None, 1, "a", 1, 1, 2, 0.1)]
    df = spark.createDataFrame(rows, "run_id string, step int, text string, prompt_tokens int, completion_tokens int, total_tokens int, generation_time double")
    got = {x.run_id: x for x in R.rollup_steps(df.repartition(6)).collect()}
    want = {}
    for run, step, text, *_ in sorted(rows, key=lambda x: (str(x[0]), x[1], x[2] is not None, x[2] or "")):
        want.setdefault(run, []).append(text)
    assert {k: v.text for k, v in got.items()} == {k: "\n\n".join(t for t in v if t is not None) for k, v in want.items()}
    assert got["long"].step_count == 501 and got["long"].refined and not got["one"].refined


@pytest.mark.parametrize("n", [50_000])
def test_rollup_keeps_a_runs_order_at_any_length(spark, n):
    df = spark.range(n).selectExpr("'r' AS run_id", f"{n} - id AS step", f"cast({n} - id as string) AS text", "1 AS prompt_tokens", "1 AS completion_tokens",
                                   "2 AS total_tokens", "0.0D AS generation_time")
    assert R.rollup_steps(df, sep=",").first().text == ",".join(map(str, range(1, n + 1)))
