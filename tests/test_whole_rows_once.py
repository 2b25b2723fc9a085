"""Plans that sort and shuffle whole rows no more often than they must."""

import pytest
from pyspark.sql import functions as F

from runlens.operators import live as L
from runlens.operators import maintain as M
from runlens.session import scratch_path
from runlens.sources import io as IO
from runlens.sources.keyed import KeyedTable

RUNS = ("id string, experiment_id string, approach_name string, model string, sample_index long, is_correct boolean, execution_time_ms long, cost_estimate double, "
        "parsing_confidence double, created_at timestamp_ntz, raw_output string")


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _aggregates_of_rows(df) -> int:
    return sum("max_by" in line for line in _plan(df).splitlines() if "Aggregate" in line)


@pytest.fixture(scope="module")
def runs(spark):
    t = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    out = spark.range(40).select(F.concat(F.lit("r"), "id").alias("id"), F.lit("e").alias("experiment_id"), F.concat(F.lit("a"), F.col("id") % 2).alias("approach_name"),
                                 F.lit("m").alias("model"), F.col("id").alias("sample_index"), (F.col("id") % 3 == 0).alias("is_correct"), F.col("id").alias("execution_time_ms"),
                                 F.lit(0.5).alias("cost_estimate"), F.lit(0.25).alias("parsing_confidence"), t.alias("created_at"), F.repeat(F.lit("x"), 7).alias("raw_output"))
    return out.to(spark.createDataFrame([], RUNS).schema)


def test_merged_table_finds_the_last_rows_once(spark, runs):
    base = scratch_path(spark, "merged")
    for batch, wanted in enumerate(("sample_index < 10", "sample_index between 5 and 15")):
        IO.write_delta(runs.where(wanted).withColumn("sample_index", F.lit(100 + batch)), base, batch)
    got = IO.read_merged(spark, base, ["id"], ["created_at"], runs)
    assert _aggregates_of_rows(got) == 1
    assert {r["sample_index"]: r["count"] for r in got.where("sample_index >= 100").groupBy("sample_index").count().collect()} == {100: 5, 101: 11}
    assert got.count() == 40


def test_upsert_finds_the_last_rows_once(runs):
    more = runs.where("sample_index < 3").withColumn("created_at", F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")).withColumn("model", F.lit("new"))
    got = M.upsert(runs, runs.where("sample_index < 3").unionByName(more), ["id"], ["created_at"])
    assert _aggregates_of_rows(got) == 1
    assert got.count() == 40 and got.where("model = 'new'").count() == 3


def test_partials_find_the_last_incoming_rows_before_they_are_used(spark, runs):
    cols = [c for c in runs.columns if c != "raw_output"]
    metrics = spark.createDataFrame([("r1", 0.5), ("r1", 0.7), ("r9", 0.1)], "run_id string, confidence_score double")
    results = runs.where("sample_index < 5").select(
        F.when(F.col("sample_index") > 0, F.col("id")).alias("run_id"), "experiment_id", F.col("approach_name").alias("approach"), F.lit("p").alias("provider"), "model", "sample_index",
        F.lit("q").alias("input_text"), F.lit("1").alias("expected_answer"), F.lit("1").alias("text"), F.lit("1").alias("extracted_answer"), F.lit("regex").alias("parsing_method"),
        F.lit(0.5).alias("parsing_confidence"), F.lit(0.1).alias("latency"), F.lit(0.2).alias("cost"), F.lit("2024-03-01 00:00:00").cast("timestamp_ntz").alias("created_at"))
    more = spark.createDataFrame([("r2", 0.9), ("r30", 0.9)], "run_id string, confidence_score double")
    table = runs.select(*cols)
    after, all_metrics, parts = L.upsert_with_partials(table, metrics, L.summary_partials(table, metrics), results, more)
    assert _aggregates_of_rows(parts) == 0
    want = L.summary_partials(after.where("id is not null"), all_metrics)
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, want.select(*parts.columns).collect()))


def test_export_masks_raw_output_below_the_join(spark, runs):
    metrics = spark.createDataFrame([("r1", 1, True, 0.5)], "run_id string, parsing_attempts int, fallback_used boolean, confidence_score double")
    # text that no optimizer can fold: read from a file
    path = scratch_path(spark, "raw")
    runs.write.parquet(path)
    plan = _plan(IO.export_runs_json_lines(spark.read.parquet(path), metrics)).splitlines()
    join = next(i for i, line in enumerate(plan) if "Join" in line)
    masked = [i for i, line in enumerate(plan) if " chars]" in line]
    assert masked and min(masked) > join
    assert IO.export_runs_json_lines(spark.read.parquet(path), metrics).select("raw_output").distinct().first()[0] == "[7 chars]"


def test_keyed_commit_knows_its_rows_without_counting_them(spark, runs, monkeypatch):
    seen, committed = [], KeyedTable._committed
    monkeypatch.setattr(KeyedTable, "_committed", lambda self, rows, n, *more: seen.append((n, rows.count())) or committed(self, rows, n, *more))
    table = KeyedTable(spark, scratch_path(spark, "known"), ["id"], file_rows=10)
    table.upsert(runs)
    table.upsert(runs.where("sample_index % 7 = 0").withColumn("model", F.lit("new")).unionByName(runs.where("sample_index = 1").withColumn("id", F.lit(""))))
    table.upsert(runs.where("sample_index = 2").withColumn("id", F.lit(None).cast("string")))
    assert all(n == rows for n, rows in seen) and len(seen) == 3
    assert table.read().count() == 42 and sum(r.rows for r in table.files().where("path is not null").collect()) == 42
    assert table.files().where("lo = ''").count() == 1
