"""Keyed state: each sample once across restarts, repeats and overlapping files."""

from datetime import timedelta

from pyspark.sql import functions as F

from runlens.session import scratch_path
from runlens.sources import io as IO
from runlens.streaming import resume as RS
from runlens.streaming import streams as ST

RESULTS = ("run_id string, experiment_id string, approach string, provider string, model string, sample_index long, input_text string, "
           "expected_answer string, text string, extracted_answer string, parsing_method string, parsing_confidence double, latency double, "
           "cost double, created_at timestamp")


def _rows(spark, samples, cost, exp="e"):
    null = F.lit(None)
    out = spark.createDataFrame([(s,) for s in samples], "sample_index long")
    return out.select(F.format_string("%s-%s", F.lit(str(cost)), "sample_index").alias("run_id"), F.lit(exp).alias("experiment_id"), F.lit("CoT").alias("approach"),
                      null.cast("string").alias("provider"), F.lit("m").alias("model"), "sample_index", F.lit("q").alias("input_text"), F.lit("1").alias("expected_answer"),
                      F.lit("1").alias("text"), F.lit("1").alias("extracted_answer"), F.lit("regex").alias("parsing_method"), F.lit(0.5).alias("parsing_confidence"),
                      F.lit(0.1).alias("latency"), F.lit(cost).alias("cost"), F.lit("2024-01-01").cast("timestamp").alias("created_at")).to(
        spark.createDataFrame([], RESULTS).schema)


def _arrived(spark, base):
    got = spark.read.parquet(f"{base}/table/delta")
    return sorted((r.experiment_id, r.sample_index if r.sample_index is not None else -10**6, r.cost_estimate) for r in got.collect())


def test_samples_pass_once_across_restarts(spark):
    base = scratch_path(spark, "once")
    schema = spark.createDataFrame([], RESULTS).schema
    run = lambda: ST.run_available(RS.resume_stream(spark, f"{base}/src", schema, f"{base}/table", f"{base}/ckpt", max_files_per_trigger=1))
    _rows(spark, [0, 1, 1023, 1024, 5000, -1, 1, 1], 1.0).coalesce(1).write.mode("append").parquet(f"{base}/src")
    assert run() == 8 and run() == 0
    assert _arrived(spark, base) == [("e", s, 1.0) for s in (-1, 0, 1, 1023, 1024, 5000)]
    _rows(spark, [0, 2, 1024, 1025], 2.0).coalesce(1).write.mode("append").parquet(f"{base}/src")
    _rows(spark, [2, 0], 3.0, exp="other").coalesce(1).write.mode("append").parquet(f"{base}/src")
    assert run() == 6
    assert _arrived(spark, base) == sorted([("e", s, 1.0) for s in (-1, 0, 1, 1023, 1024, 5000)] + [("e", 2, 2.0), ("e", 1025, 2.0), ("other", 0, 3.0), ("other", 2, 3.0)])
    done = sorted((r.experiment_id, r.sample_index) for r in RS.done_samples(spark, f"{base}/ckpt").collect())
    assert done == sorted([("e", s) for s in (-1, 0, 1, 2, 1023, 1024, 1025, 5000)] + [("other", 0), ("other", 2)])
    grid = spark.range(0, 1030).selectExpr("'e' AS experiment_id", "'CoT' AS approach_name", "id AS sample_index", "id * 2 AS more")
    left = RS.pending_by_state(spark, grid, f"{base}/ckpt")
    assert left.columns == grid.columns and left.count() == 1030 - 6
    blocks = spark.read.format("statestore").option("stateVarName", "done").load(f"{base}/ckpt").count()
    assert blocks == 5  # one key a block of samples, not one a sample


def test_blocks_of_samples_share_a_key(spark):
    base = scratch_path(spark, "keys")
    schema = spark.createDataFrame([], RESULTS).schema
    run = lambda: ST.run_available(RS.resume_stream(spark, f"{base}/src", schema, f"{base}/table", f"{base}/ckpt", max_files_per_trigger=1))
    own = [100 * i for i in range(640)] + [65_536, -100]
    for samples in (own[::2], own):
        _rows(spark, samples, 1.0).coalesce(1).write.mode("append").parquet(f"{base}/src")
        run()
    assert _arrived(spark, base) == sorted(("e", s, 1.0) for s in own)
    state = spark.read.format("statestore").option("stateVarName", "done").load(f"{base}/ckpt")
    assert state.select("key").distinct().count() == 3 and state.count() == 65
    assert sorted(r.sample_index for r in RS.done_samples(spark, f"{base}/ckpt").collect()) == sorted(own)


def test_state_that_is_not_used_is_forgotten(spark):
    base = scratch_path(spark, "ttl")
    schema = spark.createDataFrame([], RESULTS).schema
    run = lambda: ST.run_available(RS.resume_stream(spark, f"{base}/src", schema, f"{base}/table", f"{base}/ckpt", ttl=timedelta(milliseconds=1)))
    for cost in (1.0, 2.0):
        _rows(spark, [7], cost).coalesce(1).write.mode("append").parquet(f"{base}/src")
        run()
    assert _arrived(spark, base) == [("e", 7, 1.0), ("e", 7, 2.0)]


def test_the_table_holds_each_sample_once(spark):
    base = scratch_path(spark, "table")
    schema = spark.createDataFrame([], RESULTS).schema
    _rows(spark, range(50), 1.0).write.mode("append").parquet(f"{base}/src")
    _rows(spark, range(25, 75), 2.0).write.mode("append").parquet(f"{base}/src")
    ST.run_available(RS.resume_stream(spark, f"{base}/src", schema, f"{base}/table", f"{base}/ckpt", ttl=None, max_files_per_trigger=1))
    runs = IO.read_merged(spark, f"{base}/table", ["experiment_id", "approach_name", "sample_index"], ["created_at"])
    assert runs.count() == 75 and runs.select("sample_index").distinct().count() == 75
