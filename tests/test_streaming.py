"""Streams: resume, idempotent sinks and late rows behind the watermark."""

import datetime as dt

from pyspark.sql import functions as F

from runlens.session import scratch_path
from runlens.streaming import streams as ST


def test_late_rows_are_dropped(spark):
    base = scratch_path(spark, "late")
    schema = "call_id long, ts timestamp, provider string, duration double, tokens long, success boolean"
    t0 = dt.datetime(2024, 1, 1, 0, 0, 0)

    def rows(sec_list, start_id):
        return [(start_id + i, t0 + dt.timedelta(seconds=s), "cohere", 1.0, 10, True) for i, s in enumerate(sec_list)]

    spark.createDataFrame(rows([0, 0, 100, 100], 0), schema).coalesce(1).write.mode("append").parquet(f"{base}/src")
    w = ST.rate_audit_stream(spark, f"{base}/src", schema, f"{base}/out", f"{base}/ckpt", watermark="5 seconds",
                             max_files_per_trigger=1)
    assert ST.run_available(w) == 4
    # second batch: one on-time row at 101 s and one row 100 s late (second 0)
    spark.createDataFrame(rows([101, 0], 10), schema).coalesce(1).write.mode("append").parquet(f"{base}/src")
    w = ST.rate_audit_stream(spark, f"{base}/src", schema, f"{base}/out", f"{base}/ckpt", watermark="5 seconds",
                             max_files_per_trigger=1)
    assert ST.run_available(w) == 2
    out = {r.window_start.replace(tzinfo=None) - t0: r.calls for r in ST.current_rates(spark, f"{base}/out").collect()}
    assert out[dt.timedelta(seconds=0)] == 2  # the late row did not reopen the window
    assert out[dt.timedelta(seconds=101)] == 1


def test_replayed_batch_is_idempotent(spark):
    from runlens.sources.io import read_merged, write_delta

    base = scratch_path(spark, "idem")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long")
    write_delta(df, base, 0)
    write_delta(df.withColumn("v", F.col("v") + 10), base, 1)
    write_delta(df.withColumn("v", F.col("v") + 10), base, 1)  # replay of batch 1
    got = {r.k: r.v for r in read_merged(spark, base, ["k"]).collect()}
    assert got == {"a": 11, "b": 12}


def test_compaction_keeps_current_rows(spark):
    from runlens.sources.io import compact, read_merged, write_delta

    base = scratch_path(spark, "compact")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long")
    write_delta(df, base, 0)
    write_delta(df.filter("k = 'a'").withColumn("v", F.lit(5).cast("long")), base, 1)
    assert compact(spark, base, ["k"]) == 1
    write_delta(spark.createDataFrame([("b", 7), ("c", 9)], "k string, v long"), base, 2)
    got = {r.k: r.v for r in read_merged(spark, base, ["k"]).collect()}
    assert got == {"a": 5, "b": 7, "c": 9}


def test_progress_updates_across_batches(spark):
    base = scratch_path(spark, "prog")
    schema = "id string, experiment_id string, is_correct boolean, sample_index long"
    totals = spark.createDataFrame([("e1", 4), ("e2", 2)], "experiment_id string, total_samples long")
    spark.createDataFrame([("a", "e1", True, 0), ("b", "e1", None, 1)], schema).coalesce(1).write.parquet(f"{base}/src")
    w = ST.progress_stream(spark, f"{base}/src", schema, totals, f"{base}/out", f"{base}/ckpt", max_files_per_trigger=1)
    ST.run_available(w)
    spark.createDataFrame([("c", "e1", False, 2), ("d", "e2", True, 0)], schema).coalesce(1).write.mode("append") \
        .parquet(f"{base}/src")
    w = ST.progress_stream(spark, f"{base}/src", schema, totals, f"{base}/out", f"{base}/ckpt", max_files_per_trigger=1)
    ST.run_available(w)
    got = {r.experiment_id: (r.results_count, r.errors_count, r.progress_percentage)
           for r in ST.current_progress(spark, f"{base}/out").collect()}
    assert got == {"e1": (3, 1, 75.0), "e2": (1, 0, 50.0)}
