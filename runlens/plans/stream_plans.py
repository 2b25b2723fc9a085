"""Registered queries for the Structured Streaming jobs (2.14).

Each writes its input as a sequence of parquet appends derived from the given
tables, runs the stream with ``availableNow`` (one file per trigger, so there
are several micro-batches), and returns the sink's current table, which must
equal the batch twin in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..streaming import resume as RS
from ..streaming import streams as ST
from .maintain_plans import RESULTS_SQL, RUN_COLS, _results
from .registry import query


def _write_in_parts(df, path: str, part_col, parts: int = 3) -> None:
    """Append ``df`` to ``path`` in ``parts`` separate writes (separate files)."""
    for i in range(parts):
        df.filter(part_col % parts == i).write.mode("append").parquet(path)


UPSERT_SQL = f"""
WITH {RESULTS_SQL.strip()}
SELECT {RUN_COLS} FROM runs_v WHERE id NOT IN (SELECT id FROM res)
UNION ALL SELECT {RUN_COLS} FROM res
"""
RUN_COL_LIST = [c.strip() for c in RUN_COLS.split(",")]


@query("stream_ingest_runs", ["runs_v", "responses_v"], section="2.14", oracle=UPSERT_SQL)
def _q(fx):
    spark = fx.spark
    base = scratch_path(spark, "ingest")
    results = _results(fx)
    _write_in_parts(results, f"{base}/source", F.col("sample_index"))
    writer = ST.ingest_runs_stream(spark, f"{base}/source", results.schema, f"{base}/table", f"{base}/ckpt",
                                   max_files_per_trigger=4)
    ST.run_available(writer)
    initial = fx.runs_v.select(*RUN_COL_LIST)
    return ST.current_runs(spark, f"{base}/table", initial).select(*RUN_COL_LIST)


@query("stream_progress", ["runs_v"], section="2.14", oracle="""
WITH t AS (SELECT experiment_id, count(*) AS total_samples FROM runs_v GROUP BY 1),
a AS (SELECT experiment_id, count(*) AS results_count,
             CAST(sum(CASE WHEN is_correct IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS errors_count
      FROM runs_v WHERE sample_index % 4 <> 0 GROUP BY 1)
SELECT a.experiment_id, results_count, errors_count, total_samples,
       CASE WHEN total_samples > 0 THEN results_count / total_samples * 100.0 ELSE 0.0 END AS progress_percentage
FROM a LEFT JOIN t ON a.experiment_id = t.experiment_id
""")
def _q(fx):
    spark = fx.spark
    base = scratch_path(spark, "progress")
    runs = fx.runs_v
    arrived = runs.filter(F.col("sample_index") % 4 != 0)
    _write_in_parts(arrived, f"{base}/source", F.col("sample_index"))
    totals = runs.groupBy("experiment_id").agg(F.count(F.lit(1)).alias("total_samples"))
    writer = ST.progress_stream(spark, f"{base}/source", arrived.schema, totals, f"{base}/out", f"{base}/ckpt",
                                max_files_per_trigger=4)
    ST.run_available(writer)
    return ST.current_progress(spark, f"{base}/out")


@query("stream_resume", ["runs_v", "responses_v"], section="2.14", oracle=UPSERT_SQL)
def _q(fx):
    """Stop after two files, resume with nothing new (0 rows), then with the third
    file and one that repeats samples of the first two at another cost: those
    are done and skipped, so the result equals one pass over all files."""
    spark = fx.spark
    base = scratch_path(spark, "resume")
    results = _results(fx)
    src, tbl, ckpt = f"{base}/source", f"{base}/table", f"{base}/ckpt"
    key = F.col("sample_index")
    writer = lambda: RS.resume_stream(spark, src, results.schema, tbl, ckpt, max_files_per_trigger=4)
    for i in range(2):
        results.filter(key % 3 == i).write.mode("append").parquet(src)
    first = ST.run_available(writer())
    again = ST.run_available(writer())
    if again != 0:
        raise AssertionError(f"resumed stream re-read {again} rows")
    results.filter(key % 3 == 2).write.mode("append").parquet(src)
    results.filter(key % 3 != 2).withColumn("cost", F.lit(9.9)).write.mode("append").parquet(src)
    third = ST.run_available(writer())
    if first == 0 or third == 0:
        raise AssertionError("stream read no rows")
    initial = fx.runs_v.select(*RUN_COL_LIST)
    return ST.current_runs(spark, tbl, initial).select(*RUN_COL_LIST)


@query("pending_by_state", ["responses_v"], section="2.14", oracle="""
SELECT concat('exp_', CAST(id % 20 AS VARCHAR)) AS experiment_id, approach_name, id AS sample_index FROM responses_v WHERE id % 3 = 2
""")
def _q(fx):
    """The work list of all samples after results of two thirds of them came in: what the stream's state does not hold as done."""
    spark = fx.spark
    base = scratch_path(spark, "pending")
    results = _results(fx)
    results.filter(F.col("sample_index") % 3 != 2).write.parquet(f"{base}/source")
    ST.run_available(RS.resume_stream(spark, f"{base}/source", results.schema, f"{base}/table", f"{base}/ckpt"))
    grid = results.select("experiment_id", F.col("approach").alias("approach_name"), "sample_index")
    return RS.pending_by_state(spark, grid, f"{base}/ckpt")


@query("call_rate_audit", ["call_log_v"], section="2.14", oracle="""
SELECT provider, date_trunc('second', ts) AS window_start, date_trunc('second', ts) + INTERVAL 1 SECOND AS window_end,
       count(*) AS calls,
       CAST(CASE provider WHEN 'anthropic' THEN 5.0 WHEN 'cohere' THEN 10.0 WHEN 'openrouter' THEN 2.0 ELSE 1.0 END
            AS DOUBLE) AS ceiling,
       count(*) > CASE provider WHEN 'anthropic' THEN 5.0 WHEN 'cohere' THEN 10.0 WHEN 'openrouter' THEN 2.0 ELSE 1.0 END
         AS over_limit
FROM call_log_v GROUP BY 1, 2
""")
def _q(fx):
    spark = fx.spark
    base = scratch_path(spark, "rates")
    calls = fx.call_log_v
    # arrival in time order: three appends of consecutive time ranges
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    bounds = calls.agg(F.min(t).alias("lo"), F.max(t).alias("hi")).collect()[0]  # two numbers
    span = max(1, (bounds["hi"] - bounds["lo"] + 1))
    part = F.floor((t - F.lit(bounds["lo"])) * 3 / F.lit(span)).cast("int")
    for i in range(3):
        calls.filter(part == i).write.mode("append").parquet(f"{base}/source")
    writer = ST.rate_audit_stream(spark, f"{base}/source", calls.schema, f"{base}/out", f"{base}/ckpt",
                                  max_files_per_trigger=4)
    ST.run_available(writer)
    out = ST.current_rates(spark, f"{base}/out")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn(
        "window_end", F.col("window_end").cast("timestamp_ntz"))


@query("call_rate_audit_sliding", ["call_log_v"], section="2.14", oracle="""
WITH c AS (
  SELECT DISTINCT provider, ts,
    count(*) OVER (PARTITION BY provider ORDER BY ts RANGE BETWEEN INTERVAL 999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS calls,
    CAST(CASE provider WHEN 'anthropic' THEN 5.0 WHEN 'cohere' THEN 10.0 WHEN 'openrouter' THEN 2.0 ELSE 1.0 END AS DOUBLE) AS ceiling
  FROM call_log_v)
SELECT provider, ts - INTERVAL 1 SECOND AS window_start, ts AS window_end, calls, ceiling, calls > ceiling AS over_limit FROM c
""")
def _q(fx):
    out = ST.sliding_rate_audit(fx.call_log_v)
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn("window_end", F.col("window_end").cast("timestamp_ntz"))
