"""Registered queries for sources and sinks (2.1).

Each writes what it needs into a fresh folder under the shared checkpoint dir
(data Spark derives from the given tables) and reads it back through the
operator under test, so the round trip is checked against SQL on the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import io as IO
from .profile_plans import MCQ_IO_SQL, _mcq_io
from .registry import query


@query("read_csv_dataset", [], section="2.1", oracle="SELECT item_id, text FROM benchmark")
def _q(fx):
    path = scratch_path(fx.spark, "csv")
    fx.benchmark.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    df = IO.read_csv_dataset(fx.spark, path)  # inferred types, quoted newlines
    return df.select(F.col("item_id").cast("bigint").alias("item_id"), "text")


@query("read_json_records", [], section="2.1", oracle="""
SELECT text AS "INPUT", CAST(item_id % 5 AS VARCHAR) AS "OUTPUT" FROM benchmark
""")
def _q(fx):
    path = scratch_path(fx.spark, "json")
    recs = fx.benchmark.select(
        F.floor(F.col("item_id") / 1000).alias("_part"),
        F.to_json(F.struct(F.col("text").alias("INPUT"), (F.col("item_id") % 5).cast("string").alias("OUTPUT"))).alias("j"),
    )
    # one JSON list document per block of at most 1000 records
    docs = recs.groupBy("_part").agg(F.concat(F.lit("["), F.concat_ws(",", F.collect_list("j")), F.lit("]")).alias("value"))
    docs.write.mode("overwrite").partitionBy("_part").text(path)
    return IO.read_json_records(fx.spark, path)


@query("write_standardized", ["mcq_v"], section="2.1", oracle=MCQ_IO_SQL + """
SELECT f.format, io."INPUT", io."OUTPUT" FROM io CROSS JOIN (VALUES ('csv'), ('json'), ('parquet')) f(format)
""")
def _q(fx):
    io = _mcq_io(fx)
    base = scratch_path(fx.spark, "std")
    out = None
    for suffix in ("csv", "json", "parquet"):
        path = f"{base}/data.{suffix}"
        fmt = IO.write_standardized(io, path)
        if fmt == "csv":
            back = IO.read_csv_dataset(fx.spark, path, schema="INPUT string, OUTPUT string")
        elif fmt == "json":
            back = IO.read_json_records(fx.spark, path)
        else:
            back = fx.spark.read.parquet(path)
        back = back.select(F.lit(fmt).alias("format"), "INPUT", "OUTPUT")
        out = back if out is None else out.unionByName(back)
    return out


EXPORT_COLS = ("r.*, pm.parsing_attempts, pm.fallback_used, pm.confidence_score AS parsing_confidence_score, "
               "pm.extraction_time_ms AS parsing_time_ms")


@query("export_runs_csv", ["runs_v", "parsing_metrics_v"], section="2.1", oracle=f"""
SELECT {EXPORT_COLS} FROM runs_v r LEFT JOIN parsing_metrics_v pm ON r.id = pm.run_id ORDER BY r.created_at
""")
def _q(fx):
    path = scratch_path(fx.spark, "export_csv")
    out = IO.export_runs_csv(fx.runs_v, fx.parsing_metrics_v, path)
    return IO.read_csv_dataset(fx.spark, path, schema=out.schema)


@query("export_experiment_json", ["runs_v", "parsing_metrics_v", "responses_v"], section="2.1", oracle="""
SELECT r.*, concat('[', CAST(length(x.raw_output) AS VARCHAR), ' chars]') AS raw_output,
       pm.parsing_attempts, pm.fallback_used, pm.confidence_score AS parsing_confidence_score
FROM runs_v r JOIN responses_v x ON r.sample_index = x.id
LEFT JOIN parsing_metrics_v pm ON r.id = pm.run_id
ORDER BY r.approach_name, r.sample_index
""")
def _q(fx):
    runs = fx.runs_v.join(fx.responses_v.select(F.col("id").alias("sample_index"), "raw_output"), "sample_index")
    path = scratch_path(fx.spark, "export_json")
    IO.export_experiment_json(runs, fx.parsing_metrics_v, fx.experiments_v, path)
    schema = IO.export_runs_json_lines(runs, fx.parsing_metrics_v).schema
    return fx.spark.read.schema(schema).option("timestampNTZFormat", IO.TS_FORMAT).json(f"{path}/runs")


@query("report_tables", ["runs_v", "parsing_metrics_v"], section="2.1", oracle="""
WITH c AS (
  SELECT r.experiment_id, r.approach_name, count(*) AS sample_count,
    coalesce(avg(CASE WHEN r.is_correct THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 0.0) AS accuracy,
    coalesce(avg(r.execution_time_ms), 0.0) AS avg_execution_time_ms, coalesce(sum(r.cost_estimate), 0.0) AS total_cost
  FROM runs_v r LEFT JOIN parsing_metrics_v pm ON r.id = pm.run_id GROUP BY 1, 2)
SELECT substr(experiment_id, 1, 8) AS "Experiment", approach_name AS "Approach", accuracy AS "Accuracy",
       avg_execution_time_ms AS "Avg Time (ms)", total_cost AS "Total Cost", sample_count AS "Samples"
FROM c
""")
def _q(fx):
    return IO.report_tables(fx.runs_v, fx.parsing_metrics_v, fx.experiments_v)["comparison"]


@query("report_tables_summary", ["runs_v", "parsing_metrics_v", "experiments_v"], section="2.1", oracle="""
SELECT experiment_id AS "Experiment ID", count(*) AS "Total Runs",
       avg(CASE WHEN is_correct THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS "Accuracy",
       coalesce(avg(execution_time_ms), 0.0) AS "Avg Time (ms)", coalesce(sum(cost_estimate), 0.0) AS "Total Cost",
       array_to_string(list_sort(list(DISTINCT approach_name)), ', ') AS "Approaches",
       array_to_string(list_sort(list(DISTINCT model)), ', ') AS "Models"
FROM runs_v WHERE experiment_id IN (SELECT id FROM experiments_v) GROUP BY experiment_id
""")
def _q(fx):
    return IO.report_tables(fx.runs_v, fx.parsing_metrics_v, fx.experiments_v)["summary"]


@query("report_tables_detail", ["runs_v", "parsing_metrics_v"], section="2.1", oracle="""
SELECT experiment_id, approach_name, model, sample_index, input_text, expected_answer, parsed_answer,
       is_correct, parsing_confidence, execution_time_ms, cost_estimate
FROM runs_v ORDER BY experiment_id, approach_name, sample_index
""")
def _q(fx):
    return IO.report_tables(fx.runs_v, fx.parsing_metrics_v, fx.experiments_v)["detail"]


@query("import_runs_csv", [], section="2.1", oracle="""
SELECT concat('exp_import_', CAST(n AS VARCHAR)) AS id, 'exp_import' AS experiment_id, approach AS approach_name,
       provider, model, n AS sample_index, "input" AS input_text, expected AS expected_answer, "output" AS raw_output,
       '' AS parsed_answer, is_correct, execution_time_ms, cost AS cost_estimate
FROM (
  SELECT row_number() OVER (ORDER BY event_id) - 1 AS n, event_type AS approach,
         CASE WHEN event_id % 9 = 0 THEN NULL ELSE 'local-openai' END AS provider, 'qwen' AS model,
         props AS "input", CAST(event_id % 5 AS VARCHAR) AS expected, concat('line 1', chr(10), 'line "2"') AS "output",
         event_id % 3 = 0 AS is_correct, CAST(floor(value * 100) AS BIGINT) AS execution_time_ms, value / 1000 AS cost
  FROM events)
""")
def _q(fx):
    path = scratch_path(fx.spark, "import_csv")
    src = fx.events.select(
        "event_id",
        F.col("event_type").alias("approach"),
        F.when(F.col("event_id") % 9 == 0, F.lit(None)).otherwise(F.lit("local-openai")).alias("provider"),
        F.lit("qwen").alias("model"),
        F.col("props").alias("input"),
        (F.col("event_id") % 5).cast("string").alias("expected"),
        F.lit('line 1\nline "2"').alias("output"),
        (F.col("event_id") % 3 == 0).alias("is_correct"),
        F.floor(F.col("value") * 100).cast("long").alias("execution_time_ms"),
        (F.col("value") / 1000).alias("cost"),
    )
    # file order = event order: a range-partitioned sort writes part files in order
    src.orderBy("event_id").drop("event_id").write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    runs = IO.import_runs_csv(fx.spark, path, "exp_import")
    return runs.drop("metadata_json")


@query("flatten_run_records", ["responses_v"], section="2.1", oracle="""
SELECT CAST(id AS VARCHAR) AS sample_id, approach_name AS approach, concat('Q', CAST(id AS VARCHAR)) AS "input",
       expected_answer AS expected_output,
       CASE WHEN id % 4 = 0 THEN '' ELSE expected_answer END AS extracted_answer,
       raw_output AS response_text, CAST(id % 50 AS DOUBLE) / 10.0 AS execution_time, 50 + id % 150 AS total_tokens,
       CAST(id % 7 AS DOUBLE) / 1000.0 AS cost_estimate,
       CASE WHEN id % 3 = 0 THEN 0 ELSE id % 6 END AS reasoning_steps, '2024-01-01T00:00:00' AS "timestamp"
FROM responses_v
""")
def _q(fx):
    r = fx.responses_v
    rec = r.select(
        F.col("id").cast("string").alias("sample_id"),
        F.concat(F.lit("Q"), F.col("id").cast("string")).alias("input"),
        F.col("expected_answer").alias("expected_output"),
        F.col("approach_name").alias("approach"),
        F.lit("2024-01-01T00:00:00").alias("timestamp"),
        F.struct(
            F.struct(
                F.col("raw_output").alias("text"), F.lit("local").alias("provider"), F.lit("m").alias("model"),
                F.lit(10).cast("long").alias("prompt_tokens"), F.lit(20).cast("long").alias("completion_tokens"),
                (F.lit(50) + F.col("id") % 150).alias("total_tokens"), F.lit(0.5).alias("generation_time"),
                F.create_map().cast("map<string,string>").alias("parameters"), F.lit("r").alias("response_id"),
                F.create_map().cast("map<string,string>").alias("metadata"),
                F.when(F.col("id") % 4 != 0, F.col("expected_answer")).alias("extracted_answer"),
            ).alias("response"),
            F.col("approach_name").alias("approach_name"),
            ((F.col("id") % 50).cast("double") / 10.0).alias("execution_time"),
            ((F.col("id") % 7).cast("double") / 1000.0).alias("cost_estimate"),
            F.when(F.col("id") % 3 != 0, F.create_map(F.lit("reasoning_steps"), (F.col("id") % 6).cast("string")))
            .otherwise(F.create_map().cast("map<string,string>")).alias("metadata"),
        ).alias("result"),
    )
    path = scratch_path(fx.spark, "records")
    rec.write.mode("overwrite").json(path)
    return IO.flatten_run_records(IO.read_run_records(fx.spark, path))

